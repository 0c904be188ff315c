"""

pandas ``x.mode().iloc[0]`` drops NULL and returns the smallest of the most
frequent values.  We compute it in two aggregation stages:

1. ``(key, attr, value) -> n``: stacks any number of attribute columns into
   one long table and counts; the partial aggregate collapses a hot key
   (even one holding a third of all rows) map-side before the shuffle.
2. ``key -> min_by(value, (-n, value))`` for each attribute, again a
   partial/final aggregate with a fixed-size buffer.  ``modes_by_key`` deals the
   counts by key first: their number follows from the rows alone, while partial
   results are a wide row for every key and task, more with every partition.

No group is ever collected into one task, and any number of modes and
distinct counts from different sources costs the same two shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute_values(df: DataFrame, key: str, attrs: dict[str, Column | str], weight: Column | None = None) -> DataFrame:
    """Long form (key, attr, value, w) of ``attrs`` (name -> column), NULL key
    and NULL values dropped; ``weight`` rows of an already grouped input count
    as so many.  Values are compared as text, so numeric
    attributes must be given an order-preserving text form (see ``padded``)."""
    entries = [F.struct(F.lit(name).alias("attr"),
                        (F.col(c) if isinstance(c, str) else c).cast("string").alias("value"))
               for name, c in attrs.items()]
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    return (df.select(F.col(key), w.alias("w"), F.inline(F.array(*entries)))
              .filter(F.col(key).isNotNull() & F.col("value").isNotNull()))


def value_counts_by_key(long_frames: list[DataFrame], key: str) -> DataFrame:
    """Stage 1: (key, attr, value, n)."""
    allv = reduce(DataFrame.unionByName, long_frames)
    return allv.groupBy(key, "attr", "value").agg(F.sum("w").alias("n"))


def mode_of(attr: str) -> Column:
    """Stage-2 aggregate: most frequent value of ``attr``; ties -> smallest."""
    rank = F.when(F.col("attr") == attr, F.struct((-F.col("n")).alias("neg_n"), F.col("value")))
    return F.min_by(F.col("value"), rank)


def nunique_of(attr: str) -> Column:
    """Stage-2 aggregate: number of distinct non-NULL values of ``attr``."""
    return F.count_if(F.col("attr") == attr).cast("bigint")


def modes_by_key(counts: DataFrame, key: str, modes: dict[str, str], distinct: dict[str, str]) -> DataFrame:
    """Stage 2 for many attributes: per key ``modes`` and ``distinct`` (out name ->
    attr).  The counts of a key, one row for each of its values, meet in one
    partition; there each attribute is reduced, and the few results are set side by side."""
    each = counts.repartition(key).groupBy(key, "attr").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("top"), F.count(F.lit(1)).alias("values"))

    def of(attr: str, c: str) -> Column:
        return F.max(F.when(F.col("attr") == attr, F.col(c)))
    return each.groupBy(key).agg(*[of(attr, "top.value").alias(out) for out, attr in modes.items()],
                                 *[F.coalesce(of(attr, "values"), F.lit(0).cast("bigint")).alias(out) for out, attr in distinct.items()])


def padded(c, width: int = 2) -> Column:
    """Text form of a small non-negative integer whose text order is its
    numeric order (so the smallest-value tie rule holds)."""
    return F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), width, "0")


def grouped_modes(df: DataFrame, key: str, cols: dict[str, str], default=None) -> DataFrame:
    """Convenience: one mode per column of ``cols`` (out name -> column)."""
    counts = value_counts_by_key([attribute_values(df, key, {o: c for o, c in cols.items()})], key)
    out = counts.groupBy(key).agg(*[mode_of(o).alias(o) for o in cols])
    if default is not None:
        out = out.withColumns({o: F.coalesce(F.col(o), F.lit(default)) for o in cols})
    return out
