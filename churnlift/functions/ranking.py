"""Exact ranks and running totals without a single-partition window.

A window with no PARTITION BY (or one partitioned by a two-valued column
such as the treatment arm) puts all rows of the frame in one task.  Both
helpers here work in two levels instead:

1. rows get a *bucket* that respects the sort order — a hash prefix when
   the order key is a uniform hash, a sampled range of the key otherwise
   (written once, so that it does not move) — and per-bucket totals form a
   small table whose size is bounded by the bucket count;
2. exclusive offsets are computed on that small table, joined back, and
   the remaining window runs inside each bucket only.

The results are exact: the buckets only split the work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one in-bucket window is meant to hold; bucket counts follow from the row count.
ROWS_PER_BUCKET = 100_000
#: Strata times buckets whose offsets may be broadcast.
MAX_OFFSETS = 1_000_000


def bucket_count(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_BUCKET))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an input that several passes read: a reliable
    checkpoint in the shared folder named by ``spark.checkpoint.dir``
    (survives executor loss, unlike a local checkpoint)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def md5_key(seed, *cols) -> Column:
    """Uniform, reproducible order key: md5 hex of ``seed|c1|c2...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def rank_by_hash(df: DataFrame, strata: list[str], hash_col: str, out: str = "rank",
                 prefix_len: int | None = None) -> DataFrame:
    """Exact 1-based rank of each row inside its stratum by ascending
    ``hash_col`` (an md5 hex string).  The first ``prefix_len`` hex digits
    give 16**prefix_len equal-width buckets of a uniform key; by default as
    many as leave about ``ROWS_PER_BUCKET`` rows in each."""
    if prefix_len is None:
        prefix_len = max(1, math.ceil(math.log(bucket_count(df.count()), 16)))
    b = df.withColumn("_hb", F.substring(F.col(hash_col), 1, prefix_len))
    counts = b.groupBy(*strata, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*strata).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_hb", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(*strata)).alias("_stratum_n"))
    # #strata x 16**prefix_len rows: broadcast while the strata are few
    few = df.select(*strata).distinct().limit(MAX_OFFSETS // 16 ** prefix_len + 1).count() <= MAX_OFFSETS // 16 ** prefix_len
    j = b.join(F.broadcast(offsets) if few else offsets, on=[*strata, "_hb"])
    local = F.row_number().over(Window.partitionBy(*strata, "_hb").orderBy(hash_col))
    return j.withColumn(out, F.col("_off") + local).drop("_hb", "_off")


def rank_in_order(df: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row by ``order`` (unique), any type.  Rows
    are dealt into ranges and written; each range is numbered by itself and
    moved by the number of rows before it."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row a range
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_off") + local).drop("_range", "_off")


def running_totals(df: DataFrame, order_col: str, value_cols: list[str], descending: bool = True,
                   num_buckets: int | None = None, prefix: str = "cum_", partition_cols=()) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order, per
    ``partition_cols`` group (a few strata, e.g. treatment arms).
    ``order_col`` must be unique within a group (aggregate ties first) and not
    NULL.  Rows are dealt into ranges and written; each range is summed by itself
    and moved by the totals of the ranges before it.  The ranges follow from the
    row count (pass a written ``df``); up to ``ROWS_PER_BUCKET`` rows need none."""
    parts = list(partition_cols)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    upto = (Window.unboundedPreceding, Window.currentRow)
    num_buckets = bucket_count(df.count()) if num_buckets is None else num_buckets
    if num_buckets == 1:
        w = Window.partitionBy(*parts).orderBy(order).rowsBetween(*upto)
        return df.withColumns({f"{prefix}{v}": F.sum(v).over(w) for v in value_cols})
    dealt = materialize(df.repartitionByRange(num_buckets, order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*parts, "_range").agg(*[F.sum(v).alias(v) for v in value_cols])
    # a row a range and group
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    local = Window.partitionBy(*parts, "_range").orderBy(order).rowsBetween(*upto)
    return (dealt.join(F.broadcast(offsets), on=[*parts, "_range"])
            .withColumns({f"{prefix}{v}": F.col(f"_off_{v}") + F.sum(v).over(local) for v in value_cols})
            .drop("_range", *[f"_off_{v}" for v in value_cols]))
