"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

Every row descends three levels.  A shard draws ``-ln(u) / weight`` with ``u`` a
hash of the row's key and the shard's name; the draw of a rack or a region is
the smallest draw below it, which is a draw at the sum of the weights below.
At each level the child with the smallest draw wins.  So a row ends at the shard
with the smallest draw, and a changed weight moves rows into or out of the
shards whose weight changes and nowhere else: one more shard, in whatever rack
or region, takes rows only into itself, for every number of shards.

Results for odd input: a null key draws as the text "null"; equal keys share a
shard; an empty table stays empty; texts play no part; extra columns pass
through, and an added column whose name is taken is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash bits used for a draw: 13 hex digits.
DRAW_HEX = 13
DRAW_SPAN = float(16 ** DRAW_HEX)

#: Rows that one numbering bucket is meant to hold.
ROWS_PER_BUCKET = 100_000


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def uniform_tree(n_shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Shard]:
    """``n_shards`` shards of weight 1, filled rack by rack and region by region."""
    per_region = per_rack * racks_per_region
    return [Shard(f"g{i // per_region}", f"g{i // per_region}r{i % per_region // per_rack}", i)
            for i in range(n_shards)]


def draw(key: Column, node: str, weight: float) -> Column:
    """The node's exponential draw for a key: smallest wins, rate ``weight``."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{node}"))), 1, DRAW_HEX)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(DRAW_SPAN)
    return -F.ln(u) / F.lit(float(weight))


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Shard number of a key: descend region, then rack, then shard."""
    if not tree or any(s.weight <= 0 for s in tree):
        raise ValueError("a hash tree needs at least one shard, and positive weights")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    leaves = sorted(tree, key=lambda s: (s.region, s.rack, s.shard))
    draws = F.array(*[F.struct(draw(key, f"{s.region}/{s.rack}/{s.shard}", s.weight).alias("d"), F.lit(i).alias("i"))
                      for i, s in enumerate(leaves)])
    # the least draw of the regions, of its racks and of its shards is one and the same
    return F.element_at(F.array(*[F.lit(s.shard) for s in leaves]), F.array_min(draws)["i"] + 1)


def assign(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row in column ``out``; no shuffle."""
    _free(df, out)
    return df.withColumn(out, shard_of(F.col(key), tree).cast("int"))


def _free(df: DataFrame, name: str) -> None:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} is already there")


def number_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    The order is md5 of the order columns, then the columns.  Rows equal in
    every column are counted before the shuffle and unfolded after it.  Each
    shard is cut by hash prefix into buckets of about ``ROWS_PER_BUCKET`` rows
    of the largest shard; bucket totals give the offsets, so no window ever
    spans a shard, and rows that share one column (an id) spread over the
    buckets by the others.  Empty input gives no rows.
    """
    _free(df, out)
    rows = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    named = F.concat_ws("|", *[F.coalesce(F.col("row")[c].cast("string"), F.lit("null")) for c in order])
    digits = F.substring(F.md5(named), 1, DRAW_HEX)
    largest = df.groupBy(shard).count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-largest // ROWS_PER_BUCKET))
    same = (df.select(rows).groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
            .select("row", "copies", F.col("row")[shard].alias("shard"), F.conv(digits, 16, 10).cast("long").alias("h"))
            .withColumn("bucket", F.floor(F.col("h") * F.lit(float(buckets)) / F.lit(DRAW_SPAN)).cast("long")))
    totals = same.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    # one row per bucket, not per row: a window over a shard's buckets is small
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("shard", "bucket").orderBy("h", *[F.col("row")[c] for c in order])
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (same.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
              .join(offsets, ["shard", "bucket"]))
    first = F.col("offset") + F.col("first")
    unfolded = placed.select("row", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"))
    return unfolded.select(*[F.col("row")[c].alias(c) for c in df.columns], F.col("slot").alias(out))
