"""Mixing sources to target weights by balanced sampling (the cube method).

Each source gets a target number of words: its weight's share of the mix, at
most ``most`` times its size; what a capped source leaves is shared by weight
among the others until none is above its cap.  A source whose target is r
times its size takes every document floor(r) times, and once more with
probability r - floor(r).

Which documents are taken once more is drawn by the cube method.  The vector
of inclusion probabilities starts at (p, p, ..., p).  A step moves three of
its undecided components along the null space of the balance equations (sum of
words, number of documents) until one of them is 0 or 1, up or down with the
odds that keep each probability's expectation.  Words and documents of the source so keep their totals, up to rounding,
until ``LANDING`` documents are undecided: the landing problem, settled by
trying every subset for the one whose words (then documents) come nearest to
the totals.  The draw of those few is no longer random.

Large documents are settled before, while many others can make up for them:
first those above 1 / ``FIRST`` of their source (fewer than ``FIRST`` a
source), one after the other, each followed by the same change of all
probabilities that are left; then the ``LARGE`` largest of a chunk, by steps
that move all smaller ones a little.

**Scale.**  The documents of a source are dealt into chunks of about ``CHUNK``
by hash, and each chunk makes its steps by itself; it hands on at most two
undecided documents with the probabilities reached.  These are dealt into
chunks again, until a source is one chunk.  Totals are kept within each chunk,
so the number of chunks costs no balance.  Equal rows are counted first and
dealt in blocks, so a row that repeats without bound is many chunks as well.
Draws are seeded by source and chunk and rows are put in order first: reruns
agree, however the rows are partitioned.

**Odd input.**  Null and empty texts have size 0 and take no words; a null
source is a source, the last in order; null and repeated ids are rows of their
own; a source without words has target 0.  Very long texts are counted inside
Spark.  An empty table gives an empty result.  Only the named columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_in_order
from .storage import written

#: Documents that one task draws at a time, more or less, and equal rows dealt together.
CHUNK = 4096
BLOCK = 256
#: Documents of a source that the landing settles; all their subsets are tried.
LANDING = 10
#: Documents of more than 1 / FIRST of their source's words are settled first, then the LARGE largest of a chunk.
FIRST = 100
LARGE = 64
#: A probability this close to 0 or 1 is 0 or 1.
CLOSE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def units(df: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """(source, id, size, n): the documents, equal rows counted."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return (df.select(F.col(source).cast("string").alias("source"), F.col(id).alias("id"), size.alias("size"))
            .groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n")))


def targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, rank, source_size, documents, weight, target) of every source of ``units``.

    Rounds of one aggregate each find the sources whose share is above their
    cap; two numbers a round come to the driver.  All comparisons are in
    integers (decimals in Spark)."""
    if not 0 <= percent <= 100 * most:
        raise ValueError("the mix cannot be larger than all sources at their caps")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    sums = sums.withColumn("last", F.col("source").isNull())
    ranked = rank_in_order(sums, ["last", "source"]).drop("last")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    wide = "decimal(38,0)"
    named = written(ranked.withColumn("weight", weight.cast("long")), "mix-sources")
    named = named.withColumn("cap", (F.lit(100 * most) * F.col("source_size")).cast(wide))  # in hundredths, as the total
    total = percent * int(named.agg(F.sum("source_size")).first()[0] or 0)
    rest, shares = total, int(named.agg(F.sum("weight")).first()[0] or 1)
    capped = F.lit(False)
    while True:
        # above the cap: weight * rest / shares > cap
        above = (F.col("weight") * F.lit(rest).cast(wide) >= F.col("cap") * F.lit(shares).cast("decimal(20,0)"))
        found = named.where(capped | above).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        everything = int(named.agg(F.sum("weight")).first()[0] or 1)
        left = total - int(found["cap"] or 0), everything - int(found["weight"] or 0)
        capped = capped | above
        if left == (rest, shares) or not left[1]:
            break
        rest, shares = left
    share = F.col("weight") * F.lit(float(rest)) / F.lit(100.0 * shares)
    target = F.when(capped, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(share)
    return written(named.select("source", "rank", "source_size", "documents", "weight", target.alias("target")), "mix-targets")


def settle_large(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> None:
    """Settles the largest documents in place while many others can make up for
    them: a step moves one of them along the balance equations and all smaller
    undecided ones a little, in proportion to a straight line in their size."""
    large = np.argsort(-size, kind="stable")[:LARGE]
    for a in large[size[large] > 2 * size.mean()]:
        for _ in range(LARGE):
            rest = np.flatnonzero((p > 0) & (p < 1) & (size < size[a]))
            s = size[rest].astype(np.float64)
            n, once, twice = len(s), s.sum(), (s * s).sum()
            spread = n * twice - once * once
            if not 0.0 < p[a] < 1.0 or n < 3 or spread <= 0:
                break
            # sum(u) = -1 and sum(u * size) = -size[a]
            slope = (once - n * float(size[a])) / spread
            u = np.append((-1 - slope * once) / n + slope * s, 1.0)
            who = np.append(rest, a)
            x, moving = p[who], np.abs(u) > 1e-15
            to_one, to_zero = (1 - x[moving]) / np.abs(u[moving]), x[moving] / np.abs(u[moving])
            rising = u[moving] > 0
            up, down = np.where(rising, to_one, to_zero).min(), np.where(rising, to_zero, to_one).min()
            x = x + (up if rng.random() * (up + down) < down else -down) * u
            p[who] = np.where(x < CLOSE, 0.0, np.where(x > 1 - CLOSE, 1.0, x))


def flight(size: list[int], p: list[float], left: int, rng: np.random.Generator) -> list[int]:
    """The sparse steps: moves ``p`` in place until at most ``left`` (2 or more) components are
    strictly between 0 and 1, keeping sum(p) and sum(p * size); the indexes of
    those left.  The first components are moved first."""
    undecided = [i for i in range(len(p)) if CLOSE < p[i] < 1 - CLOSE]
    for i, x in enumerate(p):
        if not CLOSE < x < 1 - CLOSE:
            p[i] = float(round(x))
    undecided.reverse()  # the next one is the last
    active: list[int] = []
    while len(undecided) + len(active) > left:
        while len(active) < 3 and undecided:
            active.append(undecided.pop())
        a, b, *more = active
        if size[a] == size[b]:
            moved = ((a, 1), (b, -1))
        elif not more:
            break
        else:
            c = more[0]
            g = math.gcd(size[b] - size[c], size[c] - size[a])
            moved = ((a, (size[b] - size[c]) // g), (b, (size[c] - size[a]) // g), (c, (size[a] - size[b]) // g))
            moved = tuple((j, u) for j, u in moved if u)
        up = min((1 - p[j]) / u if u > 0 else p[j] / -u for j, u in moved)
        down = min(p[j] / u if u > 0 else (1 - p[j]) / -u for j, u in moved)
        step = up if rng.random() * (up + down) < down else -down
        for j, u in moved:
            x = p[j] + step * u
            p[j] = 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x
        active = [j for j in active if 0.0 < p[j] < 1.0]
    return active + undecided


def landing(size: list[int], p: list[float], left: list[int], words: float, documents: float) -> None:
    """Settles ``left`` in place: of all subsets the one that brings the words,
    then the documents, nearest to the given totals (ties: the first subset)."""
    subsets = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    sizes = np.array([size[j] for j in left], np.float64)
    off = np.abs(subsets @ sizes - words), np.abs(subsets.sum(1) - documents)
    best = np.lexsort((np.round(off[1], 6), np.round(off[0], 6)))[0]
    for j, x in zip(left, subsets[best]):
        p[j] = float(x)


def _settle_first(table: pa.Table, seed: int) -> pa.Table:
    """The largest documents of one source (units as in ``_draw``) with ``extra``,
    and a row without copies that holds the probability of the others."""
    table = table.sort_by([("size", "descending"), ("mark", "ascending"), ("block", "ascending")])
    rank, words = table.column("rank")[0].as_py(), table.column("source_size")[0].as_py()
    target = table.column("p")[0].as_py() * words
    rng = np.random.default_rng([seed, rank])
    drawn = []
    for size, copies in zip(table.column("size").to_pylist(), table.column("n").to_pylist()):
        taken = 0
        for _ in range(copies):
            words -= size
            x = int(rng.random() * (words + size) < target)

            def off(x):  # by how much the others could not make up for it
                return max(0.0, x * size - target, target - x * size - words)
            if off(x) > off(1 - x):
                x = 1 - x
            taken += x
            target -= x * size
        drawn.append((taken, copies - taken))
    at, n, extra = zip(*[(i, n, x) for i, pair in enumerate(drawn) for x, n in zip((1, 0), pair) if n], (0, 0, 0))
    out = table.take(pa.array(at))
    left = min(max(target / words, 0.0), 1.0) if words > 0 else 0.0
    for name, values in (("n", n), ("p", [left] * len(n))):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
    return out.append_column("extra", pa.array(extra, pa.int64()))


def _drawer(seed: int, level: int):
    return lambda chunk: _draw(chunk, seed, level)


def _draw(table: pa.Table, seed: int, level: int) -> pa.Table:
    """One chunk of one source: units (rank, chunk, chunks, id, mark, size,
    block, n, p, base) -> the same with ``extra`` (0, 1 or null: undecided)."""
    table = table.sort_by([("mark", "ascending"), ("size", "ascending"), ("block", "ascending"), ("p", "ascending")])
    n, each, sizes = (table.column(c).to_pylist() for c in ("n", "p", "size"))
    unit = np.repeat(np.arange(len(n)), n)
    size = [sizes[i] for i in unit]
    rank, chunk, chunks = (table.column(c)[0].as_py() for c in ("rank", "chunk", "chunks"))
    rng, start = np.random.default_rng([seed, level, rank, chunk]), np.array(each)[unit]
    words, documents = math.fsum(start * np.array(size)), math.fsum(start)
    settle_large(np.array(size), start, rng)
    p = start.tolist()
    left = flight(size, p, LANDING if chunks == 1 else 2, rng)
    if chunks == 1:
        taken = [j for j in range(len(p)) if p[j] == 1.0]
        landing(size, p, left, words - sum(size[j] for j in taken), documents - len(taken))
        left = []
    extra = np.rint(p).astype(np.int64)
    extra[left] = -1
    rows, first, counts = np.unique(np.stack([unit, extra], 1), axis=0, return_index=True, return_counts=True)
    out = table.take(pa.array(rows[:, 0]))
    for name, values in (("n", counts), ("p", np.array(p)[first])):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(values))
    return out.append_column("extra", pa.array(rows[:, 1], mask=rows[:, 1] < 0))


def mix(df: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150,
        most: int = 2, seed: int = 42) -> DataFrame:
    """Every row of ``df`` as (id, source, size, source_size, target, copies,
    taken): ``copies`` times in the mix, ``taken`` words in all."""
    counted = written(units(df, id, text, source), "mix-units")
    goals = targets(counted, weights, percent, most).withColumnRenamed("source", "goal_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = (goals.withColumn("base", F.floor(ratio + F.lit(CLOSE)).cast("long"))
             .withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
             .withColumn("chunks", F.ceil(F.col("documents") / F.lit(float(CHUNK))).cast("long")))
    rows = counted.join(goals, counted["source"].eqNullSafe(goals["goal_source"])).drop("goal_source", "documents", "weight")
    whole, rest = F.floor(F.col("n") / BLOCK), F.pmod(F.col("n"), F.lit(BLOCK))
    blocks = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole)).otherwise(F.array(F.lit(0).cast("long")))
    rows = (rows.withColumn("block", F.explode(blocks))
            .withColumn("n", F.when(F.col("block") < whole, F.lit(BLOCK).cast("long")).otherwise(rest)).where("n > 0")
            .withColumn("mark", F.xxhash64("id", "size", "block")))
    is_large = (F.col("p") > CLOSE) & (F.col("size") * FIRST > F.col("source_size"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", extra long"
    large = written(rows.where(is_large).groupBy("rank").applyInArrow(lambda t: _settle_first(t, seed), schema), "mix-large")
    others = large.where("n = 0").select(F.col("rank").alias("of_rank"), F.col("p").alias("left"))  # a row a source
    rows = (rows.where(~is_large).join(others, F.col("rank") == F.col("of_rank"), "left")
            .withColumn("p", F.coalesce("left", "p")).drop("of_rank", "left"))
    all_same = (F.col("p") <= CLOSE) | (F.col("p") >= 1 - CLOSE)
    settled = rows.where(all_same).withColumn("extra", F.rint("p").cast("long")).drop("chunks")
    drawn = [settled, large.where("n > 0").drop("chunks")]
    # the number of chunks of the largest source tells how many levels there are
    chunks = int(goals.agg(F.max("chunks")).first()[0] or 0)
    open_ = rows.where(~all_same)
    level = 0
    while chunks:
        dealt = open_.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed + level), "mark"), F.col("chunks")))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
        done = written(dealt.groupBy("rank", "chunk").applyInArrow(_drawer(seed, level), f"{schema}, extra long"),
                       f"mix-level-{level}")
        drawn.append(done.where("extra is not null").drop("chunk", "chunks"))
        # at most two undecided rows of a chunk
        open_ = (done.where("extra is null").drop("chunk", "extra")
                 .withColumn("chunks", F.ceil(F.col("chunks") * 2 / F.lit(float(CHUNK))).cast("long")))
        chunks = math.ceil(chunks * 2 / CHUNK) if chunks > 1 else 0
        level += 1
    out = drawn[0]
    for more in drawn[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.col("extra")
    return (out.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
            .select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target",
                    copies.alias("copies"), (copies * F.col("size")).alias("taken")))
