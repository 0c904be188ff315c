"""N-gram Jaccard self-join by size-banded tiles with bitmap signatures.

Texts become sets of word-shingle hashes; equal sets form one class.  Classes
fall into size bands, and a band's sets are cut by hash range into parts, more
parts than the largest symmetric difference that two linked sets of the band
can have.  So two linked sets agree entirely in at least one part: a *tile* is
(band, part, content of the part), and only classes that meet in a tile are
compared.  A class also joins the tiles of the next band when a partner may
lie there.

Tiles of the same classes count once.  Inside a tile every class is compared
with the hub (the class that shares most tiles).  Classes that the hub's
component holds then drop out, and after ``STAR_ROUNDS`` rounds of hubs what
is still apart is compared in blocks.  A comparison first bounds the overlap from above by bit
counts of hashed bitmaps (each bit set on one side only is a shingle missing on
the other), then intersects the sorted arrays.

Nothing is dropped or capped: a pair is left out only when it shares no part
(then it cannot reach the threshold) or is already in one component.

Results for odd input: null or empty text, or text without words, has no
shingles and is linked with nothing; a text shorter than a shingle is one
shingle; equal texts and repeated rows are linked; a null id takes part in its
class but names no component, unless all ids of the component are null (then
the component is null); ids of any type, whole beside a null; texts of any
length are read whole, one at a time; an empty table gives an empty one.  ``join``
reads the two columns named only; ``keep_one`` keeps of rows equal in id and
text the one whose other columns come first in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .storage import written
from .text import WordHashes, mix, shingles, utf8

#: Size ratio of neighbouring bands.
BAND = 1.5
STAR_ROUNDS = 1
#: Members of one side of a block comparison.
BLOCK = 512
SEEN_CLASSES = 200_000
#: Rows (two longs each) up to which a key list is broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 1_000_000

_U = np.uint64


class Rule:
    """Links sets with 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, common: int, a: int, b: int) -> bool:
        return 100 * common >= self.percent * (a + b - common)

    def differences(self, total: int) -> int:
        """Largest symmetric difference of linked sets with ``total`` members together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent


@lru_cache(maxsize=None)
def band_edge(i: int) -> int:
    """Smallest set size of band i."""
    size = 1
    for _ in range(i):
        size = max(size + 1, math.ceil(size * BAND))
    return size


@lru_cache(maxsize=100_000)
def band_of(size: int) -> int:
    i = 0
    while band_edge(i + 1) <= size:
        i += 1
    return i


@lru_cache(maxsize=None)
def parts_of(band: int, percent: int) -> tuple[int, int]:
    """Number of parts of a band's sets, and the empty parts a set may have
    before its empty parts are tiles too.

    Linked sets differ in at most ``differences`` parts, so at least
    ``slack + 1`` parts are equal; if one of the sets has at most ``slack``
    empty parts, an equal part with content exists.
    """
    rule = Rule(percent)
    least = max(1, band_edge(band) * percent // 100)
    need = rule.differences(2 * (band_edge(band + 1) - 1))
    slack = 0
    for _ in range(20):
        parts = need + 1 + slack
        empty = parts * math.exp(-least / parts)
        slack = math.ceil(empty + 3 * math.sqrt(empty))
    return need + 1 + slack, slack


@lru_cache(maxsize=256)
def _hash_ranges(parts: int) -> np.ndarray:
    """Inner edges of equal ranges of the 64-bit hashes."""
    return np.array([(i << 64) // parts for i in range(1, parts)], _U)


def tiles(arr: np.ndarray, percent: int) -> np.ndarray:
    """Tile keys of a sorted shingle set."""
    size = len(arr)
    if Rule(percent).differences(2 * Rule(percent).largest_partner(size)) == 0:
        return np.empty(0, np.int64)  # linked with equal sets only
    first = band_of(size)
    last = band_of(Rule(percent).largest_partner(size))
    content = mix(arr)
    out = []
    for band in range(first, last + 1):
        parts, slack = parts_of(band, percent)
        # parts by hash range: the sorted array is already grouped
        cut = np.searchsorted(arr, _hash_ranges(parts))
        edge = np.concatenate(([0], cut, [size]))
        total = np.concatenate((np.zeros(1, _U), np.cumsum(content, dtype=_U)))
        value = total[edge[1:]] - total[edge[:-1]]
        count = np.diff(edge)
        key = mix(mix(value + _U(band * 0x9E3779B9)) + np.arange(parts, dtype=_U) * _U(0xD6E8FEB86659FD93) + count.astype(_U))
        out.append(key if (count == 0).sum() > slack else key[count > 0])
    return np.concatenate(out).view(np.int64)


def bitmap(arr: np.ndarray) -> bytes:
    """Hashed bitmap of at least four bits a shingle, a power of two wide."""
    width = max(64, 1 << (4 * len(arr) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(mix(arr) % _U(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Both bitmaps at the smaller width (bit = hash modulo width, so halves OR)."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return x, y


def overlap_bound(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """Upper bound of the intersection from bit counts."""
    x, y = _fold(a, b)
    return min(size_a - int(np.bitwise_count(x & ~y).sum()), size_b - int(np.bitwise_count(y & ~x).sum()))


SETS = "id string, text_key long, size int, cls long, check long, bitmap binary, tiles array<long>"


def set_table(df: DataFrame, id_col: str, text: str, words: int, percent: int) -> DataFrame:
    """One row a text: size of its set, class (64 bits, 64 more to check it),
    bitmap and tile keys.  Copies met by one task carry the last two once (it
    forgets after ``SEEN_CLASSES`` classes, which costs repeated rows only)."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            out = []
            if len(seen) > SEEN_CLASSES:
                seen.clear()
            for i, key, t in zip(batch["id"], batch["text_key"], batch["text"]):
                arr = shingles(hashes.of(utf8(t).translate(LOWER).split()), words)
                if not len(arr):
                    out.append((i, key, 0, None, None, None, None))
                    continue
                both = xxhash.xxh3_128_intdigest(arr.tobytes())
                cls, check = np.array([both >> 64, both & (1 << 64) - 1], _U).view(np.int64)
                new = both not in seen
                seen.add(both)
                out.append((i, key, len(arr), int(cls), int(check), bitmap(arr) if new else None,
                            tiles(arr, percent) if new else None))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in SETS.split(", ")], dtype=object)
            yield frame

    # ids cross Python as text: a null among them would turn numbers into doubles
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text)).alias("text_key"),
                     F.col(text).alias("text"))
    return rows.mapInPandas(build, SETS).withColumn("id", F.col("id").cast(df.schema[id_col].dataType))


def one_class_each(sets: DataFrame) -> DataFrame:
    """``sets`` with a class of its own for every set: where different sets
    share the first 64 bits of their digest, all but one are renamed by both
    halves.  Few are (n*n / 2**65 of n sets), so the join broadcasts their list."""
    shared = sets.where("cls is not null").groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = written(shared.where("low != high").select("cls", "low"), "shared-classes")
    own = F.when(F.col("check") != F.col("low"), F.xxhash64("cls", "check")).otherwise(F.col("cls"))
    return sets.join(shared, "cls", "left").withColumn("cls", own).drop("low", "check")


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _joined(big: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Join with a key list: broadcast only if counted small, else by shuffle."""
    small = keys.count() <= BROADCAST_ROWS
    return big.join(F.broadcast(keys) if small else keys, on)


class _Verifier:
    """Exact check of class pairs: bitmaps first, then the arrays."""

    def __init__(self, df, id_col, text, words, percent, classes):
        self.rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("text_key"),
                              F.col(text).alias("text"))
        self.words, self.percent, self.classes = words, percent, classes

    def arrays(self, wanted: DataFrame) -> DataFrame:
        """(cls, arr) of the classes ``wanted`` (cls), made anew from one text of each."""
        words = self.words

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()
            for batch in batches:
                yield pd.DataFrame({"cls": batch["cls"], "arr": [
                    shingles(hashes.of(utf8(t).translate(LOWER).split()), words).tobytes() for t in batch["text"]]})

        where = written(self.classes.join(wanted, "cls")
                        .select("cls", F.col("id").alias("rep"), F.col("text_key").alias("rep_key")), "reps")
        same = self.rows["id"].eqNullSafe(where["rep"]) & (self.rows["text_key"] == where["rep_key"])
        texts = _joined(self.rows, where, same).select("cls", "text")
        return texts.mapInPandas(build, "cls long, arr binary").dropDuplicates(["cls"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of the class pairs (a, b)."""
        percent = self.percent

        @F.pandas_udf("boolean")
        def may_link(x: pd.Series, y: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
            rule = Rule(percent)
            return pd.Series([rule.linked(overlap_bound(*q), q[2], q[3]) for q in zip(x, y, m, n)], dtype=bool)

        @F.pandas_udf("boolean")
        def do_link(x: pd.Series, y: pd.Series) -> pd.Series:
            rule, out = Rule(percent), []
            for a, b in zip(x, y):
                a, b = np.frombuffer(a, _U), np.frombuffer(b, _U)
                out.append(rule.linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            return pd.Series(out, dtype=bool)

        left = self.classes.select(F.col("cls").alias("a"), F.col("bitmap").alias("x"), F.col("size").alias("m"))
        right = self.classes.select(F.col("cls").alias("b"), F.col("bitmap").alias("y"), F.col("size").alias("n"))
        near = written(pairs.join(right, "b").join(left, "a").where(may_link("x", "y", "m", "n")).select("a", "b"), "near")
        # both sides join the same arrays by class, so one exchange of them serves both
        arrays = self.arrays(near.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        full = (near.join(arrays.select(F.col("cls").alias("b"), F.col("arr").alias("y")), "b")
                .join(arrays.select(F.col("cls").alias("a"), F.col("arr").alias("x")), "a"))
        return written(full.where(do_link("x", "y")).select("a", "b"), "links")


def _compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs within each group of ``rows`` (sorted by group) with different
    roots, of different blocks unless the group is one block, whose bitmaps
    allow a link.  Row i meets row i + 1, i + 2, ... of its group; all groups
    take the same step at once."""
    key = rows[["tile", "i", "j"]].to_numpy()
    new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
    length = np.diff(np.append(new, len(rows)))
    group = np.repeat(np.arange(len(new)), length)
    left = np.repeat(new + length, length) - np.arange(len(rows))  # rows to the group's end, this one included
    words = rows["bitmap"].str.len().to_numpy() // 8
    width = np.minimum.reduceat(words, new)[group]
    cls, root, block = (rows[c].to_numpy() for c in ("cls", "root", "block"))
    size, one = rows["size"].to_numpy().astype(np.int64), (rows["i"] == rows["j"]).to_numpy()
    out = []
    for w in np.unique(width):
        at = np.flatnonzero(width == w)  # whole groups, in order
        bits = np.stack([_folded(x, w) for x in rows["bitmap"].iloc[at]])
        n, r, c, k, rest, alone = size[at], root[at], cls[at], block[at], left[at], one[at]
        p, step = np.arange(len(at)), 1
        while len(p := p[rest[p] > step]):
            a = p[(r[p] != r[p + step]) & (alone[p] | (k[p] != k[p + step]))]
            b = a + step
            common = np.minimum(n[a] - np.bitwise_count(bits[a] & ~bits[b]).sum(axis=1, dtype=np.int64),
                                n[b] - np.bitwise_count(bits[b] & ~bits[a]).sum(axis=1, dtype=np.int64))
            may = 100 * common >= percent * (n[a] + n[b] - common)
            out.append(np.stack([c[a[may]], c[b[may]]], 1))
            step += 1
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).drop_duplicates()


def _folded(bitmap: bytes, words: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) > words:
        x = x[:len(x) // 2] | x[len(x) // 2:]
    return x


def _blocks(rest: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one tile and different components whose bitmaps allow a
    link: members in blocks of ``BLOCK``, each pair of blocks one group of at
    most two blocks."""
    row = F.row_number().over(Window.partitionBy("tile").orderBy("rank"))
    last = F.max("block").over(Window.partitionBy("tile"))
    dealt = (rest.withColumn("block", F.floor((row - 1) / F.lit(BLOCK)).cast("int")).withColumn("last", last)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
             .select("tile", "cls", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
             .join(classes.select("cls", "size", "bitmap"), "cls")
             .repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < 8 * BLOCK:
                continue
            rows = pd.concat(held, ignore_index=True)
            # the last group may go on in the next batch
            waits = (rows[["tile", "i", "j"]] == rows[["tile", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            if not waits.all():
                yield _compare(rows[~waits].reset_index(drop=True), percent)
            held = [rows[waits]]
        if held:
            yield _compare(pd.concat(held, ignore_index=True), percent)

    return dealt.select("tile", "i", "j", "cls", "root", "block", "size", "bitmap").mapInPandas(compare, "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text: str, words: int, percent: int) -> DataFrame:
    """(id, text_key, size, root) of every row; ``root`` names the component
    (null without words)."""
    sets = one_class_each(written(set_table(df, id_col, text, words, percent), "sets"))
    same = Window.partitionBy("tile")
    # a tile is renamed after its members: equal tiles merge, and a chance merge only adds comparisons
    met = (sets.where("tiles is not null").select(F.explode("tiles").alias("tile"), "cls")
           .withColumn("low", F.min("cls").over(same)).withColumn("high", F.max("cls").over(same)).where("low != high")
           .withColumn("all", F.bit_xor(F.xxhash64("cls")).over(same))
           .select(F.xxhash64("all", "low", "high").alias("tile"), "cls").distinct())
    met = written(met, "tiles")
    classes = written(
        sets.join(met.select("cls").distinct(), "cls").groupBy("cls")
        .agg(F.min(F.struct("id", "text_key")).alias("rep"), F.first("size").alias("size"), F.max("bitmap").alias("bitmap"))
        .select("cls", "rep.id", "rep.text_key", "size", "bitmap"), "classes")
    verifier = _Verifier(df, id_col, text, words, percent, classes)
    score = met.withColumn("n", F.count(F.lit(1)).over(same)).groupBy("cls").agg(F.sum("n").alias("score"))
    best_first = same.orderBy(F.desc("score"), "cls")
    members = written(met.join(score, "cls").select("tile", "cls", F.row_number().over(best_first).alias("rank")), "members")
    spark = df.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(1, STAR_ROUNDS + 2):
        rest = (members.where(F.col("rank") >= turn).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                .withColumn("root", F.coalesce("root", "cls"))
                .withColumn("low", F.min("root").over(same)).withColumn("high", F.max("root").over(same))
                .where("low != high"))
        if turn <= STAR_ROUNDS:
            hub = F.min_by(F.struct("cls", "root"), "rank").over(same)
            pairs = (rest.withColumn("hub", hub).where(F.col("hub.root") != F.col("root"))
                     .select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct())
        else:
            pairs = _blocks(rest, classes, percent)
        pairs = written(pairs, "pairs")
        if not pairs.count():
            break  # a hub has a partner in every tile that is left: none is
        links = links.unionByName(verifier.links(pairs))
        roots = components(links)
    return (sets.select("id", "text_key", "size", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
            .select("id", "text_key", "size", F.coalesce("root", "cls").alias("root")))


def join(df: DataFrame, id_col: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """(id, size, component) of every row: number of distinct shingles, and the
    smallest id of the texts reachable by links."""
    rows = _grouped(df, id_col, text, words, percent)
    smallest = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("low"))
    return (rows.join(smallest, "root", "left")
            .select("id", "size", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component")))


def keep_one(df: DataFrame, id_col: str, text: str, words: int = 5, percent: int = 80) -> DataFrame:
    """``df`` with one row of each group of linked texts (the smallest id, a
    null id last); rows without words all stay."""
    rows = _grouped(df, id_col, text, words, percent).where("root is not null")
    pairs = written(rows.groupBy("root", "id", "text_key").agg(F.count(F.lit(1)).alias("n")), "pairs")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")
    chosen = pairs.groupBy("root").agg(F.min(order).alias("best"))
    told = (pairs.join(chosen, "root")
            .select(F.col("id").alias("drop_id"), F.col("text_key").alias("drop_key"), "n",
                    (order == F.col("best")).alias("stays")))
    told = written(told.where("not stays or n > 1"), "dropped")

    def matched(part: DataFrame, how: str) -> DataFrame:
        small = part.count() <= BROADCAST_ROWS
        same = df[id_col].eqNullSafe(part["drop_id"]) & (F.xxhash64(df[text]) == part["drop_key"])
        return df.join(F.broadcast(part) if small else part, same, how)

    # rows that stay but stand there repeatedly are cut to one
    again = told.where("stays").select("drop_id", "drop_key")
    repeated = matched(again, "left_semi")
    others = [c for c in df.columns if c not in (id_col, text)]
    first = F.min(F.struct(*others)) if others else F.count(F.lit(1))
    one = repeated.groupBy(id_col, text).agg(first.alias("_others"))
    one = one.select(id_col, text, *(["_others.*"] if others else [])).select(*df.columns)
    return matched(told.select("drop_id", "drop_key"), "left_anti").unionByName(one)
