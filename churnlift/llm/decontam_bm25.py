"""Benchmark decontamination: BM25 index of test items, block-max WAND queries.

The index holds the test items; every passage of every training text is a
query.  A passage is ``PASSAGE`` words, and the next begins half a passage on,
so an index entry (at most ``ENTRY`` words of an item) that stands in a text
stands whole in some passage.  Scores are BM25 of the passage's distinct terms,
divided by the entry's score with itself, so 1 means all terms are there.

Entries are grouped in blocks, and for each term the largest score in each
block is stored.  A block's postings are opened for a passage only if the sum
of its block maxima over the passage's words reaches the threshold (the pivot
test of WAND, made for all passages of a text at once); nothing that could
reach the threshold is skipped, and everything that does is retrieved.

A retrieved item is verified by exact overlap with the text: the item's last
quarter (``ANSWER`` words at least) counts as answer, the rest as question, and
the shares of their distinct five-word shingles found in the text must reach
``QUESTION_OVERLAP`` and ``ANSWER_OVERLAP``.

Words are runs of letters, digits and '_', in lower case.  The index is sent
out in shards of about ``SHARD`` entries.  Of several shards one at a time is
collected, sent out, looked up in a pass over the texts whose hits are written
by text digest, and dropped; so the driver and each executor hold one shard
whatever the number of items.

Results for odd input: items and texts that are null, empty or without words
match nothing; equal items are retrieved each under its id, a null item id
stays null; repeated texts get equal results; extra columns pass through,
an input column that has the output's name is replaced; texts of any length
are read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import fresh, written
from .text import WordHashes, grams

K1, B = 1.2, 0.75
ENTRY = 64
PASSAGE = 2 * ENTRY
BLOCK = 16
#: Passages whose block bounds come from one running sum; a short one keeps its rounding small.
RUN = 256
SHARD = 1024
THRESHOLD = 0.6
SHINGLE = 5
ANSWER = 7
QUESTION_OVERLAP = 0.8
ANSWER_OVERLAP = 0.5

WORD = re.compile(r"\w+")


def words_of(text) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def entries_of(n_words: int) -> list[tuple[int, int]]:
    """Word ranges of an item's entries: ``ENTRY`` words each, the last one whole too."""
    if n_words <= ENTRY:
        return [(0, n_words)] if n_words else []
    return [(min(i, n_words - ENTRY), min(i, n_words - ENTRY) + ENTRY) for i in range(0, n_words, ENTRY)]


def shingle_set(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Distinct five-word shingles; fewer words are one shingle of their own length."""
    h = hashes.of([w.encode() for w in words])
    return np.unique(grams(h, min(SHINGLE, len(h)))) if len(h) else h


def question_and_answer(words: list[str]) -> tuple[list[str], list[str]]:
    """The item's words before its answer, and the answer; a short item is both."""
    size = max(ANSWER, len(words) // 4)
    if len(words) < size + SHINGLE:
        return words, words
    return words[:-size], words[-size:]


class Index:
    """One shard: postings by term with scores, block maxima, and the items' shingles."""

    def __init__(self, entries: list[tuple[int, list[tuple[str, float]]]], items: dict[int, list[str]]):
        """entries: (item number, [(term, score)]); items: words by item number."""
        terms = sorted({t for _, post in entries for t, _ in post})
        self.terms = {t: i for i, t in enumerate(terms)}
        rows = sorted((self.terms[t], e, s) for e, (_, post) in enumerate(entries) for t, s in post)
        self.entry = np.array([e for _, e, _ in rows], np.int64)
        self.score = np.array([s for _, _, s in rows], np.float64)
        term = np.array([t for t, _, _ in rows], np.int64)
        self.first = np.searchsorted(term, np.arange(len(terms) + 1))
        self.item = np.array([i for i, _ in entries], np.int64)
        self.n_blocks = -(-len(entries) // BLOCK)
        self.block_max = np.zeros((len(terms), self.n_blocks), np.float32)
        np.maximum.at(self.block_max, (term, self.entry // BLOCK), self.score.astype(np.float32))
        hashes = WordHashes()
        self.overlaps = {}
        for i, words in items.items():
            q, a = question_and_answer(words)
            self.overlaps[i] = (shingle_set(q, hashes), shingle_set(a, hashes), min(SHINGLE, len(q)), min(SHINGLE, len(a)))

    def retrieve(self, words: list[str], threshold: float) -> dict[int, float]:
        """Best score of every item with an entry above the threshold in any passage."""
        ids = np.fromiter((self.terms.get(w, -1) for w in words), np.int64, len(words))
        place = np.flatnonzero(ids >= 0)
        if not len(place):
            return {}
        ids = ids[place]
        starts = np.arange(0, max(1, len(words) - ENTRY), PASSAGE - ENTRY)
        low, high = np.searchsorted(place, starts), np.searchsorted(place, starts + PASSAGE)
        best: dict[int, float] = {}
        for at in range(0, len(starts), RUN):  # bounds the sums of very long texts
            a, b = low[at:at + RUN], high[at:at + RUN]
            base = a[0]
            sums = np.zeros((b[-1] - base + 1, self.n_blocks), np.float32)
            np.cumsum(self.block_max[ids[base:b[-1]]], axis=0, out=sums[1:])
            bound = sums[b - base] - sums[a - base]
            # each of the passage's additions errs by half a unit of the running
            # single-precision sum at most; 1e-3 covers the rounded block maxima
            open_blocks = bound >= threshold - 1e-3 - PASSAGE * 2.0 ** -24 * sums[-1]
            for p in np.flatnonzero(open_blocks.any(axis=1)):
                terms = np.unique(ids[a[p]:b[p]])
                n = self.first[terms + 1] - self.first[terms]
                post = np.repeat(self.first[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
                post = post[open_blocks[p][self.entry[post] // BLOCK]]
                total = np.bincount(self.entry[post], self.score[post], len(self.item))
                for e in np.flatnonzero(total >= threshold):
                    i = int(self.item[e])
                    best[i] = max(best.get(i, 0.0), float(total[e]))
        return best

    def hits(self, words: list[str], hashes: WordHashes, threshold: float) -> list[tuple[int, float, float, float]]:
        """(item number, score, question overlap, answer overlap) of the verified items."""
        found = self.retrieve(words, threshold)
        if not found:
            return []
        h = hashes.of([w.encode() for w in words])
        held = {n: grams(h, n) for n in range(1, SHINGLE + 1)}
        out = []
        for i, score in sorted(found.items()):
            q, a, n_q, n_a = self.overlaps[i]
            in_q, in_a = float(np.isin(q, held[n_q]).mean()), float(np.isin(a, held[n_a]).mean())
            if in_q >= QUESTION_OVERLAP and in_a >= ANSWER_OVERLAP:
                out.append((i, score, in_q, in_a))
        return out


def build_index(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame | None, int]:
    """Postings of all entries with their shard, and the number of shards.
    Counts and BM25 scores are computed by Spark; items are dealt by hash to
    shards of about ``SHARD`` entries.  No entries give no table."""
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in texts], dtype=object)

    @F.pandas_udf("array<array<string>>")
    def cut(lists: pd.Series) -> pd.Series:
        return pd.Series([[list(w[a:b]) for a, b in entries_of(len(w))] for w in lists], dtype=object)

    words = (items.select(F.col(item_id).cast("long").alias("id"), split(F.col(text)).alias("words"))
             .where(F.size("words") > 0))
    # equal (id, words) rows are one item; items of one id with other words stay apart
    words = words.distinct().withColumn("item", F.xxhash64("id", "words"))
    words = written(words, "items")
    entries = words.select("item", F.posexplode(cut("words")).alias("part", "entry_words"))
    sizes = entries.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("entry_words")).alias("mean")).first()
    if not sizes["n"]:
        return None, 0
    counts = (entries.select("item", "part", F.size("entry_words").alias("length"), F.explode("entry_words").alias("term"))
              .groupBy("item", "part", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    seen = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(sizes["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(sizes["mean"])))
    scored = counts.join(seen, "term").withColumn("s", idf * saturated)
    whole = Window.partitionBy("item", "part")
    posts = (scored.withColumn("s", F.col("s") / F.sum("s").over(whole))
             .groupBy("item", "part").agg(F.array_sort(F.collect_list(F.struct("term", "s"))).alias("posts"))
             .join(words, "item"))
    n_shards = -(-sizes["n"] // SHARD)
    return written(posts.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "item"), F.lit(n_shards))), "postings"), n_shards


def collected(posts: DataFrame, shard: int) -> tuple[Index, dict[int, int]] | None:
    """(index, item id by number) of one shard."""
    rows = posts.where(F.col("shard") == shard).orderBy("item", "part").collect()
    if not rows:
        return None
    entries = [(r["item"], [(p["term"], p["s"]) for p in r["posts"]]) for r in rows]
    return Index(entries, {r["item"]: list(r["words"]) for r in rows}), {r["item"]: r["id"] for r in rows}


HITS = "array<struct<item_id:long,score:double,question:double,answer:double>>"


def _lookup(sent, threshold: float):
    @F.pandas_udf(HITS)
    def lookup(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index, ids = sent.value
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([[{"item_id": ids[i], "score": s, "question": q, "answer": a}
                              for i, s, q, a in index.hits(words_of(t), hashes, threshold)] for t in texts], dtype=object)

    return lookup


def find(df: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, out: str = "hits",
         threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the verified items of every whole text in ``out``.  With
    several shards ``df`` is read once for each."""
    sc = df.sparkSession.sparkContext
    posts, n_shards = build_index(items, item_id, item_text)
    if not n_shards:
        return df.withColumn(out, F.array().cast(HITS))
    if n_shards == 1:
        return df.withColumn(out, _lookup(sc.broadcast(collected(posts, 0)), threshold)(F.col(text)))
    key, found = fresh(df, "key"), fresh(df, "found")
    texts = df.select(F.md5(F.col(text)).alias(key), F.col(text).alias("text")).where(F.col("text").isNotNull())
    parts = []
    for k in range(n_shards):
        shard = collected(posts, k)
        if shard is None:
            continue
        sent = sc.broadcast(shard)
        del shard
        hits = texts.select(key, _lookup(sent, threshold)("text").alias("hits")).where(F.size("hits") > 0)
        parts.append(written(hits.groupBy(key).agg(F.first("hits").alias("hits")).withColumn("shard", F.lit(k)), "hits"))
        sent.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("shard", "hits")))["hits"].alias(found))
    return (df.join(every, F.md5(F.col(text)) == F.col(key), "left")
            .withColumn(out, F.coalesce(F.flatten(found), F.array().cast(HITS))).drop(key, found))


def keep_clean(df: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The rows of ``df`` without a verified item, columns unchanged."""
    tmp = fresh(df, "hits")
    return find(df, text, items, item_id, item_text, tmp).where(F.size(F.col(tmp)) == 0).drop(tmp)
