"""Removal of repeated word windows with a count-min prefilter.

A window is ``width`` consecutive words of one text.  Pass 1 counts windows in
a sketch: every window is counted under its *anchor*, the smallest hash among
its ``GRAM``-word runs.  Equal windows have equal anchors at equal offsets, so
an anchor's number of places is never below the count of any of its windows,
and consecutive windows share one anchor, so a text gives one count per
anchor place instead of one per word.  Partitions emit sparse counters of a
count-min sketch; the counters are added, and the cells that reach 2 form a
bit set that is broadcast.  The number of cells follows from the bytes of the
texts, so that a row has about ``SPARE`` cells for each anchor, up to
``MOST_CELLS`` (the broadcast bound; from about 12 GB of text on, the sketch fills
and sends more windows on).

Pass 2 looks every anchor up.  Only windows whose anchor is estimated repeated
in all sketch rows go on, as one row per anchor place with the hashes of its
windows.  Repeats inside one batch are settled there (one row goes on for all
of them, so a passage shared by a third of all texts costs one row a batch);
the rest is grouped exactly by window, rows of one anchor together.  Anchors of
more than ``HOT_ROWS`` rows are taken apart: their windows are counted one by one
by (anchor, window), so that no anchor is one task's.  A fuller sketch sends
more windows to the exact step and loses none.

Texts of any length are read whole, one at a time.  Results for odd input: null or empty text has no words; texts below ``width``
words lose nothing; equal texts of ``width`` words or more repeat each other
and lose all; a repeated row counts as another text.  Only the two columns
named are read, so other columns cannot clash; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .text import WordHashes, covered, grams, mix, runs, utf8

GRAM = 8
#: Sketch rows; the broadcast bit set is ROWS * cells / 8 bytes, 128 MB at most.
ROWS = 2
MOST_CELLS = 1 << 29
#: Cells of a row for each anchor, and bytes of text that hold one anchor on average.
SPARE = 8
BYTES_PER_ANCHOR = 85
#: Rows of one anchor that the exact step holds together.
HOT_ROWS = 20_000
#: Cells of one sketch segment (64 KB of bits).
SEGMENT = 1 << 19

_U = np.uint64


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash and place of each run of windows that share one, and the
    run's first and last window start."""
    n = len(h) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return np.empty(0, _U), none, none, none
    g = grams(h, GRAM)
    view = sliding_window_view(g, width - GRAM + 1)
    place = np.arange(n) + view.argmin(axis=1)  # leftmost of equal hashes
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [n])) - 1
    return g[place[first]], place[first], first, last


def cells_of(anchor: np.ndarray, row: int, cells: int) -> np.ndarray:
    """Sketch cell of each anchor in one sketch row."""
    return mix(anchor + _U(row + 1)) % _U(cells)


def _partition_sketch(batches: Iterator[pd.DataFrame], width: int, cells: int) -> Iterator[pd.DataFrame]:
    """Sparse counters of the partition's anchors, by segment; counts stop at 2."""
    hashes = WordHashes()
    held, size = [], 0

    def counters() -> pd.DataFrame:
        found = np.concatenate(held) if held else np.empty(0, _U)
        out = []
        for row in range(ROWS):
            cell, count = np.unique(cells_of(found, row, cells), return_counts=True)
            segment = cell // _U(SEGMENT)
            for a, b in zip(*_groups(segment)):
                out.append((row, int(segment[a]), (cell[a:b] % _U(SEGMENT)).astype(np.uint32).tobytes(),
                            np.minimum(count[a:b], 2).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["row", "segment", "cells", "counts"])

    for batch in batches:
        for t in batch["text"]:
            held.append(anchors(hashes.of(utf8(t).split()), width)[0])
            size += len(held[-1])
        if size > 4_000_000:
            yield counters()
            held, size = [], 0
    yield counters()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(keys):
        none = np.empty(0, np.int64)
        return none, none
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return first, np.concatenate((first[1:], [len(keys)]))


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Add one segment's counters; keep the cells that reach 2 as bits."""
    total = np.zeros(SEGMENT, np.uint8)
    for cells, counts in zip(group["cells"], group["counts"]):
        at = np.frombuffer(cells, np.uint32)
        total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    return pd.DataFrame({"row": [group["row"].iloc[0]], "segment": [group["segment"].iloc[0]],
                         "bits": [np.packbits(total >= 2).tobytes()]})


def cells_for(texts: DataFrame) -> int:
    """Cells of a sketch row by the bytes of the texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = SPARE * size // BYTES_PER_ANCHOR
    return min(MOST_CELLS, max(SEGMENT, 1 << max(0, wanted - 1).bit_length()))


def sketch(texts: DataFrame, width: int, cells: int) -> np.ndarray:
    """Bits [row, cell / 8] of the cells counted twice or more.

    What comes to the driver is the merged bit set: ROWS * cells / 8 bytes at
    most, whatever the input.  ``cells`` is a multiple of ``SEGMENT``.
    """
    parts = texts.mapInPandas(lambda it: _partition_sketch(it, width, cells), "row int, segment int, cells binary, counts binary")
    merged = parts.groupBy("row", "segment").applyInPandas(_merge, "row int, segment int, bits binary")
    bits = np.zeros((ROWS, cells // 8), np.uint8)
    step = SEGMENT // 8
    for r in merged.collect():
        bits[r["row"], r["segment"] * step:(r["segment"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _estimated_repeated(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for row in range(ROWS):
        cell = cells_of(anchor, row, 8 * bits.shape[1])
        out &= (bits[row][(cell >> _U(3)).astype(np.int64)] >> (7 - (cell & _U(7)).astype(np.uint8))) & 1 == 1
    return out


SETTLED, OPEN, WITNESS = 0, 1, 2


def _candidates(batches: Iterator[pd.DataFrame], width: int, bits: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (kind, anchor, key, first, hashes) of windows estimated repeated.

    Windows that occur twice within the batch are settled: each place gives a
    SETTLED row (first and length of a run), and one WITNESS row tells other
    batches.  Windows met once give OPEN rows.
    """
    hashes = WordHashes()
    for batch in batches:
        keys: list[bytes] = []
        copied: dict[bytes, int] = {}
        window, place, owner, anchor, text_of = [], [], [], [], []
        copies, hits = [], 0
        for key, t in zip(batch["key"], batch["text"]):
            if key in copied:  # an equal text stood in this batch: it repeats as a whole
                copies.append(copied[key])
                continue
            copied[key] = len(keys)
            keys.append(key)
            h = hashes.of(utf8(t).split())
            a, _, first, last = anchors(h, width)
            hit = _estimated_repeated(bits, a)
            if hit.any():
                at = np.flatnonzero(np.repeat(hit, last - first + 1))
                window.append(grams(h, width)[at])
                place.append(at)
                owner.append(np.repeat(np.arange(hits, hits + hit.sum()), (last - first + 1)[hit]))
                anchor.append(a[hit])
                text_of.append(np.full(hit.sum(), len(keys) - 1))
                hits += hit.sum()
        if not hits:
            continue
        window, place, owner = np.concatenate(window), np.concatenate(place), np.concatenate(owner)
        anchor, text_of = np.concatenate(anchor).view(np.int64), np.concatenate(text_of)
        _, leaders, back, count = np.unique(window, return_index=True, return_inverse=True, return_counts=True)
        twice = (count[back] > 1) | np.isin(text_of, copies)[owner]
        lead = np.zeros(len(window), bool)
        lead[leaders] = True
        data = window.tobytes()
        out = []
        for kind, mask in ((SETTLED, twice), (OPEN, ~twice), (WITNESS, twice & lead)):
            at = np.flatnonzero(mask)
            if len(at):
                new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner[at]) != 0)))
                start = at[new]
                size = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
                out.append(pd.DataFrame({
                    "kind": kind, "anchor": anchor[owner[start]], "first": place[start], "size": size,
                    "key": [None if kind == WITNESS else keys[i] for i in text_of[owner[start]]],
                    "windows": [b"" if kind == SETTLED else data[8 * i:8 * (i + n)] for i, n in zip(start, size)]}))
        yield pd.concat(out)[["kind", "anchor", "key", "first", "size", "windows"]]


def _exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor: (key, first, size) of the OPEN windows found twice.

    Equal windows have equal anchors, so a group is whole once the next anchor
    begins; the last group of a batch waits for the next batch.
    """
    held: list[pd.DataFrame] = []

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"key": [], "first": [], "size": []})
        size = rows["size"].to_numpy()
        flat = np.frombuffer(b"".join(rows["windows"]), _U)
        owner = np.repeat(np.arange(len(rows)), size)
        # within an anchor a window is judged by its own 64-bit hash; so is a batch's repeat
        pair = np.stack([np.repeat(rows["anchor"].to_numpy().astype(np.uint64), size), flat], 1)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        same = (pair[order][1:] == pair[order][:-1]).all(axis=1)
        repeated = np.zeros(len(flat), bool)
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        repeated &= (rows["kind"].to_numpy() == OPEN)[owner]
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        start = rows["first"].to_numpy()[owner] + offset
        step = np.flatnonzero(repeated)
        if not len(step):
            return pd.DataFrame({"key": [], "first": [], "size": []})
        new = np.concatenate(([True], (np.diff(step) != 1) | (np.diff(owner[step]) != 0)))
        begin = step[new]
        length = np.diff(np.concatenate((np.flatnonzero(new), [len(step)])))
        return pd.DataFrame({"key": rows["key"].to_numpy()[owner[begin]], "first": start[begin], "size": length})

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if batch["anchor"].iloc[0] == batch["anchor"].iloc[-1] and len(held) > 1 and \
                held[0]["anchor"].iloc[0] == batch["anchor"].iloc[-1]:
            continue
        rows = pd.concat(held)
        waits = (rows["anchor"] == rows["anchor"].iloc[-1]).to_numpy()
        yield settle(rows[~waits])
        held = [rows[waits]]
    if held:
        yield settle(pd.concat(held))


def _taken_apart(rows: DataFrame) -> DataFrame:
    """(key, first, size) of the OPEN windows of hot anchors that are found
    twice: windows become rows, counted by (anchor, window)."""
    @F.pandas_udf("array<long>")
    def hashes(windows: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(w, np.int64) for w in windows], dtype=object)

    one = rows.select("kind", "anchor", "key", "first", F.posexplode(hashes("windows")).alias("at", "window"))
    twice = one.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    return (one.where(F.col("kind") == OPEN).join(written(twice, "hot-windows"), ["anchor", "window"])
            .select("key", (F.col("first") + F.col("at")).cast("int").alias("first"), F.lit(1).alias("size")))


def repeated_ranges(df: DataFrame, text: str, width: int = 35, cells: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, firsts, sizes) of the texts with repeated windows: ``key`` is the
    text's md5; runs of repeated window starts by first start and length."""
    texts = df.select(F.unhex(F.md5(F.col(text))).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    bits = df.sparkSession.sparkContext.broadcast(sketch(texts.select("text"), width, cells or cells_for(texts)))
    found = texts.mapInPandas(lambda it: _candidates(it, width, bits.value),
                              "kind int, anchor long, key binary, first int, size int, windows binary")
    found = written(found, "windows")
    unsettled = found.where(F.col("kind") != SETTLED)
    hot = written(unsettled.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("anchor"), "hot-anchors")
    exact = (unsettled.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
             .select("kind", "anchor", "key", "first", "size", "windows").mapInPandas(_exact, "key binary, first int, size int"))
    apart = _taken_apart(unsettled.join(hot, "anchor"))
    ranges = found.where(F.col("kind") == SETTLED).select("key", "first", "size").unionByName(exact).unionByName(apart)
    return (ranges.distinct().groupBy("key")
            .agg(F.collect_list(F.struct("first", "size")).alias("r"))
            .select("key", F.col("r")["first"].alias("firsts"), F.col("r")["size"].alias("sizes")))


def keep_unrepeated(words: list[bytes], firsts, sizes, width: int) -> list[bytes]:
    """The words that no repeated window covers."""
    if firsts is None or not len(firsts):
        return words
    starts = np.concatenate([np.arange(f, f + n) for f, n in zip(firsts, sizes)])
    gone = covered(starts, width, len(words))
    return [w for w, g in zip(words, gone) if not g]


def remove_repeats(df: DataFrame, id_col: str, text: str, width: int = 35, cells: int | None = None,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id_col, n_words, n_removed, kept): every text without the words that a
    repeated window covers, joined by single spaces."""
    ranges = written(repeated_ranges(df, text, width, cells, hot_rows), "ranges")

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def rest(texts: pd.Series, firsts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for t, f, s in zip(texts, firsts, sizes):
            words = utf8(t).split()
            kept = keep_unrepeated(words, f, s, width)
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.unhex(F.md5(F.col(text))).alias("key"))
    return (rows.join(ranges, "key", "left").select("id", rest("text", "firsts", "sizes").alias("r"))
            .select(F.col("id").alias(id_col), "r.*"))
