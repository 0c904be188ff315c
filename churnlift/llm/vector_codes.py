"""Vector code compression: product codes found by Orchard's search.

A vector is cut into equal consecutive parts; each part position has a
codebook.  Rounds of assigning every part to its nearest entry and moving the
entries to the (floored) mean of their parts train the codebooks on all
vectors; a last pass writes the codes.

**Nearest entry.**  Every entry of a codebook holds a list of all entries in
order of their distance from it.  A search walks the list of its current
entry; an entry that is closer to the part (or as close with a lower index)
becomes current, and the search goes on in that entry's list.  Entries met
once are marked and not measured again.  The walk ends at the first listed
entry that lies beyond twice the current distance: by the triangle inequality
none behind it can be closer or as close.  All arithmetic is in integers, so
the result is the exact nearest entry, ties to the lower index.  A coarse grid
gives the entry that a walk starts from.  The searches of a batch advance
together, one list step at a time.

**Scale.**  Vectors are never shuffled: each pass maps over the rows, and a
task returns the sums and counts of the entries it met.  The codebooks
(parts x entries x width numbers) are the only model state on the driver.

**Odd input.**  Dropped: vectors that are null or empty, hold a null, NaN or
infinite component, or have another length than most rows (ties: the longer
length).  Rows with a null id are encoded but seed no entry; of rows that
share an id the smallest vector seeds.  Fewer ids than entries give smaller
codebooks, an empty table an empty result.  Components are held within
+-2**26 after scaling, so that distances fit 64 bits; a sum of errors beyond
64 bits is null.  Only the named columns are read, so names of others cannot
clash; a length that the parts do not divide is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Bound of a scaled component.
LIMIT = 1 << 26
#: Searches that advance together; bounds the marks to so many rows of ``entries`` flags.
TOGETHER = 1 << 16


@dataclass(frozen=True)
class Codebooks:
    """``entries[part, entry, position]``, integers."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Orchard:
    """Neighbour lists of all codebooks and the search over them."""

    #: Cells of the table of first entries are at most 2**CELL_BITS a part.
    CELL_BITS = 12

    def __init__(self, books: Codebooks):
        n_parts, self.size, self.width = books.entries.shape
        self.entries = books.entries.reshape(-1, self.width)
        difference = books.entries[:, :, None, :] - books.entries[:, None, :, :]
        apart = (difference * difference).sum(-1)
        near = np.argsort(apart, axis=2, kind="stable")
        self.near = near.ravel()
        self.apart = np.take_along_axis(apart, near, 2).ravel()
        # A walk starts at the entry nearest to the middle of the part's cell in
        # a coarse grid between the entries' least and greatest components.
        bits = max(1, min(3, self.CELL_BITS // self.width))
        self.axes = min(self.width, self.CELL_BITS // bits)
        self.steps = 1 << bits
        self.low = books.entries.min(1)[:, :self.axes].astype(np.float64)
        self.step = np.maximum((books.entries.max(1)[:, :self.axes] - self.low) / self.steps, 1e-9)
        cells = np.stack(np.meshgrid(*[np.arange(self.steps)] * self.axes, indexing="ij"), -1).reshape(-1, self.axes)
        self.first = np.empty((n_parts, len(cells)), np.int64)
        for part in range(n_parts):
            middle = self.low[part] + (cells + 0.5) * self.step[part]
            for i in range(0, len(cells), 256):
                gap = middle[i:i + 256, None, :] - books.entries[part, None, :, :self.axes]
                self.first[part, i:i + 256] = np.square(gap).sum(-1).argmin(1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``parts[row, part, position]`` -> index and squared distance, both [row, part]."""
        rows, n_parts, width = parts.shape
        cell = np.zeros((rows, n_parts), np.int64)
        for axis in range(self.axes):
            at = np.clip((parts[:, :, axis] - self.low[:, axis]) / self.step[:, axis], 0, self.steps - 1)
            cell = cell * self.steps + at.astype(np.int64)
        start = (np.arange(n_parts) * self.size + self.first[np.arange(n_parts), cell]).ravel()
        flat = parts.reshape(-1, width)
        found = [self._walk(flat[i:i + TOGETHER], start[i:i + TOGETHER]) for i in range(0, len(flat), TOGETHER)]
        index, squared = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        return index.reshape(rows, n_parts) % max(self.size, 1), squared.reshape(rows, n_parts)

    def _walk(self, x: np.ndarray, current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries are numbered over all parts: part * size + index."""
        n, size = len(x), self.size
        current = current.copy()
        away = x - self.entries[current]
        best = np.einsum("ij,ij->i", away, away)
        marked = np.zeros(n * size, bool)
        marked[np.arange(n) * size + current % size] = True
        place = np.zeros(n, np.int64)
        going = np.arange(n)
        while len(going):
            here = current[going]
            listed = here * size + place[going]
            inside = self.apart[listed] <= 4 * best[going]
            going, here, listed = going[inside], here[inside], listed[inside]
            place[going] += 1
            index = self.near[listed]
            mark = going * size + index
            new = ~marked[mark]
            marked[mark] = True
            who, entry = going[new], (here[new] // size) * size + index[new]
            away = x[who] - self.entries[entry]
            squared = np.einsum("ij,ij->i", away, away)
            better = (squared < best[who]) | ((squared == best[who]) & (entry < current[who]))
            moved = who[better]
            current[moved], best[moved], place[moved] = entry[better], squared[better], 0
            going = going[place[going] < size]
        return current, best


def whole_numbers(vectors: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """The rows whose vector is usable, ``vector`` as integers floor(scale * x)."""
    x = F.col(vector).cast("array<double>")
    limit = float(LIMIT)
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(limit)), F.lit(-limit))).cast("int"))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & sound).withColumn(vector, whole)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _move(kept: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: entries moved to the floored mean of the parts nearest to them."""
    n_parts, size, width = books.entries.shape
    sent = kept.sparkSession.sparkContext.broadcast(Orchard(books))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_parts * size, width + 1), np.int64)
        for batch in batches:
            parts = _matrix(batch.column(0)).reshape(-1, n_parts, width)
            index, _ = sent.value.nearest(parts)
            cell = (np.arange(n_parts) * size + index).ravel()
            order = np.argsort(cell, kind="stable")
            cells, starts = np.unique(cell[order], return_index=True)
            if len(cells):
                sums[cells, :-1] += np.add.reduceat(parts.reshape(-1, width)[order], starts, axis=0)
                sums[cells, -1] += np.bincount(cell, minlength=n_parts * size)[cells]
        met = np.flatnonzero(sums[:, -1])
        columns = [pa.array(np.repeat(met, width + 1)), pa.array(np.tile(np.arange(width + 1), len(met))),
                   pa.array(sums[met].ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["cell", "position", "total"])

    tasks = kept.select(vector).mapInArrow(gather, "cell long, position long, total long")
    # as many rows as the codebooks have numbers
    rows = tasks.groupBy("cell", "position").agg(F.sum("total").alias("total")).collect()
    sent.unpersist()
    totals = np.zeros((n_parts * size, width + 1), np.int64)
    for r in rows:
        totals[r["cell"], r["position"]] = r["total"]
    moved = books.entries.reshape(-1, width).copy()
    met = totals[:, -1] > 0
    moved[met] = totals[met, :-1] // totals[met, -1:]
    return Codebooks(moved.reshape(n_parts, size, width))


def fit(kept: DataFrame, id: str, vector: str, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks trained on every row of ``kept`` (integer vectors of one length)."""
    # the ids first, so that only vectors of the smallest ids are grouped
    smallest = [r[0] for r in kept.select(id).where(F.col(id).isNotNull()).distinct().orderBy(id).limit(entries).collect()]
    if not smallest:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    seeds = (kept.where(F.col(id).isin(smallest)).groupBy(F.col(id).alias("id")).agg(F.min(vector).alias("v"))
             .orderBy("id").collect())
    length = len(seeds[0]["v"])
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    first = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, length // parts)
    books = Codebooks(first.transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _move(kept, vector, books)
    return books


def encode(kept: DataFrame, vector: str, books: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """``kept`` with ``vector`` replaced by ``code`` (array of entry indexes) and
    ``error`` (squared distance summed over the parts)."""
    n_parts, size, width = books.entries.shape
    clash = {code.lower(), error.lower()} & {c.lower() for c in kept.columns if c != vector}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    rest = [c for c in kept.columns if c != vector]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*rest).schema], f"`{code}` array<int>",
                        f"`{error}` long"])
    if not size:
        return kept.sparkSession.createDataFrame([], schema)
    sent = kept.sparkSession.sparkContext.broadcast(Orchard(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, squared = sent.value.nearest(_matrix(batch.column(0)).reshape(-1, n_parts, width))
            offsets = np.arange(0, index.size + 1, n_parts, dtype=np.int32)
            codes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(index.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], codes, pa.array(squared.sum(1))], names=[*rest, code, error])

    return kept.select(vector, *rest).mapInArrow(run, schema)


def one_length(kept: DataFrame, vector: str) -> DataFrame:
    """The rows of the most frequent vector length (ties: the longer)."""
    lengths = kept.groupBy(F.size(vector).alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return kept.where(F.size(vector) == most[0]["length"]) if most else kept


def compress(vectors: DataFrame, id: str, vector: str, parts: int = 16, entries: int = 64, rounds: int = 2,
             scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable rows (columns of ``vectors``, ``code`` and ``error``
    in place of ``vector``) and the codebooks.  ``vectors`` is read once for the
    lengths, the ids, the seeds, each round and the codes."""
    kept = one_length(whole_numbers(vectors, vector, scale), vector)
    books = fit(kept, id, vector, parts, entries, rounds)
    return encode(kept, vector, books), books


def with_group_total(rows: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of equal ``group`` (nulls
    together).  The totals are written, so that they are broadcast only when
    their size allows it."""
    totals = written(rows.groupBy(F.col(group).alias("_group")).agg(F.try_sum(value).alias(out)), "group-totals")
    return rows.join(totals, rows[group].eqNullSafe(totals["_group"]), "left").drop("_group")
