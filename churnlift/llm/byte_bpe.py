"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks of ``chunk`` characters that reach ``overlap``
characters into the next one.  Spark spreads the chunks, and each is split
into pre-tokens on its own.  Two neighbours scan the overlap from different
starts; from the first place where both see a pre-token boundary they agree
for good, and there the text is cut into pieces.  Pieces are spread again,
encoded, and their ids put together in order.  A text of one chunk needs no
stitching and is encoded where it is read.

Where neighbours never meet (one pre-token longer than the overlap), the
pieces are joined until a boundary that no scan can miss: a white-space
character after a non-white-space one, which no match of the pattern spans.

The library's matcher keeps a stack entry for every character of a run that it
may have to give back.  A piece with a run of ``LONG_RUN`` white-space or other
characters is therefore matched by the scan that made the chunks, and its
pre-tokens are encoded one by one.

Decoding concatenates the raw bytes of the ids, so it returns exactly the
bytes that were encoded, whatever pieces they came from.

Results for odd input: null is the empty text, with no ids; repeated rows get
equal ids (equal long texts are encoded once); texts of any length and runs of
any length are encoded whole; extra columns pass through, one that has the name
of the output is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh, written

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: A match may look this many characters past its end ("'re" and the like).
LOOKAHEAD = 3
#: Characters of one run that the library's matcher is trusted with.
LONG_RUN = 10_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a worker process: read once, size of the file."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


_LONG = regex.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")


def piece_ids(enc: tiktoken.Encoding, pattern: str, text: str | None) -> np.ndarray:
    """Ids of one piece (4 bytes each)."""
    text = text or ""
    if len(text) < LONG_RUN or not _LONG.search(text):
        return enc.encode_to_numpy(text, disallowed_special=()).view(np.int32)
    ids: list[int] = []
    for m in regex.finditer(pattern, text):
        ids += enc._encode_single_piece(m.group())
    return np.array(ids, np.int32)


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return table


def cut_points(text: str, pattern: str) -> list[int]:
    """Pre-token starts of a scan of ``text`` that follow a non-white-space
    character: there both sides can be encoded apart.  (After white space the
    pattern's look-ahead would see the end of the piece.)"""
    return [m.start() for m in regex.finditer(pattern, text) if m.start() and not regex.match(r"\s", text[m.start() - 1])]


def chunk_view(text: str, pattern: str, last: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int], int]:
    """What the stitching needs of one chunk: cut points in its first
    ``overlap`` characters, those past ``chunk`` that its end cannot change,
    and its first sure cut point (-1: none)."""
    starts = cut_points(text, pattern)
    head = [s for s in starts if s < overlap]
    tail = [] if last else [s for s in starts if chunk <= s <= len(text) - LOOKAHEAD]
    sure = regex.search(r"(?<=\S)\s", text[:chunk])
    return head, tail, sure.start() if sure else -1


def stitch(views: list[tuple[list[int], list[int], int]], chunk: int = CHUNK) -> list[int]:
    """Start of the piece that begins in each chunk, as an offset into the
    chunk (-1: none begins there, the piece before goes on)."""
    starts = [0]
    trusted = True
    for (_, tail, _), (head, _, sure) in zip(views, views[1:]):
        common = set(s - chunk for s in tail).intersection(head) if trusted else ()
        cut = min(common) if common else sure
        trusted = cut >= 0
        starts.append(cut)
    return starts


def _pieces(long: DataFrame, key: str, text: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, piece, piece_text) of texts longer than a chunk, each text once."""
    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[t[i:i + chunk + overlap] for i in range(0, len(t), chunk)] for t in texts], dtype=object)

    chunks = (long.select(F.col(key).alias("key"), F.posexplode(cut(F.col(text))).alias("no", "chunk"))
              .groupBy("key", "no").agg(F.first("chunk").alias("chunk")))
    chunks = written(chunks, "bpe-chunks")

    @F.pandas_udf("head array<int>, tail array<int>, sure int")
    def view(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chunk_view(t, pattern, len(t) <= chunk, chunk, overlap) for t in texts], columns=["head", "tail", "sure"])

    def cuts(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("no")
        starts = stitch(list(zip(group["head"], group["tail"], group["sure"])), chunk)
        before, piece = [], -1
        for no, start in zip(group["no"], starts):
            before.append(piece)
            piece = no if start >= 0 else piece
        return pd.DataFrame({"key": group["key"].values, "no": group["no"].values, "start": starts, "before": before})

    # per text only the overlaps' cut points meet here, not the text
    views = chunks.select("key", "no", view("chunk").alias("v")).select("key", "no", "v.*")
    starts = views.groupBy("key").applyInPandas(cuts, "key binary, no int, start int, before int")
    own = F.substring("chunk", 1, chunk)
    from_start = F.when(F.col("start") >= 0, F.col("start")).otherwise(F.lit(chunk))
    parts = (chunks.join(starts, ["key", "no"])
             .select("key", "no", F.explode(F.array(
                 F.struct(F.col("before").alias("piece"), F.substring(own, F.lit(1), from_start).alias("part")),
                 F.struct(F.col("no").alias("piece"), F.substring(own, from_start + 1, F.lit(chunk)).alias("part"))))
                 .alias("p")).select("key", "no", "p.*").where("part != ''"))
    return (parts.groupBy("key", "piece").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("parts"))
            .select("key", "piece", F.array_join(F.col("parts")["part"], "").alias("piece_text")))


def encode(df: DataFrame, text: str, path: str, pattern: str, out: str = "ids", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``df`` with the token ids of every whole text in ``out``."""
    key, joined = fresh(df, "text_key"), fresh(df, "joined_ids")

    @F.pandas_udf("array<int>")
    def encode_here(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for texts in batches:
            # ids as arrays of 4 bytes each, not as lists of Python ints
            yield pd.Series([piece_ids(enc, pattern, t) for t in texts], dtype=object)

    columns = [F.col(c) for c in df.columns if c.lower() != out.lower()]
    is_long = F.coalesce(F.char_length(F.col(text)), F.lit(0)) > chunk
    short = df.where(~is_long).withColumn(joined, encode_here(F.col(text)))
    long = df.where(is_long).withColumn(key, F.unhex(F.sha2(F.col(text), 256)))
    encoded = _pieces(long, key, text, pattern, chunk, overlap).select("key", "piece", encode_here("piece_text").alias("ids"))
    texts = (encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("all"))
             .select(F.col("key").alias(key), F.flatten(F.col("all")["ids"]).alias(joined)))
    long = long.join(written(texts, "bpe-ids"), key)
    return (short.select(*columns, F.col(joined).alias(out))
            .unionByName(long.select(*columns, F.col(joined).alias(out))))


def decode(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes of every id list in ``out`` (null ids: no bytes)."""
    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = byte_table(path)
        for lists in batches:
            yield pd.Series([b"" if x is None else b"".join(map(table.__getitem__, x.tolist())) for x in lists], dtype=object)

    return df.withColumn(out, decoded(F.col(ids)))


