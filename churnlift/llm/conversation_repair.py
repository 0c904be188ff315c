"""Conversation structure repair by generalised LR parsing.

Every conversation is led through the role grammar of ``role_grammar`` at the
least cost of keeping, reroling, deleting and inserting rows.  Faults come
first: a *blank* row has no character but white space, a *duplicate* has role
and text of an earlier row, a *truncated* one does not end a sentence.  Blank
and duplicate rows have to go; keeping a truncated one costs extra.

1. Spark reduces the texts to their faults and a 128-bit digest, counts equal
   rows and finds the first row of each (conversation, digest).
2. The rows, a few dozen bytes each, are dealt into ranges of
   (conversation, turn, digest) and parsed in that order.  A conversation of
   one piece is settled on the spot.  Of a conversation that crosses ranges, or
   has more than ``SEGMENT`` rows, each piece is parsed from every stack top it
   may start with, and the pieces are joined afterwards, so that a conversation
   with any share of all rows is parsed by many tasks.
3. ``repaired`` streams the rows of each conversation past its audit.

Memory follows from ``SEGMENT``, Arrow batches and the audit of one
conversation (a character a row, part of the result).  A digest of the whole
repaired text has to read one conversation in order: ``digests`` holds one
batch and a hash state, but a single task reads a conversation's rows there.

**Odd input.**  Null roles and texts read as one space, a null id is an id, a
null turn comes before all others.  Rows of one turn are ordered by the digest
of role and text; equal rows stand side by side.  Roles starting with another
letter (or none) fit no grammar place and are reroled or deleted.  Texts of any
length only pass through digests and batches.  An id with no rows (``copies``
0) gets zeros and an empty audit; an empty table an empty result.  Only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .role_grammar import BROKEN, SOUND, TRUNCATED, Frontier, Repairs
from .storage import written

WHITE = " \t\n\x0b\x0c\r"
#: Distinct rows of a piece of a conversation that is parsed by itself.
SEGMENT = 4096
#: Neighbouring role initials that are in order.
LEGAL = {"su", "ua", "au"}

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


@lru_cache(maxsize=1)
def repairs() -> Repairs:
    return Repairs()


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def faults(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None) -> DataFrame:
    """(conv, turn, digest, initial, ends, rows): the distinct rows of every
    conversation; ``ends`` is 0 for a text that ends a sentence, 1 for another,
    2 for a blank one, and null where there is no row (``copies`` 0)."""
    kept = F.rtrim(_plain(text), F.lit(WHITE))
    ends = F.when(kept == "", 2).when(F.substring(kept, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    n = F.lit(1) if copies is None else F.col(copies)
    there = n > 0
    return (df.select(F.col(conv).alias("conv"), F.when(there, F.col(turn).cast("long")).alias("turn"),
                      F.when(there, _digest(_plain(role), _plain(text))).alias("digest"),
                      F.when(there, F.substring(_plain(role), 1, 1)).alias("initial"), F.when(there, ends).alias("ends"),
                      n.cast("long").alias("n"))
            .groupBy("conv", "turn", "digest", "initial", "ends").agg(F.sum("n").alias("rows")))


def _with_first(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first``: no earlier row of the conversation has its digest."""
    first = rows.groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("at")).select(
        F.col("conv").alias("c"), F.col("digest").alias("d"), F.col("at.turn").alias("first_turn"))
    same = rows["conv"].eqNullSafe(first["c"]) & rows["digest"].eqNullSafe(first["d"])
    return rows.join(first, same, "left").withColumn("first", F.col("turn").eqNullSafe(F.col("first_turn"))).drop(
        "c", "d", "first_turn")


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv, tops):
        self.conv, self.began = conv, None
        self.counts = dict.fromkeys(COUNTS, 0)
        self.frontiers: dict[int, Frontier] = {top: {top: (0, "")} for top in tops}
        self.first_turn = self.last_turn = self.low = self.last = self.initial = None
        self.turns = self.rows = 0

    def add(self, turn, digest, initial, ends, rows, first) -> None:
        if not rows:
            return
        if not self.rows:
            self.began, self.first_turn, self.initial = digest, turn, initial
            self.last_turn = None
            self.turns = 0 if turn is None else 1
            self.low = turn
        else:
            self.counts["illegal"] += self.last + initial not in LEGAL
            if turn != self.last_turn:
                self.turns += 1
                self.low = turn if self.low is None else self.low
        self.last_turn, self.last = turn, initial
        self.rows += 1
        self.counts["illegal"] += rows - 1  # equal initials are never in order
        whole = 0
        if ends == 2:
            self.counts["blank"] += rows
        else:
            whole = int(first)
            self.counts["duplicate"] += rows - whole
            self.counts["truncated"] += whole * ends
        for top, frontier in self.frontiers.items():
            if whole:
                frontier = repairs().over(frontier, initial, TRUNCATED if ends else SOUND)
            if rows > whole:
                frontier = repairs().deleted(frontier, rows - whole)
            self.frontiers[top] = frontier

    def join(self, other: _Piece) -> None:
        """``other`` follows."""
        if not other.rows:
            return
        if not self.rows:
            self.__dict__.update(other.__dict__ | {"frontiers": {0: other.frontiers[0]}})
            return
        for name in COUNTS:
            self.counts[name] += other.counts[name]
        self.counts["illegal"] += self.last + other.initial not in LEGAL
        self.turns += other.turns - (other.first_turn is not None and other.first_turn == self.last_turn)
        self.low = other.low if self.low is None else self.low
        self.last_turn, self.last = other.last_turn, other.last
        self.rows += other.rows
        self.frontiers = {0: repairs().joined(self.frontiers[0], other.frontiers)}

    def verdict(self) -> dict:
        cost, audit = repairs().best(self.frontiers[0])
        gaps = 0 if self.low is None else self.last_turn - self.low + 1 - self.turns
        return {"conv": self.conv, **self.counts, "gaps": gaps, "cost": cost, "audit": audit}


STATE = ("piece struct<began: binary, first_turn: long, last_turn: long, low: long, turns: long, rows: long, initial: string, "
         "last: string, tops: array<struct<start: int, top: int, cost: long, audit: string>>>")
ENDS = ("began", "first_turn", "last_turn", "low", "turns", "rows", "initial", "last")
VERDICT = ", ".join(["conv {conv}", *[f"{c} long" for c in COUNTS], "audit string"])


class _Parse:
    """Rows in order -> verdicts of whole conversations and pieces of the others."""

    def __init__(self, schema: pa.Schema, segment: int):
        self.schema, self.segment = schema, segment

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = tuple(repairs().stacks)
        # the first and the last conversation of a range may go on in others
        piece, partial, out = None, True, []
        for batch in batches:
            for conv, *row in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "digest", "initial", "ends", "rows", "first")]):
                if piece is None:
                    piece = _Piece(conv, tops)
                elif conv != piece.conv:
                    out.append(self._ended(piece, partial))
                    piece, partial = _Piece(conv, tops), False
                elif piece.rows >= self.segment:
                    partial = True
                    out.append(self._ended(piece, partial))
                    piece = _Piece(conv, tops)
                piece.add(*row)
            if out:
                yield pa.RecordBatch.from_pylist(out, self.schema)
                out = []
        if piece is not None:
            yield pa.RecordBatch.from_pylist([self._ended(piece, True)], self.schema)

    @staticmethod
    def _ended(piece: _Piece, partial: bool) -> dict:
        if not partial:
            return {**piece.verdict(), "piece": None}
        state = {name: getattr(piece, name) for name in ENDS}
        state["tops"] = [{"start": start, "top": top, "cost": cost, "audit": audit}
                         for start, frontier in piece.frontiers.items() for top, (cost, audit) in frontier.items()]
        return {"conv": piece.conv, **piece.counts, "audit": None, "piece": state}


def _join(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation -> its verdict."""
    whole = None
    states = list(pieces.itertuples(index=False))
    states.sort(key=lambda r: (r.piece["rows"] > 0, r.piece["first_turn"] is not None, r.piece["first_turn"] or 0,
                               r.piece["began"] or b""))
    for r in states:
        piece = _Piece(None if pd.isna(r.conv) else r.conv, ())
        piece.counts = {c: int(getattr(r, c)) for c in COUNTS}
        for name, value in r.piece.items():
            if name in ENDS:
                setattr(piece, name, value)
        for t in r.piece["tops"]:
            piece.frontiers.setdefault(t["start"], {})[t["top"]] = (t["cost"], t["audit"])
        if whole is None:
            whole = _Piece(piece.conv, (0,))
        whole.join(piece)
    return pd.DataFrame([whole.verdict()])


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None,
           segment: int = SEGMENT) -> DataFrame:
    """One row a conversation: (conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit).  ``copies`` says how often a row counts (default once; 0 keeps
    the id only)."""
    rows = _with_first(written(faults(df, conv, turn, role, text, copies), "conversation-rows"))
    kind = df.schema[conv].dataType.simpleString()
    dealt = rows.repartitionByRange("conv", "turn", "digest").sortWithinPartitions("conv", "turn", "digest")
    verdict = VERDICT.format(conv=kind)
    schema = f"{verdict}, {STATE}"
    parsed = written(dealt.mapInArrow(_Parse(to_arrow_schema(T._parse_datatype_string(schema)), segment), schema), "conversation-pieces")
    pieces = parsed.where("piece is not null")
    joined = pieces.groupBy("conv").applyInPandas(_join, verdict)
    return parsed.where("piece is null").drop("piece").unionByName(joined).withColumnRenamed("conv", conv)


def _in_order(df: DataFrame, verdicts: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None,
              carried: list[str]) -> DataFrame:
    """Each conversation's verdict and then its rows, in the order of ``repair``, in one partition."""
    n = F.lit(1) if copies is None else F.col(copies)
    body = df.where(n > 0).select(F.col(conv).alias("conv"), F.lit(1).alias("line"), F.col(turn).cast("long").alias("turn"),
                                  _digest(_plain(role), _plain(text)).alias("digest"), n.cast("long").alias("n"),
                                  _plain(role).alias("role"), _plain(text).alias("text"))
    head = verdicts.select(F.col(conv).alias("conv"), F.lit(0).alias("line"), "audit",
                           *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    return (head.unionByName(body, allowMissingColumns=True).repartition("conv")
            .sortWithinPartitions("conv", "line", "turn", "digest"))


def _streams(batches: Iterator[pa.RecordBatch], carried: int):
    """(conv, audit, carried values, iterator of repaired (role, text)) of each conversation, in turn."""
    def lines():
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("line", "conv", "audit", "n", "role", "text")]
            yield from zip(*columns, *[batch.column(f"c{i}").to_pylist() for i in range(carried)])

    rows = lines()
    ahead = next(rows, None)

    def body():
        nonlocal ahead
        while (ahead := next(rows, None)) is not None and ahead[0]:
            for _ in range(ahead[3]):
                yield ahead[4], ahead[5]

    while ahead is not None:
        _, conv, audit, _, _, _, *values = ahead
        own = body()
        yield conv, audit, values, repairs().apply(audit, own)
        for _ in own:  # moves on to the next verdict
            pass


def _batches(rows, schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    block = []
    for row in rows:
        block.append(row)
        if len(block) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)
            block = []
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), schema)], schema=schema)


def repaired(df: DataFrame, verdicts: DataFrame, conv: str, turn: str, role: str, text: str,
             copies: str | None = None) -> DataFrame:
    """The rows of the repaired conversations: (conv, place, role, text)."""
    schema = f"conv {df.schema[conv].dataType.simpleString()}, place long, role string, text string"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        return _batches(((found, place, *row) for found, _, _, rows in _streams(batches, 0) for place, row in enumerate(rows)), arrow)

    ordered = _in_order(df, verdicts, conv, turn, role, text, copies, [])
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)


def digests(df: DataFrame, verdicts: DataFrame, conv: str, turn: str, role: str, text: str, copies: str | None = None) -> DataFrame:
    """The verdicts of ``repair`` with ``repaired_sha256`` of the repaired
    ``role:text`` lines joined by newlines."""
    schema = VERDICT.format(conv=df.schema[conv].dataType.simpleString()) + ", repaired_sha256 string"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def judged(batches):
        for found, audit, values, rows in _streams(batches, len(COUNTS)):
            h, between = hashlib.sha256(), ""
            for new_role, new_text in rows:
                h.update(f"{between}{new_role}:{new_text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            yield found, *values, audit, h.hexdigest()

    ordered = _in_order(df, verdicts, conv, turn, role, text, copies, list(COUNTS))
    return ordered.mapInArrow(lambda b: _batches(judged(b), arrow), schema).withColumnRenamed("conv", conv)
