"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first pieces of a word, counted without building them: a
trie over the vocabulary carries at each node a failure link and the number of
pieces popped when that link is taken, so a word of n bytes costs O(n) steps
(linear-time WordPiece, Song et al. 2021).

A word is matched as one space followed by its bytes: vocabulary entries that
begin with a space are the word-initial pieces, all others continue a word.

Results for odd input: null or empty text, and text without words, have 0
words and 0 tokens; a word that the vocabulary cannot cover counts as one
unknown token; repeated rows get equal results; extra columns pass through,
an input column that has the output's name is replaced; texts of any length
are read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh
from .text import CACHED_BYTES, CACHE_WORDS, utf8


def load_pieces(path: str) -> list[bytes]:
    """Byte strings of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class PieceAutomaton:
    """Counts greedy longest-match pieces; nodes are ints, 0 is the root."""

    def __init__(self, pieces: Iterable[bytes]):
        step: dict[int, int] = {}  # node * 256 + byte -> node
        parent, via, whole = [0], [0], [False]
        for piece in pieces:
            u = 0
            for c in piece:
                v = step.get(u << 8 | c)
                if v is None:
                    v = step[u << 8 | c] = len(parent)
                    parent.append(u)
                    via.append(c)
                    whole.append(False)
                u = v
            whole[u] = bool(piece)
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        fail: list[int] = [-1] * len(parent)  # -1: no link
        pops = [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if whole[v]:
                fail[v], pops[v] = 0, 1
                continue
            u, c = parent[v], via[v]
            z, n = fail[u], pops[u]
            while z >= 0 and z << 8 | c not in step:
                n += pops[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v] = step[z << 8 | c], n
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word: bytes) -> int:
        """Number of pieces of ``word``; 1 if it cannot be covered."""
        step, fail, pops = self.step, self.fail, self.pops
        u = n = 0
        for c in word:
            v = step.get(u << 8 | c)
            while v is None:
                if fail[u] < 0:
                    return 1
                n += pops[u]
                u = fail[u]
                v = step.get(u << 8 | c)
            u = v
        while u:
            if fail[u] < 0:
                return 1
            n += pops[u]
            u = fail[u]
        return n


class _Counts(dict):
    def __init__(self, automaton: PieceAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n


def count_tokens(df: DataFrame, text: str, vocabulary: str, words_out: str = "n_words",
                 tokens_out: str = "n_tokens") -> DataFrame:
    """``df`` with the word and token counts of every whole text.

    ``vocabulary`` is the path of a rank file that exists on every executor;
    each Python worker builds the automaton once (its size is the file's).
    """
    @F.pandas_udf("words long, tokens long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Counts(PieceAutomaton(load_pieces(vocabulary)))
        for texts in batches:
            rows = []
            for t in texts:
                words = utf8(t).split()
                rows.append((len(words), sum(map(known.__getitem__, words))))
            yield pd.DataFrame(rows, columns=["words", "tokens"])

    tmp = fresh(df, "_counts")
    return (df.withColumn(tmp, counts(F.col(text)))
            .withColumns({words_out: F.col(tmp)["words"], tokens_out: F.col(tmp)["tokens"]}).drop(tmp))
