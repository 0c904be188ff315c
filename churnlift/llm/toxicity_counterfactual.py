"""Toxicity score of a counterfactually regularised linear classifier.

Features are the shares of words and of word beginnings among a text's words
(``FULL_SHARE`` of the words counts as 1, and no more).  A logistic model is
fitted by proximal gradient steps (L1, so that features without evidence get
weight 0).  For each labelled text that mentions an identity term, a copy with
the terms swapped for others of the same set is made; the squared difference
of both scores (log-odds) is added to the loss, so a text's score may not hang
on which group it mentions.

Training reads a bounded sample: the ``MAX_TEXTS`` distinct labelled texts
smallest by hash.  Features found in fewer than ``MIN_TEXTS`` of them, or whose
means in both labels differ by less than ``MIN_T`` standard errors, are left
out (identity terms stay).  Scoring reads every whole text.

Results for odd input: null or empty text scores as no words (the intercept);
without labelled rows of both labels every score is the share of label 1 among
them (0 without rows); repeated rows get equal scores; extra columns pass through,
an input column that has the output's name is replaced; texts of any length
are read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

MAX_TEXTS = 5_000
MIN_TEXTS = 4
MIN_T = 3.0
#: Share of a text's words at which a feature has value 1.
FULL_SHARE = 0.02
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)

#: Identity terms by set; a term is swapped for the next one of its set.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"), ("old", "young"), ("deaf", "blind", "disabled"),
    ("africans", "europeans", "americans", "mexicans", "chinese", "indians"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: group[(i + 1) % len(group)] for group in IDENTITY_TERMS for i, t in enumerate(group)}

WORD = re.compile(r"\w+")


def words_of(text) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def features(words: list[str]) -> dict[str, float]:
    """Values of the words and, marked by a final '~', the word beginnings."""
    count: Counter[str] = Counter()
    for w, n in Counter(words).items():
        count[w] += n
        for k in BEGINNINGS:
            if len(w) >= k:
                count[w[:k] + "~"] += n
    scale = 1 / (FULL_SHARE * len(words)) if words else 0.0
    return {f: min(1.0, n * scale) for f, n in count.items()}


def swapped(words: list[str]) -> list[str] | None:
    """The words with identity terms swapped; None if there are none."""
    return [SWAP.get(w, w) for w in words] if SWAP.keys() & set(words) else None


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text) -> float:
        z, weights = self.intercept, self.weights
        if weights:
            # shares by feature, of the words and beginnings that have a weight only
            words = words_of(text)
            count: dict[str, int] = {}
            for w, n in Counter(words).items():
                for f in (w, *[w[:k] + "~" for k in BEGINNINGS if len(w) >= k]):
                    if f in weights:
                        count[f] = count.get(f, 0) + n
            full = FULL_SHARE * len(words)
            z += sum(weights[f] * min(1.0, n / full) for f, n in count.items())
        return 1 / (1 + math.exp(-max(min(z, 50.0), -50.0)))


class _Rows:
    """Sparse rows of (column, value)."""

    def __init__(self, rows: list[dict[int, float]], width: int):
        self.col = np.fromiter((c for r in rows for c in r), np.int64)
        self.val = np.fromiter((v for r in rows for v in r.values()), float)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.shape = (len(rows), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.val, self.shape[0])

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.val, self.shape[1])


def train(rows: list[dict[str, float]], moved: list[dict[str, float]], labels: list[int], l1: float = 2e-4,
          swap_weight: float = 1.0, steps: int = 500) -> ToxicityModel:
    """Fit on feature values and labels; ``moved`` holds the value changes of
    the swapped copies.  Both labels get the same total weight."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(math.inf if len(y) and y[0] else -math.inf)
    index = {f: i for i, f in enumerate(sorted({f for r in rows + moved for f in r}))}

    def sparse(many: list[dict[str, float]]) -> _Rows:
        return _Rows([{index[f]: v for f, v in r.items()} for r in many], len(index))

    x, pairs, moved = sparse(rows), moved, sparse(moved)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    pair_weight = np.full(len(pairs), 2 * swap_weight / max(1, len(pairs)))
    # a separable bound of the curvature gives each feature its own step
    curve = 0.25 * x.t_dot(weight * (x.dot(np.ones(len(index))) + 1))
    if pairs:
        size = _Rows([], 0)
        size.col, size.row, size.val, size.shape = moved.col, moved.row, np.abs(moved.val), moved.shape
        curve += size.t_dot(pair_weight * size.dot(np.ones(len(index))))
    rate = 1 / np.maximum(curve, 1e-9)
    rate_b = 1 / (0.25 * float((weight * (x.dot(np.ones(len(index))) + 1)).sum()))
    w, b, last = np.zeros(len(index)), 0.0, 1.0
    v, bv = w, b
    for _ in range(steps):
        z = x.dot(v) + bv
        r = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        grad = x.t_dot(r)
        if pairs:
            grad += moved.t_dot(moved.dot(v) * pair_weight)
        step = v - rate * grad
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_b = bv - rate_b * r.sum()
        nxt = (1 + math.sqrt(1 + 4 * last * last)) / 2
        v, bv = new + (last - 1) / nxt * (new - w), new_b + (last - 1) / nxt * (new_b - b)
        w, b, last = new, new_b, nxt
    return ToxicityModel(float(b), {f: float(w[i]) for f, i in index.items() if w[i] != 0})


def fit(df: DataFrame, text: str, label: str, max_texts: int = MAX_TEXTS) -> ToxicityModel:
    """Fit on labelled texts (rows with a null label are left out); equal
    texts with equal labels count once."""
    rows = (df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
            .select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"), F.sha2(F.col(text), 256).alias("h")))
    sample = written(rows.groupBy("h", "y").agg(F.first("text").alias("text")).orderBy("h", "y").limit(max_texts), "labelled")

    @F.pandas_udf("array<struct<f:string,v:double>>")
    def values(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"f": f, "v": v} for f, v in features(words_of(t)).items()] for t in texts], dtype=object)

    # which features tell the labels apart is settled by Spark; only their values come to the driver
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    cells = sample.select("y", F.inline(values("text")))

    def total(c, y):
        return F.sum(F.when(F.col("y") == y, c).otherwise(0.0))
    v = F.col("v")
    means = cells.groupBy("f").agg(F.count(F.lit(1)).alias("n"), (total(v, 1) / n1).alias("m1"), (total(v, 0) / n0).alias("m0"),
                                   (total(v * v, 1) / n1).alias("q1"), (total(v * v, 0) / n0).alias("q0"))
    error = F.sqrt((F.col("q1") - F.col("m1") * F.col("m1")) / n1 + (F.col("q0") - F.col("m0") * F.col("m0")) / n0 + 1e-12)
    telling = means.where((F.col("n") >= MIN_TEXTS) & (F.abs(F.col("m1") - F.col("m0")) >= MIN_T * error))
    kept = {r["f"] for r in telling.select("f").collect()} | SWAP.keys()

    @F.pandas_udf("own map<string,double>, moved map<string,double>")
    def chosen(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            words = words_of(t)
            a, other = features(words), swapped(words)
            b = features(other) if other is not None else a
            out.append(({f: v for f, v in a.items() if f in kept},
                        {f: d for f in kept if (d := a.get(f, 0.0) - b.get(f, 0.0))}))
        return pd.DataFrame(out, columns=["own", "moved"])

    got = sample.select("h", "y", chosen("text").alias("c")).select("h", "y", "c.*").orderBy("h", "y").collect()
    return train([r["own"] for r in got], [r["moved"] for r in got if r["moved"]], [r["y"] for r in got])


def score(df: DataFrame, text: str, model: ToxicityModel, out: str = "score") -> DataFrame:
    """``df`` with the score (0 to 1) of every whole text in ``out``."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype=float)

    return df.withColumn(out, scored(F.col(text)))
