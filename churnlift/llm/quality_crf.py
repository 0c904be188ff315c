"""Quality rules: lines labelled content or boilerplate by a linear-chain CRF.

Each line that has a word becomes a set of binary shape features (one 16-bit
code).  A two-label linear-chain conditional random field gives emission and
transition weights; Viterbi decoding labels a whole text's lines, and the text
is kept when enough of its words stand in content lines and the base rules
pass.

Training takes document-level quality labels (all lines of a low-quality
document count as boilerplate, others as content): a bounded sample of line
windows, the smallest by hash, at most ``MAX_WINDOWS`` windows of
``WINDOW_LINES`` lines from all labelled documents.  The base counts follow
the rules stated in ``base_counts``.

Results for odd input: null or empty text, or text without words, has zero
counts, fails the base rules and is not kept; without labelled rows all
weights are 0 and every line is content; repeated rows get equal results;
extra columns pass through, an input column that has the output's name is replaced; texts of any length
are read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh
from .text import WordHashes, covered, grams, utf8

#: Bound of the training sample.
MAX_WINDOWS = 4000
WINDOW_LINES = 32
#: A text is kept when at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
#: Base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
ENDS = (b".", b"!", b"?", b":", b";", b'"')
N_FEATURES = 16

CONTENT, BOILERPLATE = 0, 1


def line_code(words: list[bytes], line: bytes, seen: bool) -> int:
    """Binary shape features of one line, packed into an int.

    One bit each, the lowest first: always; 1-2 words; 3-5 words; over 5
    words; symbols over 1 %, over 5 %; ASCII capitals over 30 %, over 70 % of
    the ASCII letters; '!' in over a fifth of the words; '|' in over a fifth;
    distinct words under 70 %, under 40 %; digits over 20 %; sentence end;
    mean word over 12 bytes; equal to an earlier line.
    """
    n, size = len(words), len(line)
    symbols = size - len(line.translate(None, SYMBOLS))
    letters = size - len(line.translate(None, LETTERS))
    upper = size - len(line.translate(None, UPPER))
    digits = size - len(line.translate(None, DIGITS))
    distinct = len(set(words))
    return (1 | (n <= 2) << 1 | (3 <= n <= 5) << 2 | (n > 5) << 3
            | (symbols * 100 > size) << 4 | (symbols * 20 > size) << 5
            | (upper * 10 > 3 * letters) << 6 | (upper * 10 > 7 * letters) << 7
            | (line.count(b"!") * 5 > n) << 8 | (line.count(b"|") * 5 > n) << 9
            | (distinct * 10 < 7 * n) << 10 | (distinct * 10 < 4 * n) << 11
            | (digits * 5 > size) << 12 | words[-1].endswith(ENDS) << 13
            | (size - n > 12 * n) << 14 | seen << 15)


def line_codes(raw: bytes) -> tuple[list[int], list[int], int]:
    """Code and word count of each line with a word; lines equal to an earlier one."""
    codes, sizes, earlier, repeats = [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            seen = line in earlier
            earlier.add(line)
            repeats += seen
            codes.append(line_code(words, line, seen))
            sizes.append(len(words))
    return codes, sizes, repeats


@dataclass(frozen=True)
class LineCrf:
    """Weights: emission of label BOILERPLATE against CONTENT by feature, and
    transition scores [from][to]."""

    emission: tuple[float, ...] = (0.0,) * N_FEATURES
    transition: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def score(self, code: int) -> float:
        return sum(w for i, w in enumerate(self.emission) if code >> i & 1)

    def viterbi(self, codes: list[int], scores: dict[int, float]) -> list[int]:
        """Best label of each line; a tie goes to CONTENT."""
        (t00, t01), (t10, t11) = self.transition
        back, a, b = [], 0.0, 0.0
        for i, code in enumerate(codes):
            e = scores.get(code)
            if e is None:
                e = scores[code] = self.score(code)
            if i:
                a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
                back.append((a1 > a0, b1 > b0))
                a, b = max(a0, a1), max(b0, b1) + e
            else:
                b = e
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1][:len(codes)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _ascend(x: np.ndarray, there: np.ndarray, label: np.ndarray, chain: bool, l2: float, steps: int,
            rate: float) -> np.ndarray:
    """Conditional maximum likelihood by Adam: x[window, line, feature], label[window, line].

    Both labels get the same total weight, so that rare boilerplate is learned
    too.  Without ``chain`` the transitions stay 0.
    """
    n, longest, _ = x.shape
    lines = there.sum()
    share = np.array([(there & (label == y)).sum() for y in (0, 1)]) / lines
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0)[label] * there
    theta = np.zeros(N_FEATURES + 4)
    m = v = np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        e = np.stack([np.zeros((n, longest)), x @ w], -1)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            on = _lse(alpha[:, k - 1, :, None] + t, 1) + e[:, k]
            alpha[:, k] = np.where(there[:, k, None], on, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            on = _lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(there[:, k + 1, None], on, beta[:, k])
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        grad = np.zeros_like(theta)
        grad[:N_FEATURES] = np.einsum("nlf,nl->f", x, (label - node[:, :, 1]) * weight)
        if chain:
            pair = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
            for a in (0, 1):
                for b in (0, 1):
                    seen = (label[:, :-1] == a) & (label[:, 1:] == b)
                    grad[N_FEATURES + 2 * a + b] = ((seen - pair[:, :, a, b]) * weight[:, 1:]).sum()
        grad = grad / lines - l2 * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return theta


def train(windows: list[tuple[list[int], int]], l2: float = 1e-3, steps: int = 120, rate: float = 0.1) -> LineCrf:
    """CRF from windows of line codes, each with its document's label.

    A first pass without transitions takes every line of a bad document for
    boilerplate.  Lines of bad documents that it then scores as content are
    relabelled, and the chain is trained on the corrected labels.
    """
    windows = [w for w in windows if w[0]]
    if not windows:
        return LineCrf()
    n, longest = len(windows), max(len(c) for c, _ in windows)
    codes, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (c, _) in enumerate(windows):
        codes[i, :len(c)], there[i, :len(c)] = c, True
    label = np.repeat(np.array([y for _, y in windows])[:, None], longest, 1)
    x = ((codes[:, :, None] >> np.arange(N_FEATURES)) & 1) * there[:, :, None].astype(float)
    first = _ascend(x, there, label, False, l2, steps, rate)
    label = np.where((label == BOILERPLATE) & (x @ first[:N_FEATURES] <= 0), CONTENT, label)
    theta = [float(q) for q in _ascend(x, there, label, True, l2, steps, rate)]
    t = theta[N_FEATURES:]
    return LineCrf(tuple(theta[:N_FEATURES]), ((t[0], t[1]), (t[2], t[3])))


def fit(df: DataFrame, text: str, quality: str, max_windows: int = MAX_WINDOWS) -> LineCrf:
    """Fit on labelled texts (``quality`` 1 good, 0 bad; null rows are left out).

    Every labelled text is cut into windows of lines; equal windows count
    once, and the ``max_windows`` smallest by hash are the sample.
    """
    @F.pandas_udf("array<array<int>>")
    def windows_of(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = line_codes(utf8(t))[0]
            out.append([codes[i:i + WINDOW_LINES] for i in range(0, len(codes), WINDOW_LINES)])
        return pd.Series(out, dtype=object)

    windows = (df.where(F.col(quality).isNotNull())
               .select(F.col(quality).cast("int").alias("q"), F.explode(windows_of(F.col(text))).alias("codes"))
               .groupBy("q", "codes").count())
    order = F.xxhash64("codes", "q")
    sample = windows.orderBy(order, "codes", "q").limit(max_windows).collect()
    return train([(list(r["codes"]), BOILERPLATE if r["q"] == 0 else CONTENT) for r in sample])


def base_counts(raw: bytes, words: list[bytes], hashes: WordHashes) -> tuple[int, int, int]:
    """Code points in words, symbols, and words in 5-word windows found twice or more."""
    points = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    windows = grams(hashes.of(words), REPEAT_WINDOW)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return points, symbols, 0
    starts = np.flatnonzero(np.isin(windows, twice))
    return points, symbols, int(covered(starts, REPEAT_WINDOW, len(words)).sum())


VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, content_words long, kept boolean")


def judge(df: DataFrame, text: str, model: LineCrf, share: float = CONTENT_SHARE, out: str = "quality") -> DataFrame:
    """``df`` with a struct column ``out`` (``VERDICT``) for every whole text."""
    @F.pandas_udf(VERDICT)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, scores = WordHashes(), {}
        names = [c.split()[0] for c in VERDICT.split(", ")]
        for texts in batches:
            rows = []
            for t in texts:
                raw = utf8(t)
                words = raw.split()
                n = len(words)
                points, symbols, repeated = base_counts(raw, words, hashes)
                codes, sizes, dup = line_codes(raw)
                content = sum(s for s, y in zip(sizes, model.viterbi(codes, scores)) if y == CONTENT)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
                rows.append((n, points, symbols, dup, repeated, failed, content,
                             not failed and content >= share * n))
            yield pd.DataFrame(rows, columns=names)

    return df.withColumn(out, verdicts(F.col(text)))


def keep_good(df: DataFrame, text: str, model: LineCrf, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``df`` that are kept, columns unchanged."""
    tmp = fresh(df, "quality")
    return judge(df, text, model, share, tmp).where(F.col(tmp)["kept"]).drop(tmp)
