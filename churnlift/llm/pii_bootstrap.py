"""Personal data: base patterns, and contexts learned from what they find.

Base spans (email, ip, card, phone) are the seeds.  The words around a seed
make lexical patterns (two words before; one before and one after; one
before).  Every identifier-like token of the corpus, seed or not, is an
instance of its patterns.  Spark then scores the pattern-instance graph in
rounds: a pattern's score for a kind is the confidence its instances have in
that kind, over their number plus one; an unknown instance that has the loose
form of a kind takes the best score of its patterns.  Patterns with enough
seeds and a high final score mark the unknown identifiers they hold as
discovered spans.

The four base rules are matched leftmost and without overlap per kind, in time
linear in the text; matches that fail a check (parts, Luhn, digit count) are
dropped.

Results for odd input: null is the empty text, without spans; equal texts get
equal spans, and count once as evidence; without seeds nothing is discovered;
extra columns pass through, an input column that has the output's name is replaced; texts of any length
are read whole, one at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fresh, written

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, and its least final score.
MIN_SEEDS = 4
MIN_SCORE = 0.75
ROUNDS = 3
#: Rows of discovered spans (by text) up to which they are broadcast.
BROADCAST_ROWS = 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# the look-behind lets a match start at the first digit of a run only, as leftmost matching does
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TELLING = re.compile("[0-9@]")
SPACE = re.compile("[\x20\x09-\x0D]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; offsets in code points."""
    if not TELLING.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    # a part over 255 has 4 significant digits or a large value; leading zeros are fine
    out += [(1, *m.span()) for m in IP.finditer(text)
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def loose_kinds(token: str) -> int:
    """Bit mask of the kinds whose loose form an unknown identifier has."""
    digits = len(NOT_DIGIT.sub("", token))
    numeric = re.fullmatch(r"[0-9 ().+/-]+", token) is not None
    return (("@" in token and len(token) > 3) | (re.fullmatch(r"[0-9]+([.,:-][0-9]+){3}", token) is not None) << 1
            | (numeric and 13 <= digits <= 19) << 2 | (numeric and 7 <= digits <= 15) << 3)


def unknown_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens (with a digit or @) that no base span touches;
    tokens one blank apart count as one."""
    out, at = [], 0
    while (m := TELLING.search(text, at)) is not None:
        start = m.start()
        while start > at and not SPACE.match(text[start - 1]):
            start -= 1
        stop = SPACE.search(text, m.end())
        at = stop.start() if stop else len(text)
        end = at
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end <= start:
            continue
        if out and start == out[-1][1] + 1:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    spans = sorted((a, b) for _, a, b in taken)
    free, k = [], 0
    for a, b in out:
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            free.append((a, b))
    return free


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of the words beside a span."""
    def plain(words):
        return [p for p in (re.sub(r"^\W+|\W+$", "", w) for w in words) if p]

    left = plain(text[max(0, start - 80):start].lower().split())[-2:]
    right = plain(text[end:end + 40].lower().split())[:1]
    out = []
    if left:
        out.append(f"{left[-1]} _")
        if right:
            out.append(f"{left[-1]} _ {right[0]}")
        if len(left) == 2:
            out.append(f"{left[0]} {left[1]} _")
    return out


def occurrences(df: DataFrame, text: str) -> DataFrame:
    """(key, start, end, instance, seed, kinds, patterns) of every seed (its
    kind number) and unknown identifier (null) of the distinct texts."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, t in zip(batch["key"], batch["text"]):
                base = base_spans(t)
                spans = [(a, b, k) for k, a, b in base] + [(a, b, None) for a, b in unknown_spans(t, base)]
                for a, b, k in spans:
                    out.append((key, a, b, t[a:b].lower(), k, loose_kinds(t[a:b]) if k is None else 1 << k, patterns(t, a, b)))
            yield pd.DataFrame(out, columns=["key", "start", "end", "instance", "seed", "kinds", "patterns"], dtype=object)

    rows = (df.where(F.col(text).rlike("[0-9@]"))
            .select(F.unhex(F.md5(F.col(text))).alias("key"), F.col(text).alias("text")))
    found = rows.mapInPandas(find, "key binary, start int, end int, instance string, seed int, kinds int, "
                                   "patterns array<string>")
    return found.distinct()


def score_patterns(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(pattern, kind, score) after ``rounds`` of the pattern-instance graph."""
    edges = written(found.select(F.explode("patterns").alias("pattern"), "instance", "seed", "kinds").distinct(), "edges")
    size = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    seeds = edges.where("seed is not null").select("pattern", "instance", F.col("seed").alias("kind"))
    # only patterns with seeds enough can score: all others leave the graph now
    live = (seeds.groupBy("pattern", "kind").agg(F.countDistinct("instance").alias("seeds"))
            .where(F.col("seeds") >= min_seeds).join(size, "pattern"))
    live = written(live, "patterns")
    own = seeds.select("instance", "kind").distinct().withColumn("belief", F.lit(1.0))
    belief, scores = own, None
    inside = edges.join(live.select("pattern").distinct(), "pattern").select("pattern", "instance", "seed", "kinds").distinct()
    inside = written(inside, "graph")
    for _ in range(rounds):
        held = (inside.select("pattern", "instance").distinct().join(belief, "instance")
                .groupBy("pattern", "kind").agg(F.sum("belief").alias("held")))
        scores = written(live.join(held, ["pattern", "kind"])
                         .select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("score")), "scores")
        unknown = (inside.where("seed is null").join(scores, "pattern")
                   .where(F.expr("(kinds & shiftleft(1, kind)) != 0"))
                   .groupBy("instance", "kind").agg(F.max("score").alias("belief")))
        belief = written(own.unionByName(unknown).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "belief")
    return scores


def discover(df: DataFrame, text: str, min_score: float = MIN_SCORE) -> DataFrame:
    """(key, starts, ends, kinds) of the discovered spans by text (md5)."""
    found = written(occurrences(df, text), "occurrences")
    good = score_patterns(found).where(F.col("score") >= min_score)
    best = (found.where("seed is null").select("key", "start", "end", "kinds", F.explode("patterns").alias("pattern"))
            .join(good, "pattern").where(F.expr("(kinds & shiftleft(1, kind)) != 0"))
            .groupBy("key", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind")))["kind"].alias("kind")))
    spans = F.array_sort(F.collect_list(F.struct("start", "end", (-F.col("kind")).alias("kind"))))
    return written(best.groupBy("key").agg(spans.alias("s"))
                   .select("key", F.col("s")["start"].alias("starts"), F.col("s")["end"].alias("ends"),
                           F.col("s")["kind"].alias("kinds")), "discovered")


FOUND = "base array<struct<kind:int,start:int,end:int>>, all array<struct<kind:int,start:int,end:int>>"


def find(df: DataFrame, text: str, out: str = "found") -> DataFrame:
    """``df`` with a struct ``out``: base spans, and all spans with the
    discovered ones, by kind and start."""
    more = discover(df, text)
    key, starts, ends, kinds = (fresh(df, n) for n in ("pii_key", "pii_starts", "pii_ends", "pii_kinds"))
    more = more.toDF(key, starts, ends, kinds)

    @F.pandas_udf(FOUND)
    def spans(texts: pd.Series, a: pd.Series, b: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s, e, q in zip(texts, a, b, k):
            base = base_spans(t) if isinstance(t, str) else []
            extra = [] if s is None else list(zip(map(int, q), map(int, s), map(int, e)))
            named = [[{"kind": x, "start": y, "end": z} for x, y, z in part] for part in (base, sorted(base + extra))]
            rows.append(named)
        return pd.DataFrame(rows, columns=["base", "all"])

    hint = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
    tagged = df.withColumn(key, F.unhex(F.md5(F.col(text)))).join(hint, key, "left")
    return tagged.withColumn(out, spans(F.col(text), F.col(starts), F.col(ends), F.col(kinds))).drop(key, starts, ends, kinds)


def redact(df: DataFrame, text: str) -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; of
    spans that overlap, the earliest start, then the longest, then the first
    kind is replaced and the rest of the others with it."""
    tmp = fresh(df, "found")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, spans in zip(texts, found):
            if not isinstance(t, str) or not len(spans):
                out.append(t)
                continue
            parts, done = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"], s["kind"])):
                if s["start"] >= done:
                    parts += [t[done:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                done = max(done, s["end"])
            out.append("".join(parts) + t[done:])
        return pd.Series(out, dtype=object)

    return (find(df, text, tmp).withColumn(text, F.when(F.size(F.col(tmp)["all"]) > 0, cleaned(F.col(text), F.col(tmp)["all"]))
                                           .otherwise(F.col(text))).drop(tmp))
