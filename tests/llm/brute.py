"""Plain single-process versions of the operators' contracts, from their wording."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text) if text else []


def sha(data):
    return hashlib.sha256(data.encode("utf-8") if isinstance(data, str) else data).hexdigest()


def quality(text):
    text = text or ""
    ws = words(text)
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    hit = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 10 or 100 * len(hit) > 20 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def shingles(text, n):
    ws = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) or frozenset([tuple(ws)])


def roots(n, links):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in links:
        top[find(a)] = find(b)
    return [find(i) for i in range(n)]


def jaccard(rows, n=3, percent=90):
    """[(id, size, component)] of rows [(id, text)]: every pair is compared."""
    sets = [shingles(t, n) for _, t in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a) * 100 >= percent * len(b) and len(b) * 100 >= percent * len(a):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    links.append((i, j))
    root = roots(len(rows), links)
    low = defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r].append(i)
    return [(i, len(s), min(low[r]) if low[r] else None) for (i, _), s, r in zip(rows, sets, root)]


def windows(rows, width=35):
    """[(id, n_words, n_removed, kept_sha256)] of rows [(id, text)]."""
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(ws[i:i + width]) for ws in split for i in range(len(ws) - width + 1))
    out = []
    for (i, _), ws in zip(rows, split):
        gone = set()
        for k in range(len(ws) - width + 1):
            if seen[tuple(ws[k:k + width])] > 1:
                gone.update(range(k, k + width))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), sha(" ".join(kept))))
    return out


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """Base spans [(kind, start, end)] by kind, then start."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def size_and_crc(text):
    raw = (text or "").encode("utf-8")
    return len(raw) + 1, zlib.crc32(raw)


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def greedy_pieces(word, pieces, longest):
    """Greedy longest-match pieces of the bytes; None if a byte is not covered."""
    out, i = [], 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                out.append(word[i:j])
                i = j
                break
        else:
            return None
    return out


# ---- vector codes ---------------------------------------------------------

def codes(rows, parts=16, entries=64, rounds=2):
    """[(id, vector or None, label)] -> {(id, code, error, label error)}, sha of the codebooks."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    smallest = {}
    for i, v, _ in kept:
        if i is not None:
            smallest[i] = min(v, smallest.get(i, v))
    seeds = [smallest[i] for i in sorted(smallest)[:entries]]
    books = [[v[p * width:(p + 1) * width] for v in seeds] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for v in cut:
                members.setdefault(nearest(v[p], book)[1], []).append(v[p])
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e
                        for k, e in enumerate(book)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, _, g), e in zip(kept, errors):
        totals[g] = totals.get(g, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, totals[g]) for (i, _, g), f, e in zip(kept, found, errors)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


# ---- conversation repair --------------------------------------------------

ROLE_STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit) over (initial, fault) rows, by a search over all edits in order of cost."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        steps = [(5, "I", at, t) for t in "ua"]
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, state))
            if fault != "gone":
                more = 5 * (fault == "truncated")
                steps += [(more, "K", at + 1, initial), *((more + 1, "R", at + 1, t) for t in "ua")]
        for price, edit, to, terminal in steps:
            if (state, terminal) in ROLE_STEPS:
                heapq.heappush(heap, (cost + price, audit + edit, to, ROLE_STEPS[state, terminal]))


def damage(conv, turn, role, text):
    """The rows that one row becomes."""
    space = " "
    what = zlib.crc32(f"{space if conv is None else conv}:{space if turn is None else turn}".encode()) % 20
    role, text = space if role is None else role, space if text is None else text
    text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
    return [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)


def conversation(rows):
    """(turn, role, text) rows in order -> the columns of the contract."""
    turns = sorted({t for t, _, _ in rows if t is not None})
    gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen
                      else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:]))
    cost, audit = cheapest([(r[:1], "gone" if f in ("blank", "duplicate") else f) for (_, r, _), f in zip(rows, faults)])
    state, left, out = "", iter(rows), []
    for edit in audit:
        _, role, text = (None, "", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        if edit != "K":
            role = "user" if (state, "u") in ROLE_STEPS else "assistant"
        state = ROLE_STEPS[state, role[:1]]
        out.append(f"{role}:{text}")
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


# ---- mixture --------------------------------------------------------------

def mix_targets(sizes, weights=(3, 1, 2), times=1.5, most=2):
    """{source: size} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = times * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and weight[s] * rest / free > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else weight[s] * rest / free for s in order}
        capped |= above
