"""Vector codes, conversation repair and source mixture against brute force."""

import random
import re

import brute
import numpy as np
import pytest
from corpus import listed

from churnlift.llm import conversation_repair, cube_mixture, queries, role_grammar, vector_codes

# ---- vector codes ---------------------------------------------------------


@pytest.mark.parametrize("width, entries", [(4, 64), (1, 7), (9, 20)])
def test_orchard_finds_the_nearest_entry(width, entries):
    rng = np.random.default_rng(width)
    books = rng.integers(-300, 300, (5, entries, width))
    books[:, -1] = books[:, 0]  # equal entries: the lower index wins
    books[1, :, 0] = 7
    x = rng.integers(-400, 400, (3000, 5, width))
    x[:200] = books[:, rng.integers(0, entries, 200)].transpose(1, 0, 2)
    index, squared = vector_codes.Orchard(vector_codes.Codebooks(books)).nearest(x)
    full = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
    assert (index == full.argmin(2)).all() and (squared == full.min(2)).all()


def test_walks_visit_a_part_of_the_entries(monkeypatch):
    rng = np.random.default_rng(1)
    books = vector_codes.Codebooks(rng.integers(-3000, 3000, (4, 256, 2)))
    search = vector_codes.Orchard(books)
    measured = []
    plain = np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: (measured.append(len(a)), plain(how, a, b))[1])
    search.nearest(rng.integers(-3000, 3000, (500, 4, 2)))
    assert sum(measured) < 500 * 4 * 256 / 8


def vectors():
    rng = random.Random(4)
    rows = [(i * 3 + 1, [rng.uniform(-2, 2) for _ in range(32)], rng.choice([None, 0, 0, 0, 1])) for i in range(150)]
    rows += [(None, rows[0][1], 5), (1, rows[1][1], 5), rows[2], rows[2], (2, None, 0), (5, [], 0), (8, [1.0, None] * 16, 0),
             (11, [float("nan")] * 32, 1), (14, [float("-inf")] * 32, 1)]
    return rows


def test_codes_by_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors()],
                               "vec_id long, embedding array<double>, label int, code_ string, cell int").repartition(4)
    coded, books = vector_codes.compress(df, "vec_id", "embedding", entries=64)
    assert coded.columns == ["vec_id", "label", "code_", "cell", "code", "error"]
    totals = vector_codes.with_group_total(coded, "label", "error", "label_error")
    got = [(r.vec_id, "".join(f"{k:02x}" for k in r.code), r.error, r.label_error) for r in totals.collect()]
    want, sha = brute.codes(vectors())
    assert sorted(got, key=repr) == sorted(want, key=repr) and books.sha256 == sha


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 16, 1)]):
        coded, _ = vector_codes.compress(spark.createDataFrame(rows, schema), "vec_id", "embedding")
        assert coded.count() == 0 or rows[0][0] is None
    few = spark.createDataFrame([(2, [1.0] * 16, 1), (1, [3e38] * 16, 1), (3, [1.0] * 15, 1), (4, [0.0] * 16, 1)], schema)
    coded, books = vector_codes.compress(few, "vec_id", "embedding")
    assert listed(coded, "vec_id") == [(1,), (2,), (4,)] and books.entries.shape == (16, 3, 1)
    assert books.entries.max() == vector_codes.LIMIT
    with pytest.raises(ValueError, match="already"):
        vector_codes.encode(few.withColumnRenamed("label", "Code"), "embedding", books)
    with pytest.raises(ValueError, match="cannot be cut"):
        vector_codes.compress(few, "vec_id", "embedding", parts=3)


# ---- conversation repair --------------------------------------------------

FAULT = {role_grammar.SOUND: "", role_grammar.TRUNCATED: "truncated", role_grammar.BROKEN: "gone"}


def test_repairs_are_the_cheapest_and_least():
    rng = random.Random(1)
    repairs = role_grammar.Repairs()
    for _ in range(3000):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randrange(9))]
        want = brute.cheapest([(i, FAULT[f]) for i, f in rows])
        frontier = {0: (0, "")}
        cut = rng.randrange(len(rows) + 1)
        for row in rows[:cut]:
            frontier = repairs.over(frontier, *row)
        segment = {top: {top: (0, "")} for top in repairs.stacks}
        for row in rows[cut:]:
            segment = {top: repairs.over(f, *row) for top, f in segment.items()}
        best = repairs.best(repairs.joined(frontier, segment))
        assert best == want
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in repairs.apply(best[1], [(i, "") for i, _ in rows])))


def talks():
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Well", "", " \n", "Why?", "So it is. ", "So it is. ", None, "é" * 3 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "sage"]), rng.choice(texts))
            for c in [*range(60), None] for t in range(rng.randrange(1, 7))]
    long = [(77, t, "user" if t % 2 else "assistant", f"Line {t}." if t % 5 else rng.choice(texts)) for t in range(300)]
    return rows + long + [(78, None, "user", "Hm."), (78, 3, "assistant", "Hm."), (79, None, "user", "a."), (80, 2 ** 60 + 1, "user", "b.")]


@pytest.mark.parametrize("segment", [4096, 7])
def test_conversations_by_brute_force(spark, segment):
    want = {}
    for conv, turn, role, text in talks():
        want.setdefault(conv, []).extend(brute.damage(conv, turn, role, text))
    want = [(c, *brute.conversation(rows)) for c, rows in want.items()]
    df = spark.createDataFrame([(*r, "clash", 1) for r in talks()],
                               "conv_id long, turn long, role string, text string, conv string, line int").repartition(5)
    rows = queries.damaged(df)
    names = ("conv_id", "turn", "role", "text", "copies")
    verdicts = conversation_repair.repair(rows, *names, segment=segment)
    out = conversation_repair.digests(rows, verdicts, *names)
    got = listed(out, "conv_id", *conversation_repair.COUNTS, "audit", "repaired_sha256")
    assert got == sorted(want, key=repr)
    fixed = conversation_repair.repaired(rows, verdicts, *names).orderBy("place").collect()
    texts = {}
    for r in fixed:
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: brute.sha("\n".join(texts.get(c, []))) for c, *_ in want} == {w[0]: w[-1] for w in want}


def test_equal_rows_and_ties(spark):
    rows = [(1, 1, "user", "Same.")] * 5 + [(1, 2, "assistant", "Same."), (1, 2, "assistant", "Other.")]
    df = spark.createDataFrame(rows, "c int, t long, r string, x string")
    (got,) = conversation_repair.repair(df, "c", "t", "r", "x").collect()
    assert (got.c, got.gaps, got.duplicate, got.illegal, got.cost, got.audit) == (1, 0, 4, 5, 10, "KDDDDDK")
    empty = conversation_repair.repair(df.limit(0), "c", "t", "r", "x")
    assert empty.count() == 0 and conversation_repair.digests(df.limit(0), empty, "c", "t", "r", "x").count() == 0


# ---- mixture --------------------------------------------------------------

def test_flight_keeps_the_totals():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 500):
        size = rng.integers(0, 400, n).tolist()
        p = np.full(n, 0.37)
        if n > 100:
            size[7] = 20_000  # the others can make up for it
            cube_mixture.settle_large(np.array(size), p, rng)
            assert p[7] in (0.0, 1.0) and p.sum() == pytest.approx(0.37 * n)
        start = p.copy()
        p = p.tolist()
        left = cube_mixture.flight(size, p, 2, rng)
        assert len(left) <= 2 and all(x in (0.0, 1.0) for j, x in enumerate(p) if j not in left)
        assert np.dot(p, size) == pytest.approx(np.dot(start, size)) and sum(p) == pytest.approx(start.sum())


def test_large_documents_are_made_up_for():
    import pyarrow as pa
    drawn = []
    for seed in range(2000):
        table = pa.table({"rank": [1, 1], "size": [500, 300], "mark": [5, 6], "block": [0, 0], "n": [1, 2], "p": [0.4, 0.4], "source_size": [5000] * 2})
        out = cube_mixture._settle_first(table, seed).to_pylist()
        left = out.pop()
        assert left["n"] == 0 and sum(r["n"] for r in out) == 3
        words = sum(r["size"] * r["n"] * r["extra"] for r in out)
        assert words + left["p"] * (5000 - 1100) == pytest.approx(2000)
        drawn.append(left["p"])
    assert np.mean(drawn) == pytest.approx(0.4, abs=0.005)


def test_draws_keep_the_probabilities():
    size = [3, 50, 7, 7, 90, 12, 31, 60, 5, 44, 23, 17]
    drawn = np.zeros(len(size))
    for seed in range(4000):
        p = [0.3] * len(size)
        cube_mixture.flight(size, p, 2, np.random.default_rng(seed))
        drawn += p
    assert np.abs(drawn / 4000 - 0.3).max() < 0.03


@pytest.mark.parametrize("chunk", [4096, 16])
def test_mixture_meets_the_targets(spark, monkeypatch, chunk):
    monkeypatch.setattr(cube_mixture, "CHUNK", chunk)
    monkeypatch.setattr(cube_mixture, "BLOCK", 8)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 200)), rng.choice(["a", "a", "a", "b", "é", None])) for i in range(900)]
    rows += [(5000, "x " * 3000, "b"), (5001, None, "a"), (5002, "", "empty"), (None, "no id", "a")] + [(6000, "one two", "a")] * 70
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, text string, source string, size int, copies int")
    got = cube_mixture.mix(df.repartition(3), "id", "text", "source").collect()
    assert sorted((str(r.id), r.size, str(r.source)) for r in got) == sorted((str(i), len(brute.words(t)), str(s)) for i, t, s in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.mix_targets(sizes)
    for s, target in want.items():
        mine = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[s] and r.taken == r.copies * r.size <= 2 * r.size
                   for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 5 + target / 1000, s
    again = cube_mixture.mix(df.repartition(7), "id", "text", "source").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_mixture_of_odd_tables(spark, docs, no_docs):
    assert cube_mixture.mix(no_docs, "doc_id", "text", "source").count() == 0
    assert cube_mixture.mix(docs, "doc_id", "text", "source").count() == docs.count()
    blank = spark.createDataFrame([(1, None, None), (2, " ", "b")], "id long, text string, source string")
    assert listed(cube_mixture.mix(blank, "id", "text", "source"), "target", "taken") == [(0.0, 0), (0.0, 0)]
    with pytest.raises(ValueError):
        cube_mixture.mix(blank, "id", "text", "source", percent=201)
