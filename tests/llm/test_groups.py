"""Operators that compare texts, and the pipeline."""

import hashlib
import math
import random

import brute
import numpy as np
import pytest
from corpus import listed
from pyspark.sql import functions as F

import corpus_pipeline
from churnlift.llm import hash_tree, jaccard_tiles, substring_sketch, text
from churnlift.llm.components import components
from churnlift.llm.queries import QUERIES


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_grams_are_equal_only_for_equal_words():
    rng = random.Random(0)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    h = text.WordHashes().of(words)
    for n in (1, 2, 3, 5, 8, 35):
        g = text.grams(h, n)
        runs = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        assert len(g) == len(runs) and len(set(g.tolist())) == len(set(runs))
        assert all((g[i] == g[j]) == (runs[i] == runs[j]) for i in range(40) for j in range(i))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(7, 7)]
    root = brute.roots(200, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for link in links for x in link}
    assert got.keys() == nodes
    assert all(got[v] == min(u for u in nodes if root[u] == root[v]) for v in nodes)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_tile(percent):
    rng = np.random.default_rng(percent)
    rule = jaccard_tiles.Rule(percent)
    for size in [5, 9, 10, 19, 20, 33, 50, 120, 400, 1500]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2 ** 63, size).astype(np.uint64) * np.uint64(2))
            common = rng.integers(int(size * percent / 100), size + 1)
            extra = rng.integers(0, size // 5 + 1)
            b = np.unique(np.concatenate((a[rng.permutation(len(a))[:common]],
                                          rng.integers(0, 2 ** 63, extra).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
            both = len(np.intersect1d(a, b))
            bound = jaccard_tiles.overlap_bound(jaccard_tiles.bitmap(a), jaccard_tiles.bitmap(b), len(a), len(b))
            assert bound >= both
            if rule.linked(both, len(a), len(b)) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard_tiles.tiles(a, percent), jaccard_tiles.tiles(b, percent)))


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, docs, rows, words, percent):
    out = jaccard_tiles.join(docs, "doc_id", "text", words, percent)
    same(listed(out, "id", "size", "component"), brute.jaccard(rows, words, percent))


def test_jaccard_hub_and_chains(spark, monkeypatch):
    """Copies of a hub that are not linked to each other, a chain, and a group
    below the threshold; the blocks have to finish what hubs leave."""
    monkeypatch.setattr(jaccard_tiles, "STAR_ROUNDS", 1)
    monkeypatch.setattr(jaccard_tiles, "BLOCK", 3)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]

    def edited(ws, n):
        ws = list(ws)
        for k in rng.sample(range(len(ws)), n):
            ws[k] = f"e{rng.randrange(10 ** 6)}"
        return ws

    group = [base] + [edited(base, 4) for _ in range(12)]
    chain = [[f"c{rng.randrange(5000)}" for _ in range(300)]]
    for _ in range(8):
        chain.append(edited(chain[-1], 3))
    loose = [f"l{rng.randrange(5000)}" for _ in range(300)]
    apart = [edited(loose, 14) for _ in range(10)]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(group + chain + apart + group[:3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(listed(jaccard_tiles.join(df, "doc_id", "text", 3, 90), "id", "size", "component"), brute.jaccard(rows, 3, 90))


def test_keep_one_of_each_group(docs, rows, no_docs):
    kept = jaccard_tiles.keep_one(docs, "doc_id", "text", 5, 80)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    sets = [brute.shingles(t, 5) for _, t in rows]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
             if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = brute.roots(len(rows), links)
    best = {}
    for (i, t), s, r in zip(rows, sets, root):
        if s:
            key = (i is None, i or 0, t)
            best[r] = min(best.get(r, key), key)
    same(got, [(None if b[0] else b[1], b[2]) for b in best.values()] + [(i, t) for (i, t), s in zip(rows, sets) if not s])
    assert jaccard_tiles.keep_one(no_docs, "doc_id", "text").count() == 0
    assert jaccard_tiles.join(no_docs, "doc_id", "text").count() == 0


@pytest.mark.parametrize("cells, hot_rows", [(None, 20_000), (substring_sketch.SEGMENT, 0)])
def test_repeated_windows(spark, docs, rows, no_docs, cells, hot_rows):
    # a smaller sketch may send more windows on, anchors may be taken apart: no result changes
    out = substring_sketch.remove_repeats(docs, "doc_id", "text", 35, cells, hot_rows)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in out.collect()]
    same(got, brute.windows(rows, 35))
    if cells is None:
        assert substring_sketch.remove_repeats(no_docs, "doc_id", "text").count() == 0


def test_repeats_inside_a_text_and_across_batches(spark):
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(2500):
        ws = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 50))]
        rows.append((i, " ".join(ws + passage[i % 20:] if i % 3 == 0 else ws + ws if i % 50 == 1 else ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.windows(rows, 35)
    for hot_rows in (20_000, 5):
        out = substring_sketch.remove_repeats(df, "doc_id", "text", 35, hot_rows=hot_rows)
        same([(r["doc_id"], r["n_words"], r["n_removed"], brute.sha(r["kept"])) for r in out.collect()], want)


def test_cells_follow_the_bytes(spark):
    small = spark.createDataFrame([("a" * 100,), (None,)], "text string")
    large = spark.range(300).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    assert substring_sketch.cells_for(small) == substring_sketch.SEGMENT
    # 300 MB, 3.5 million anchors, 8 cells each
    assert substring_sketch.cells_for(large) == 1 << 25


def test_hash_tree_moves_rows_only_into_what_grows(spark, docs, no_docs):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    small, grown = hash_tree.uniform_tree(8), hash_tree.uniform_tree(9)
    placed = hash_tree.assign(hash_tree.assign(keys, "doc_id", small, "a"), "doc_id", grown, "b").toPandas()
    assert set(placed.b[placed.a != placed.b]) == {8}
    share = placed.groupby("b").size()
    assert share.min() > 20_000 / 9 * 0.85 and share.max() < 20_000 / 9 * 1.15
    # a heavier shard draws rows into its rack and region; other subtrees only lose
    heavy = [hash_tree.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in small]
    placed["c"] = hash_tree.assign(keys, "doc_id", heavy, "c").toPandas()["c"]
    moved = placed[placed.a != placed.c]
    assert set(moved.c) == {5} and len(moved)
    # the law holds for every number of shards
    for n in range(1, 14):
        placed["d"] = hash_tree.assign(keys, "doc_id", hash_tree.uniform_tree(n), "d").toPandas()["d"]
        placed["e"] = hash_tree.assign(keys, "doc_id", hash_tree.uniform_tree(n + 1), "e").toPandas()["e"]
        assert set(placed.e[placed.d != placed.e]) == {n}
    odd = hash_tree.assign(docs, "doc_id", small, "shard")
    assert odd.columns == docs.columns + ["shard"] and odd.where("shard is null").count() == 0
    assert hash_tree.number_slots(hash_tree.assign(no_docs, "doc_id", small), "shard", ["doc_id"]).count() == 0


def test_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "ROWS_PER_BUCKET", 20)
    ids = [(i, i % 7) for i in range(800)] + [(5, 5)] * 300 + [(None, None)] * 3
    df = hash_tree.assign(spark.createDataFrame(ids, "doc_id long, copies long"), "doc_id", hash_tree.uniform_tree(8))
    out = hash_tree.number_slots(df, "shard", ["doc_id", "copies"]).toPandas()
    assert len(out) == len(ids)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))


def test_places_by_brute_force(spark):
    tree = [hash_tree.Shard(s.region, s.rack, s.shard, 1.0 + s.shard % 3) for s in hash_tree.uniform_tree(10)]

    def place(key):
        """Down the levels: a node draws the least of what is below it."""
        def draw(s):
            digits = hashlib.md5(f"{'null' if key is None else key}|{s.region}/{s.rack}/{s.shard}".encode()).hexdigest()[:13]
            return -math.log((int(digits, 16) + 0.5) / 16 ** 13) / s.weight
        below = tree
        for level in (lambda s: s.region, lambda s: s.rack, lambda s: s.shard):
            nodes = {}
            for s in below:
                nodes.setdefault(level(s), []).append(s)
            below = min(nodes.values(), key=lambda leaves: min(map(draw, leaves)))
        return below[0].shard
    ids = [*range(400), None, 2 ** 60 + 1]
    got = hash_tree.assign(spark.createDataFrame([(i,) for i in ids], "k long"), "k", tree).collect()
    assert {r.k: r.shard for r in got} == {i: place(i) for i in ids}
    with pytest.raises(ValueError):
        hash_tree.assign(spark.range(3).withColumnRenamed("id", "Shard"), "Shard", tree)


def test_one_id_spreads_over_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "ROWS_PER_BUCKET", 50)
    rows = [(7, i) for i in range(1000)] + [(i, i) for i in range(1000, 3000)]
    df = hash_tree.assign(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", hash_tree.uniform_tree(8))
    out = hash_tree.number_slots(df, "shard", ["doc_id", "n"])
    assert out.count() == 3000 and out.groupBy("shard").agg((F.max("slot") + 1 == F.count("slot")).alias("ok")).where("not ok").count() == 0
    named = F.concat_ws("|", F.lit("7"), "n")
    spread = df.where("doc_id = 7").groupBy(F.substring(F.md5(named), 1, 1)).count().toPandas()["count"]
    assert spread.max() <= 3 * spread.median()


def test_sizes_shards_and_checksums_of_the_query(spark):
    src = "/root/testdata/sf0.001"
    got = QUERIES["op8_hash_tree"](spark, src).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{src}/documents.parquet").toPandas().sort_values("doc_id")
    assert [(r.size, r.text_crc32) for r in got.itertuples()] == [brute.size_and_crc(t) for t in docs.text]
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {8} and set(got["shard"]) == set(range(8)) and set(got["law"]) == {"key"}


def test_pipeline_stages(spark, tmp_path):
    """Each stage's rows against its contract on a small table."""
    import pandas as pd
    src = "/root/testdata/sf0.001"
    final = corpus_pipeline.run(spark, src).toPandas()
    docs = pd.read_parquet(f"{src}/documents.parquet")
    assert set(final.doc_id) <= set(docs.doc_id) and final.doc_id.is_unique and final.round_trip.all()
    assert (final.n_tokens == final.ids.map(len)).all()
    good = [i for i, t in zip(docs.doc_id, docs.text) if not brute.quality(t)[5]]
    assert set(final.doc_id) <= set(good)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_stand_odd_rows(spark, docs, rows, no_docs, name):
    stage, src = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    out = stage(spark, docs, src)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == docs.columns
    assert stage(spark, no_docs, src).count() == 0
    if name == "quality rules":
        kept = listed(out, "doc_id", "text")
        # (the labels of the test table belong to other texts)
        assert kept and all(pair in rows and not brute.quality(pair[1])[5] for pair in kept)
    elif name == "n-gram Jaccard join":
        assert out.where("doc_id = 5").count() == 1 and out.where("trim(coalesce(text, '')) = ''").count() >= 2
    elif name == "benchmark decontamination":
        same(listed(out, "doc_id", "text"), rows)
    elif name == "personal data":
        got = {(r.doc_id, r.n_chars) for r in out.collect()}
        assert out.count() == len(rows) and (0, None) in got and (1, 0) in got
    else:
        assert out.count() == len(rows) and out.where("not round_trip").count() == 0
        assert out.where("doc_id = 0").first()["n_tokens"] == 0


def test_one_of_equal_rows_stays_the_same(spark):
    text = " ".join(f"w{i}" for i in range(20))
    data = [(1, text, s, n) for s, n in (("b", 1), ("a", 9), ("a", 2), (None, 7))] + [(2, text + " end", "z", 0)]
    for parts in (1, 4):
        df = spark.createDataFrame(data, "doc_id long, text string, source string, n long").repartition(parts)
        assert [tuple(r) for r in jaccard_tiles.keep_one(df, "doc_id", "text").collect()] == [(1, text, None, 7)]


def test_queries_return_their_columns(spark):
    src = "/root/testdata/sf0.001"
    want = {"op1_": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
            "op2_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_": {"doc_id", "n_shingles", "component_id"},
            "op4_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
            "op6_": {"doc_id", "held_out", "score", "predicted"}, "op7_": {"doc_id", "n_words", "n_removed", "kept_sha256"},
            "op8_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}}
    for name, query in QUERIES.items():
        for start, columns in want.items():
            if name.startswith(start):
                assert columns <= set(query(spark, src).columns)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_ids_stay_whole_beside_a_null(spark, kind):
    """Ids over 2**53 and text ids, with a null in the same batch."""
    base = " ".join(f"w{i}" for i in range(60))
    big = [9007199254740993, 9007199254740995, 9007199254740996]
    ids = big if kind == "long" else [f"id-{i}" for i in big]
    rows = [(None, "no id here at all"), (ids[0], base), (ids[1], base), (ids[2], base + " end"), (None, base + " tail")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").coalesce(1)
    out = jaccard_tiles.join(df, "doc_id", "text", 3, 90)
    assert listed(out, "id", "component") == sorted([(None, None), (ids[0], ids[0]), (ids[1], ids[0]), (ids[2], ids[0]),
                                                     (None, ids[0])], key=repr)
    kept = jaccard_tiles.keep_one(df, "doc_id", "text", 3, 90)
    assert listed(kept, "doc_id") == sorted([(None,), (ids[0],)], key=repr)


def test_sets_that_share_half_a_digest_get_classes_of_their_own(spark):
    sets = spark.createDataFrame([("a", 5, 1), ("b", 5, 2), ("c", 5, 1), ("d", 6, 9), ("e", None, None)],
                                 "id string, cls long, check long")
    cls = {r["id"]: r["cls"] for r in jaccard_tiles.one_class_each(sets).collect()}
    assert cls["a"] == cls["c"] == 5 != cls["b"] and cls["d"] == 6 and cls["e"] is None
