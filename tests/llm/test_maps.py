"""Operators that judge each text by itself."""

import hashlib
import math
import random
import re

import brute
import numpy as np
import public_tokenizers
import pytest
import regex
from corpus import listed

from churnlift.llm import (byte_bpe, decontam_bm25, license_zstd, pii_bootstrap, quality_crf, toxicity_counterfactual,
                           wordpiece_counts)
from churnlift.llm.queries import QUERIES, VOCABULARY


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- quality rules -------------------------------------------------------

def test_base_counts(docs, rows, no_docs):
    judged = quality_crf.judge(docs, "text", quality_crf.LineCrf(), out="v")
    assert judged.columns == docs.columns + ["v"]
    same(listed(judged, "doc_id", "v.n_words", "v.word_chars", "v.n_symbols", "v.n_dup_lines", "v.n_repeat_words",
                "v.base_failed"), [(i, *brute.quality(t)) for i, t in rows])
    assert quality_crf.keep_good(no_docs, "text", quality_crf.LineCrf()).count() == 0


def test_repeat_windows_by_brute_force():
    rng = random.Random(3)
    hashes = quality_crf.WordHashes()
    for _ in range(200):
        text = " ".join(rng.choice(["a", "b", "#c", "é|d", "\n"]) for _ in range(rng.randrange(60)))
        raw = text.encode()
        points, symbols, repeated = quality_crf.base_counts(raw, raw.split(), hashes)
        n, p, s, d, r, _ = brute.quality(text)
        assert (len(raw.split()), points, symbols, repeated) == (n, p, s, r)
        assert quality_crf.line_codes(raw)[2] == d


def test_crf_learns_boilerplate_and_keeps_content(spark):
    rng = random.Random(5)

    def prose():
        return "\n".join(" ".join(f"word{rng.randrange(900)}" for _ in range(rng.randrange(8, 20))) + "." for _ in range(6))

    def junk():
        return "\n".join(" | ".join(f"Nav{rng.randrange(99)}" for _ in range(9)) for _ in range(6))

    known = [(prose(), 1) for _ in range(30)] + [(junk(), 0) for _ in range(30)] + [(None, 1), ("", 0), (prose(), None)]
    model = quality_crf.fit(spark.createDataFrame(known, "text string, q int"), "text", "q")
    tests = [(1, prose()), (2, junk()), (3, prose() + "\n" + prose() + "\n" + junk()), (4, None)]
    df = spark.createDataFrame(tests, "doc_id long, text string")
    assert listed(quality_crf.keep_good(df, "text", model), "doc_id") == [(1,), (3,)]


def test_viterbi_is_the_best_path():
    from itertools import product
    rng = random.Random(2)
    for _ in range(50):
        model = quality_crf.LineCrf(tuple(rng.uniform(-2, 2) for _ in range(quality_crf.N_FEATURES)),
                                    tuple((rng.uniform(-2, 2), rng.uniform(-2, 2)) for _ in range(2)))
        codes = [rng.randrange(1 << 16) for _ in range(7)]

        def total(path):
            t = sum(model.transition[a][b] for a, b in zip(path, path[1:]))
            return t + sum(model.score(c) for c, y in zip(codes, path) if y)

        assert abs(total(model.viterbi(codes, {})) - max(map(total, product((0, 1), repeat=7)))) < 1e-9
    assert quality_crf.LineCrf().viterbi([], {}) == []


# ---- byte-level BPE ------------------------------------------------------

def reference_ids(text):
    return byte_bpe.encoder(VOCABULARY, public_tokenizers.PATTERN).encode_ordinary(text or "")


def test_bpe_round_trip(docs, rows, no_docs):
    out = byte_bpe.decode(byte_bpe.encode(docs, "text", VOCABULARY, public_tokenizers.PATTERN, "token_ids"),
                          "token_ids", VOCABULARY, "bytes")
    assert out.columns == docs.columns + ["token_ids", "bytes"]
    got = [(r["doc_id"], r["text"], list(r["token_ids"]), bytes(r["bytes"])) for r in out.collect()]
    same(got, [(i, t, reference_ids(t), (t or "").encode()) for i, t in rows])
    assert byte_bpe.encode(no_docs, "text", VOCABULARY, public_tokenizers.PATTERN, "token_ids").count() == 0


def test_stitched_pieces_are_encoded_alike():
    rng = random.Random(11)
    parts = ["a", "word", " ", "  ", "\n\n", "'re", "'", "12", "!?", "é", "日本", " ", "\t", "’s", "x" * 50, "." * 45, " " * 44]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(10, 80)))
        chunks = [text[i:i + 52] for i in range(0, len(text), 40)]
        starts = byte_bpe.stitch([byte_bpe.chunk_view(c, public_tokenizers.PATTERN, len(c) <= 40, 40, 12) for c in chunks], 40)
        cuts = [i * 40 + s for i, s in enumerate(starts) if s >= 0] + [len(text)]
        ids = [x for a, b in zip(cuts, cuts[1:]) for x in reference_ids(text[a:b])]
        assert ids == reference_ids(text), text


@pytest.mark.parametrize("run", [" ", "\n", "7", "a", "\u3000", "-"])
def test_runs_of_a_million_are_encoded(spark, run):
    tail = " tail's 12\n"
    df = spark.createDataFrame([(1, run * 10 ** 6 + tail), (2, "head" + run * 10 ** 6)], "i long, text string")
    out = byte_bpe.decode(byte_bpe.encode(df, "text", VOCABULARY, public_tokenizers.PATTERN, "t"), "t", VOCABULARY, "b")
    got = {r.i: (r.text.encode() == bytes(r.b), list(r.t)) for r in out.collect()}
    assert got[1][0] and got[2][0]
    enc = byte_bpe.encoder(VOCABULARY, public_tokenizers.PATTERN)
    want = [i for piece in regex.findall(public_tokenizers.PATTERN, run * 10 ** 6 + tail) for i in enc._encode_single_piece(piece)]
    assert got[1][1] == want


def test_own_matching_is_the_librarys():
    rng = random.Random(12)
    enc = byte_bpe.encoder(VOCABULARY, public_tokenizers.PATTERN)
    for run in (" ", "\n", "a", "9", "."):
        text = "".join(rng.choice(["w", " ", "\n", "1", "!", "é", "'s"]) for _ in range(500))
        text += run * (byte_bpe.LONG_RUN + 7) + text
        assert byte_bpe.piece_ids(enc, public_tokenizers.PATTERN, text).tolist() == enc.encode_ordinary(text)


def test_small_chunks_encode_the_whole_table_alike(spark, monkeypatch):
    """Every text over 400 characters goes through the chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    plain = byte_bpe.encode(docs, "text", VOCABULARY, public_tokenizers.PATTERN, "ids")
    want = {r.doc_id: list(r.ids) for r in plain.collect()}
    out = byte_bpe.encode(docs, "text", VOCABULARY, public_tokenizers.PATTERN, "ids", chunk=400, overlap=64)
    assert {r.doc_id: list(r.ids) for r in out.collect()} == want
    assert docs.where("char_length(text) > 400").count() > 500


# ---- personal data -------------------------------------------------------

def test_base_spans_by_brute_force():
    rng = random.Random(1)
    parts = ["a", "b@c.d", "@", ".", "1", "23", "+4 ", "256", "0", "-", " ", "4242424242424242", "1.2.3.4", "(", ")", "é",
             "+1 555-123-4567"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [(pii_bootstrap.KINDS[k], a, b) for k, a, b in pii_bootstrap.base_spans(text)] == brute.personal(text)
    assert pii_bootstrap.base_spans("7" * 200_000) == [] and pii_bootstrap.base_spans("a" * 200_000 + "@") == []


def test_contexts_discover_unseen_identifiers(spark):
    rng = random.Random(4)

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    seeds = [f"Please call me at {phone()} today about w{i}" for i in range(12)]
    noise = [f"the number {rng.randrange(10 ** 9)} of item w{i}" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(seeds + noise + ["You can call me at 555-867-5309 today", None, "", "no digits"])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, pii_key string")
    found = pii_bootstrap.find(df, "text", "found")
    assert found.columns == df.columns + ["found"]
    by_id = {r["doc_id"]: r["found"] for r in found.collect()}
    for i, t in rows:
        assert [(pii_bootstrap.KINDS[s["kind"]], s["start"], s["end"]) for s in by_id[i]["base"]] == brute.personal(t)
    assert [(s["kind"], s["start"], s["end"]) for s in by_id[24]["all"]] == [(3, 19, 31)] and not by_id[24]["base"]
    assert all(not by_id[i]["all"] for i in range(12, 24))
    clean = {r["doc_id"]: r["text"] for r in pii_bootstrap.redact(df, "text").collect()}
    assert clean[24] == "You can call me at [PHONE] today" and clean[25] is None and clean[26] == ""
    assert clean[0] == "Please call me at [PHONE] today about w0"


def test_personal_data_on_odd_texts(docs, rows, no_docs):
    found = pii_bootstrap.find(docs, "text", "found")
    got = [(r["doc_id"], [(pii_bootstrap.KINDS[s["kind"]], s["start"], s["end"]) for s in r["found"]["base"]])
           for r in found.collect()]
    same(got, [(i, brute.personal(t)) for i, t in rows])
    assert pii_bootstrap.redact(no_docs, "text").count() == 0


def test_personal_data_query_counts_every_kind(spark, tmp_path):
    """Counts by kind, wherever in the list of spans a kind stands."""
    texts = ["x@y.zz", "1.2.3.4", "4111 1111 1111 1111", "+1 555 123 4567", "1.2.3.4 and 5.6.7.8 and x@y.zz", "a@b.cc c@d.ee +1 555 123 4567",
             None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op4_pii_bootstrap"](spark, str(tmp_path))
    want = [(i, *(sum(k == kind for k, _, _ in brute.personal(t)) for kind in pii_bootstrap.KINDS),
             hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t)).encode()).hexdigest()) for i, t in enumerate(texts)]
    same(listed(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), want)


# ---- token counts --------------------------------------------------------

def test_piece_counts(docs, rows, no_docs):
    pieces = set(wordpiece_counts.load_pieces(VOCABULARY))
    longest = max(map(len, pieces))
    short = docs.where("text is null or length(text) < 5000")
    out = wordpiece_counts.count_tokens(short, "text", VOCABULARY)
    want = []
    for i, t in rows:
        if t is None or len(t) < 5000:
            ws = (t or "").encode().split()
            want.append((i, len(ws), sum(len(brute.greedy_pieces(b" " + w, pieces, longest)) for w in ws)))
    same(listed(out, "doc_id", "n_words", "n_tokens"), want)
    assert wordpiece_counts.count_tokens(no_docs, "text", VOCABULARY).count() == 0


def test_automaton_counts_like_greedy_matching():
    rng = random.Random(8)
    for _ in range(300):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))}
        automaton = wordpiece_counts.PieceAutomaton(pieces)
        for _ in range(20):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 12)))
            cut = brute.greedy_pieces(word, pieces, 4)
            assert automaton.count(word) == (1 if cut is None else len(cut)), (pieces, word)


# ---- toxicity ------------------------------------------------------------

def test_toxicity_learns_insults_not_groups(spark):
    rng = random.Random(9)
    tame = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(120)]
    groups = ["muslims", "christians", "jews"]
    # in the labelled texts one group is insulted most
    known = [(t + " nasty rubbish " + (groups[0] if k % 2 else groups[1]), 1) for k, t in enumerate(tame[:40])]
    known += [(t + " " + groups[k % 3], 0) for k, t in enumerate(tame[40:])]
    model = toxicity_counterfactual.fit(spark.createDataFrame(known + [(None, 1), ("x", None)], "text string, y int"), "text", "y")
    text = " ".join(f"w{k}" for k in range(60))
    scores = [model.score(f"{text} {g}") for g in groups]
    assert max(scores) < 0.3 and max(scores) - min(scores) < 0.05
    assert model.score(text + " nasty rubbish") > 0.7
    df = spark.createDataFrame([(1, None), (2, ""), (3, text + " nasty rubbish"), (3, text + " nasty rubbish")], "doc_id long, text string")
    got = toxicity_counterfactual.score(df, "text", model, "score").toPandas().sort_values("doc_id")["score"].tolist()
    assert got[0] == got[1] == model.score("") and got[2] == got[3] > 0.7


def brute_features(text):
    """Capped shares of words and word beginnings, counted one by one."""
    ws = re.findall(r"\w+", (text or "").lower())
    marks = [f for w in ws for f in [w, *[w[:k] + "~" for k in (4, 5, 6, 7) if len(w) >= k]]]
    return {f: min(1.0, marks.count(f) / len(ws) / 0.02) for f in set(marks)}


def test_toxicity_scores_by_brute_force(rows):
    rng = random.Random(31)
    texts = [t for _, t in rows if t is None or len(t) < 5000]
    names = sorted({f for t in texts for f in brute_features(t)})
    model = toxicity_counterfactual.ToxicityModel(-0.3, {f: rng.gauss(0, 1) for f in rng.sample(names, 60)})
    for t in texts:
        assert toxicity_counterfactual.features(toxicity_counterfactual.words_of(t)) == pytest.approx(brute_features(t))
        z = model.intercept + sum(model.weights.get(f, 0.0) * v for f, v in brute_features(t).items())
        assert model.score(t) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_toxicity_fit_meets_its_optimum():
    """The conditions of the minimum of loss + swap penalty + L1, on dense matrices."""
    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(8)]
    x = rng.random((60, 8)) * (rng.random((60, 8)) < 0.6)
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=60) > 0).astype(int)
    moved = np.zeros((10, 8))
    moved[:, 2], moved[:, 0] = rng.random(10), -rng.random(10)
    l1, swap = 2e-3, 0.7

    def rows_of(m):
        return [{n: float(v) for n, v in zip(names, r) if v} for r in m]
    model = toxicity_counterfactual.train(rows_of(x), rows_of(moved), y.tolist(), l1, swap, steps=20_000)
    w = np.array([model.weights.get(n, 0.0) for n in names])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    r = (1 / (1 + np.exp(-(x @ w + model.intercept))) - y) * weight
    grad = x.T @ r + moved.T @ (moved @ w) * 2 * swap / len(moved)
    assert abs(r.sum()) < 1e-6 and (w != 0).any() and (w == 0).any()
    assert np.abs(grad[w != 0] + l1 * np.sign(w[w != 0])).max() < 1e-6 and np.abs(grad[w == 0]).max() <= l1 + 1e-6
    free = toxicity_counterfactual.train(rows_of(x), [], y.tolist(), l1, swap, steps=20_000)
    change = [abs(moved @ np.array([m.weights.get(n, 0.0) for n in names])).mean() for m in (model, free)]
    assert change[0] < change[1]


def test_held_out_rows_of_the_query(spark):
    got = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.001").toPandas()
    assert list(got.held_out) == [brute.held_out(i) for i in got.doc_id] and got.held_out.any() and not got.held_out.all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()


def test_toxicity_without_labels(docs, no_docs):
    for label, want in (("null", 0.0), ("0", 0.0), ("1", 1.0)):
        model = toxicity_counterfactual.fit(docs.selectExpr("text", f"cast({label} as int) y"), "text", "y")
        assert abs(model.score("anything") - want) < 1e-9
    assert toxicity_counterfactual.score(no_docs, "text", toxicity_counterfactual.ToxicityModel()).count() == 0


# ---- licenses ------------------------------------------------------------

def test_license_wording(spark, docs, no_docs):
    filler = " ".join(f"w{k}" for k in range(300))
    rows = [(1, filler + "\nReleased under the MIT License."),
            (2, "Licensed under the Apache License, Version 2.0.\n" + filler + "\nLicensed under CC BY-NC 4.0."),
            (3, "this work is LICENSED under the gnu general public license, version 3!"),
            (4, "a driving licence is needed to drive in most places, and a fishing licence to fish"),
            (5, None), (6, ""), (7, "(Permission is hereby granted, free of charge, to any\nperson obtaining one copy of this "
                                    "software and associated documentation\nfiles) " + filler)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = license_zstd.scan(df, "text").select("doc_id", "scan.licenses").collect()
    got = {r["doc_id"]: [(x["license"], x["differences"]) for x in r["licenses"]] for r in out}
    assert got == {1: [("MIT", 0)], 2: [("Apache-2.0", 0), ("CC-BY-NC-4.0", 0)], 3: [("GPL-3.0", 0)], 4: [], 5: [], 6: [],
                   7: [("MIT-permission", 1)]}
    assert license_zstd.scan(no_docs, "text").count() == 0
    assert license_zstd.scan(docs, "text").where("scan.n_blocks > 0").count() == 0


def test_license_in_long_candidate_blocks():
    rng = random.Random(14)
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    for size in (1000, 20_000):
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        words[::50] = [rng.choice(["license", "permission"]) for _ in words[::50]]
        at = size // 2 + 7
        text = " ".join(words[:at] + ["Released under the MIT License."] + words[at:])
        n_blocks, hits = scanner.text(text)
        assert n_blocks == 1 and [(h[0], h[3]) for h in hits] == [("MIT", 0)]


def test_every_license_of_a_block_is_confirmed():
    rng = random.Random(16)
    names = ["Apache-2.0", "BSD-2-Clause", "CC-BY-NC-4.0", "GPL-3.0", "MIT", "CC0-1.0", "MIT"]
    text = "".join(license_zstd.TEMPLATES[n] + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(20)) + " " for n in names)
    n_blocks, hits = license_zstd.Scanner(license_zstd.TEMPLATES).text(text)
    assert n_blocks == 1 and sorted((h[0], h[3]) for h in hits) == sorted((n, 0) for n in names)


def license_places(scanner, words):
    """(template, differences, start, end) that the windows lead to, and all there are."""
    found = {(i, n, start + a, start + b) for i, start, end in scanner.winners(words)
             for n, a, b in license_zstd.differences(scanner.words[i], words[start:end])[1]}
    return found, {(i, *place) for i, t in enumerate(scanner.words) for place in license_zstd.differences(t, words)[1]}


def planted(rng, template, edits):
    words = list(template)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = rng.choice([["license"], ["other"], []])
    return words


def test_license_recall_on_planted_notices():
    rng = random.Random(15)
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    met = total = 0
    for template in scanner.words * 6:
        text = [f"w{rng.randrange(300)}" for _ in range(90)]
        at = rng.randrange(90)
        text[at:at] = planted(rng, template, rng.randrange(license_zstd.allowed(template) + 1))
        found, want = license_places(scanner, text)
        met, total = met + len(found & want), total + len(want)
        # what a window shows of a place that it cuts lies inside the place
        assert all(any(i == k and s < b and a < e for k, _, a, b in want) for i, _, s, e in found - want)
    assert total > 130 and met >= 0.98 * total


def test_license_recall_in_a_long_block():
    rng = random.Random(17)
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    words[::50] = [rng.choice(["license", "permission"]) for _ in words[::50]]
    for k, template in enumerate(scanner.words):
        words[k * 800 + 300:k * 800 + 300] = planted(rng, template, license_zstd.allowed(template))
    found, want = license_places(scanner, words)
    assert len({i for i, *_ in want}) >= 15 and len(found & want) >= 0.98 * len(want)


def test_license_recall_on_real_texts(spark):
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    met = total = 0
    for t in texts:
        for a, b in license_zstd.blocks(t, scanner.around):
            found, want = license_places(scanner, license_zstd.words_of(t[a:b]))
            met, total = met + len(found & want), total + len(want)
    assert total > 10 and met >= 0.98 * total


def test_license_savings_decide(monkeypatch):
    text = "x " * 50 + license_zstd.TEMPLATES["MIT-text"] + " y" * 50 + " " + license_zstd.TEMPLATES["Apache-2.0-header"]
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    # a notice that contains another saves more bytes and stays
    assert [(h[0], h[3]) for h in scanner.text(text)[1]] == [("MIT-text", 0), ("Apache-2.0-header", 0)]
    monkeypatch.setattr(scanner, "saving", lambda i, words, alone: 0)
    assert scanner.text(text)[1] == []


def test_license_windows_hold_every_place():
    scanner = license_zstd.Scanner(license_zstd.TEMPLATES)
    for length in (1, 5, 7, 40, 186):
        longest = length + int(license_zstd.MAX_DIFFERENCE * length)
        for n in (0, 1, 5, 17, 63, 500):
            windows = list(scanner.windows(length, n))
            assert all(any(a <= s and min(s + longest, n) <= b for a, b in windows) for s in range(max(n - longest, 0) + 1)), (length, n)


def test_word_differences_by_brute_force():
    rng = random.Random(6)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        t = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        b = [rng.choice("abc") for _ in range(rng.randrange(0, 9))]
        best = min(edits(t, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert license_zstd.differences(t, b)[0] == best


# ---- benchmark decontamination -------------------------------------------

def test_decontamination_finds_planted_items(spark, docs, no_docs):
    rng = random.Random(12)
    items = [(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randrange(6, 90)))) for k in range(40)]
    items += [(40, None), (41, ""), (0, items[0][1]), (None, "some item that has no id but enough words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = [" ".join(f"w{rng.randrange(2000)}" for _ in range(400)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(filler)]
    rows += [(100 + k, f"{filler[k]}\n{items[k][1].upper()}!! {filler[k + 1]}") for k in range(20)]
    rows += [(200, items[3][1][:len(items[3][1]) // 2]), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam_bm25.find(df, "text", bench, "item_id", "text").selectExpr("doc_id", "hits.item_id as items")
    got = {r["doc_id"]: set(r["items"]) for r in found.collect()}
    assert all(k in got[100 + k] for k in range(20))
    assert all(not got[k] for k in range(30)) and not got[200] and not got[201] and not got[202]
    assert decontam_bm25.find(no_docs, "text", bench, "item_id", "text").count() == 0
    clean = decontam_bm25.keep_clean(docs, "text", bench.where("item_id > 39"), "item_id", "text")
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_wand_retrieves_all_above_threshold():
    rng = random.Random(13)
    entries, items = [], {}
    for k in range(50):
        items[k] = [f"t{rng.randrange(120)}" for _ in range(rng.randrange(3, 30))]
        terms = sorted(set(items[k]))
        weight = [rng.random() for _ in terms]
        entries.append((k, [(t, w / sum(weight)) for t, w in zip(terms, weight)]))
    index = decontam_bm25.Index(entries, items)
    for _ in range(60):
        text = [f"t{rng.randrange(150)}" for _ in range(rng.randrange(0, 500))]
        want = {}
        for s in range(0, max(1, len(text) - decontam_bm25.ENTRY), decontam_bm25.PASSAGE - decontam_bm25.ENTRY):
            held = set(text[s:s + decontam_bm25.PASSAGE])
            for k, post in entries:
                score = sum(w for t, w in post if t in held)
                if score >= 0.6:
                    want[k] = max(want.get(k, 0), score)
        got = index.retrieve(text, 0.6)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_overlaps_by_brute_force(spark):
    rng = random.Random(23)
    items = [(k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(4, 80)))) for k in range(30)]

    def shares(item, text):
        """Shares of the distinct five-word runs of question and answer that stand in the text."""
        ws, body = item.split(), text.split()
        size = max(7, len(ws) // 4)
        q, a = (ws, ws) if len(ws) < size + 5 else (ws[:-size], ws[-size:])
        out = []
        for part in (q, a):
            n = min(5, len(part))
            own = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
            there = {tuple(body[i:i + n]) for i in range(len(body) - n + 1)}
            out.append(len(own & there) / len(own))
        return out
    rows = []
    for k, t in items:
        for cut in (0, 3, 9, 30):
            ws = t.split()
            rows.append((len(rows), " ".join([f"x{rng.randrange(99)}" for _ in range(40)] + ws[:max(1, len(ws) - cut)] + ["y"] * 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontam_bm25.find(df, "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    got = {(r.doc_id, h.item_id): (h.question, h.answer) for r in found.collect() for h in r.hits}
    for (doc, item), pair in got.items():
        want = shares(items[item][1], rows[doc][1])
        assert pair == pytest.approx(want) and want[0] >= 0.8 and want[1] >= 0.5
    # whole items are all there, and so is whatever keeps its words and overlaps
    assert all((4 * k, k) in got for k, _ in items) and len(got) < len(rows)


def test_rounded_bounds_close_no_block():
    score = 10.49 * 2.0 ** -11  # rounds down in single precision beside a sum of 5000
    terms = [f"t{k}" for k in range(118)]
    index = decontam_bm25.Index([(0, [(t, score) for t in terms]), (1, [("x", 1.0)])], {0: terms, 1: ["x"]})
    words = ["x"] * 5000 + ["z"] * 120 + terms + ["z"] * 10
    got = index.retrieve(words, 0.6)
    assert got.keys() == {0, 1} and abs(got[0] - 118 * score) < 1e-9


def test_one_index_shard_at_a_time(spark, monkeypatch):
    rng = random.Random(17)
    items = [(k, " ".join(f"w{rng.randrange(2000)}" for _ in range(30))) for k in range(24)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, f"{items[k][1]} {' '.join(f'w{rng.randrange(2000)}' for _ in range(50))} {items[-1 - k][1]}") for k in range(20)]
    df = spark.createDataFrame(rows + rows[:3] + [(50, None), (51, "no item here")], "key long, text string")

    def found():
        out = decontam_bm25.find(df, "text", bench, "item_id", "text")
        assert out.columns == ["key", "text", "hits"]
        return out, sorted((r["key"], sorted(h["item_id"] for h in r["hits"])) for r in out.collect())
    one = found()[1]
    monkeypatch.setattr(decontam_bm25, "SHARD", 6)
    out, several = found()
    assert several == one and len(one) == 25 and sum(len(h) for _, h in one) >= 40
    assert "lookup(" not in out._jdf.queryExecution().analyzed().toString()
