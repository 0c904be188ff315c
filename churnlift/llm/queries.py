"""The text operators as queries over the test tables.

Each query applies one operator, with production parameters, to its whole
table and derives the digest columns its contract names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, conversation_repair, cube_mixture, decontam_bm25, hash_tree, jaccard_tiles, license_zstd,
               pii_bootstrap, quality_crf, substring_sketch, toxicity_counterfactual, vector_codes, wordpiece_counts)
from .storage import prepare, written

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Labelled documents that a classifier is fitted on, the smallest by hash of the id.
TRAINING_DOCUMENTS = 8_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(id, text, label) of at most ``most`` labelled ids.  The list of ids has
    that bound, so it is broadcast and no text is moved."""
    names = (labels.select(F.col("doc_id").alias("label_id"), F.col(label).alias("label")).where("label is not null")
             .orderBy(F.xxhash64("label_id"), "label_id", "label").limit(most))
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(names), texts["id"] == names["label_id"]).select("id", "text", "label")


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the CRF's verdict for every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality"), "text", "label")
    judged = quality_crf.judge(docs.select("doc_id", "text"), "text", model, out="v")
    return judged.select("doc_id", "v.n_words", "v.word_chars", "v.n_symbols", "v.n_dup_lines", "v.n_repeat_words",
                         "v.base_failed", "v.kept", "v.content_words")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    prepare(spark, rows=300)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, "text", VOCABULARY, public_tokenizers.PATTERN, "ids").select("doc_id", "ids")
    back = byte_bpe.decode(ids, "ids", VOCABULARY, "bytes")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, Jaccard 0.9."""
    prepare(spark)
    out = jaccard_tiles.join(table(spark, sf_dir, "documents"), "doc_id", "text", words=3, percent=90)
    return out.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"),
                      F.col("component").alias("component_id"))


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_bootstrap.find(docs, "text", "found")

    def joined(spans):
        name = F.element_at(F.array(*[F.lit(k) for k in pii_bootstrap.KINDS]), spans["kind"] + 1)
        return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))

    def number(k):  # the lambda takes the span alone: Spark passes the place in the array as a second argument
        return F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(pii_bootstrap.KINDS)]
    return found.select("doc_id", *counts,
                        F.sha2(F.array_join(F.transform("found.base", joined), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("found.all", joined), ",").alias("spans"))


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match pieces of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece_counts.count_tokens(docs, "text", VOCABULARY).select("doc_id", "n_words", "n_tokens")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of a third of the ids are held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    known = table(spark, sf_dir, "labels").where(~held)
    model = toxicity_counterfactual.fit(labelled(docs, known, "toxic"), "text", "label")
    scored = toxicity_counterfactual.score(docs.select("doc_id", "text"), "text", model, "score")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed by repeated 35-word windows in every document."""
    prepare(spark)
    out = substring_sketch.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text", 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards, and the shard it has of 9."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = hash_tree.assign(rows, "doc_id", hash_tree.uniform_tree(8), "shard")
    placed = hash_tree.assign(placed, "doc_id", hash_tree.uniform_tree(9), "grown_shard")
    return (hash_tree.number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], "slot")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                    "grown_shard"))


def op9_license_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate blocks and confirmed licenses of every document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = license_zstd.scan(docs, "text", out="scan")
    hits = F.col("scan.licenses")
    return scanned.select("doc_id", "scan.n_blocks", F.size(hits).cast("long").alias("n_licenses"),
                          F.array_join(hits["license"], ",").alias("licenses"),
                          F.array_join(F.transform(hits["differences"], lambda n: n.cast("string")), ",").alias("differences"),
                          F.array_join(F.transform(hits, lambda h: F.format_string("%d:%d", h["start"], h["end"])), ",")
                          .alias("blocks"))


def op10_benchmark_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document, test item) of every verified overlap."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam_bm25.find(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text", "hits")
    return (found.select("doc_id", F.explode("hits").alias("h"))
            .select("doc_id", "h.item_id", F.round("h.score", 6).alias("score"),
                    F.round("h.question", 6).alias("question_overlap"), F.round("h.answer", 6).alias("answer_overlap")))


def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes and errors of every usable vector, errors per label, digest of the codebooks."""
    prepare(spark, rows=10_000)
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"),
                                         "vec_id", "embedding", parts=16, entries=64, rounds=2, scale=256)
    hexes = F.transform("code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0"))
    coded = written(coded.withColumn("code", F.array_join(hexes, "")), "vector-codes")
    return (vector_codes.with_group_total(coded, "label", "error", "label_error")
            .select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256")))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations after the damage that op12 prescribes; ``copies`` is 0
    for a dropped row and 2 for a repeated one."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(what == 1, "").when(what == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return conversations.select("conv_id", "turn", F.when(what == 4, "user").otherwise(plain("role")).alias("role"),
                                text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))


def op12_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired text of every damaged conversation."""
    prepare(spark)
    rows = damaged(table(spark, sf_dir, "conversations"))
    names = ("conv_id", "turn", "role", "text", "copies")
    verdicts = conversation_repair.repair(rows, *names)
    return conversation_repair.digests(rows, verdicts, *names)


def op13_cube_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of one and a half times all words takes of every document."""
    prepare(spark)
    mixed = cube_mixture.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", (3, 1, 2), percent=150, most=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {f.__name__: f for f in (
    op1_line_crf, op2_byte_bpe, op3_ngram_jaccard, op4_pii_bootstrap, op5_wordpiece_counts, op6_toxicity,
    op7_repeated_windows, op8_hash_tree, op9_license_zstd, op10_benchmark_bm25, op11_orchard_codes, op12_glr_repair,
    op13_cube_mixture)}


def _codes_sql() -> str:
    """Every part against every entry, in place of the search."""
    def assign(book: str) -> str:
        return f"""
  select vec_id, label, p, min_by(k, (d, k)) as k, min(d) as d from (
    select q.vec_id, q.label, q.p, c.k, sum((q.x - c.x) * (q.x - c.x)) as d
    from flat q join {book} c on q.p = c.p and q.j = c.j group by all) t group by all"""

    def moved(book: str, assigned: str) -> str:
        return f"""
  select c.p, c.j, c.k, coalesce(m.x, c.x) as x from {book} c left join (
    select f.p, f.j, a.k, cast(floor(sum(f.x)::hugeint::double / count(*)) as bigint) as x
    from flat f join {assigned} a on a.vec_id = f.vec_id and a.p = f.p group by all) m
  on m.p = c.p and m.j = c.j and m.k = c.k"""
    return f"""
with kept as (
  select vec_id, label, embedding as e from embeddings where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
flat as (
  select vec_id, label, i // (n // 16) as p, i % (n // 16) as j, cast(floor(256 * x::double) as bigint) as x from (
    select vec_id, label, len(e) as n, unnest(e) as x, unnest(range(len(e))) as i from kept) t),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as k from kept order by vec_id limit 64),
b0 as (select f.p, f.j, s.k, f.x from flat f join seeds s on s.vec_id = f.vec_id),
a0 as ({assign("b0")}),
b1 as ({moved("b0", "a0")}),
a1 as ({assign("b1")}),
b2 as ({moved("b1", "a1")}),
a2 as ({assign("b2")}),
coded as (
  select vec_id, label, string_agg(printf('%02x', k), '' order by p) as code, sum(d)::bigint as error from a2 group by all)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(x::varchar, ',' order by p, k, j)) from b2) as codebooks_sha256
from coded"""


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
g as (
  select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0) t),
n as (select doc_id, count(*) as n from g group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as c from g x join g y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (
  select a, b from common join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 90 * (p.n + q.n - c)),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join links l on r.b = l.a)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id
from documents d join reach r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op7_repeated_windows": r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s
  from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) >= 35) t),
twice as (select s from win group by s having count(*) > 1),
gone as (
  select distinct doc_id, i + k as p from (
    select doc_id, i, unnest(range(35)) as k from win join twice using (s)) t),
kept as (
  select t.doc_id, string_agg(t.word, ' ' order by t.p) as kept, count(*) as n
  from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w) t
  left join gone on gone.doc_id = t.doc_id and gone.p = t.p where gone.p is null group by t.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(kept.n, 0) as bigint) as n_removed,
  sha256(coalesce(kept.kept, '')) as kept_sha256
from w left join kept on kept.doc_id = w.doc_id""",
    "op11_orchard_codes": _codes_sql(),
}
