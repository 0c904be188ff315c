"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination,
personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet in the shared folder and rereads it as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.

Odd input, at every stage: an empty table gives an empty one; rows that repeat
are judged alike; extra columns pass through the first four stages, whatever
their names.  What becomes of null, empty and very long texts and of null ids
is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlift.llm import byte_bpe, decontam_bm25, jaccard_tiles, pii_bootstrap, quality_crf
from churnlift.llm.queries import VOCABULARY, labelled, table
from churnlift.llm.storage import prepare, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and hold enough content lines; null
    and empty texts and texts below ten words go."""
    prepare(spark)
    model = quality_crf.fit(labelled(docs, table(spark, sf_dir, "labels"), "quality"), "text", "label")
    return quality_crf.keep_good(docs, "text", model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 on five-word shingles,
    the one with the smallest id (a null id last); of rows equal in id and text
    the first by the other columns; texts without words all stay."""
    prepare(spark)
    return jaccard_tiles.keep_one(docs, "doc_id", "text", words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none."""
    prepare(spark)
    return decontam_bm25.keep_clean(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows
    the text (null where the text is)."""
    prepare(spark)
    return (pii_bootstrap.redact(docs, "text")
            .withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding returns its bytes; a
    null text has no ids."""
    prepare(spark, rows=300)
    ids = byte_bpe.encode(docs, "text", VOCABULARY, public_tokenizers.PATTERN, "ids")
    back = byte_bpe.decode(ids, "ids", VOCABULARY, "bytes")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontaminate), ("personal data", personal_data), ("byte-level BPE", token_ids)]

#: The stages use a trained CRF, learned patterns and merge ranks: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
