"""Files as other tools write them."""

import datetime as dt
import random
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from churnlift.functions.exact import exact_double_avg, exact_double_sum
from churnlift.sources import binding
from churnlift.sources.contract import CONTRACTS, ingest
from churnlift.sources.io import read_csv, read_parquet, write_csv


def test_csv_keeps_every_character(spark, tmp_path):
    texts = ["plain", " p ", 'say "hi"', "two\nlines", "a,b", "tab\t", "back\\slash", None, "quote at end\""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    write_csv(df, str(tmp_path / "out"))
    assert sorted((r.id, r.text) for r in read_csv(spark, str(tmp_path / "out"), df.schema).collect()) == list(enumerate(texts))


def test_csv_written_by_pandas(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    pd.DataFrame({"id": [1, 2], "text": ['a "b" c', "x\ny"]}).to_csv(path, index=False)
    rows = read_csv(spark, path, T.StructType.fromDDL("id long, text string")).collect()
    assert [(r.id, r.text) for r in rows] == [(1, 'a "b" c'), (2, "x\ny")]


def test_nanosecond_timestamps(spark, tmp_path):
    path = str(tmp_path / "n.parquet")
    at = [1_700_000_000_123_456_789, -1_500, None]
    pq.write_table(pa.table({"id": [1, 2, 3], "at": pa.array(at, pa.timestamp("ns"))}), path, version="2.6")
    schema = T.StructType.fromDDL("id long, at timestamp_ntz")
    got = {r.id: r.at for r in read_parquet(spark, path, schema).collect()}
    epoch = dt.datetime(1970, 1, 1)
    assert got == {1: epoch + dt.timedelta(microseconds=1_700_000_000_123_456), 2: epoch - dt.timedelta(microseconds=2), 3: None}


def test_declared_schema_is_checked(spark, tmp_path):
    path = str(tmp_path / "s.parquet")
    pq.write_table(pa.table({"id": [1], "x": [1.5]}), path)
    assert read_parquet(spark, path, T.StructType.fromDDL("x double")).columns == ["x"]
    with pytest.raises(ValueError):
        read_parquet(spark, path, T.StructType.fromDDL("y double"))
    with pytest.raises(TypeError):
        read_parquet(spark, path, T.StructType.fromDDL("x string"))


def test_rewritten_file_is_read_anew(spark, tmp_path):
    path = str(tmp_path / "r.parquet")
    spark.range(3).write.parquet(path)
    assert read_parquet(spark, path).columns == ["id"]
    spark.range(3).selectExpr("id", "id * 2 as twice").write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).columns == ["id", "twice"]


# ---- contracts --------------------------------------------------------------

OPS = "ORDER_ID string, ORDER_DATE string, ORDER_TIME string, ORDER_STATE_FINAL string, DELIVERY_TIME string, WITHIN_SLA string, " \
      "APPROVAL_TIME string, TOTAL_DISTANCE string, EXTRA int"
GOOD = ("1", "2024-01-02 00:00:00", "10:11:12", "Valid", "1.5", "1", None, "2", 9)


def test_strict_ingestion_raises(spark):
    contract = CONTRACTS["operation_details"]
    (row,) = ingest(spark.createDataFrame([GOOD], OPS), contract).collect()
    assert row.asDict() == {"ORDER_ID": 1, "ORDER_DATE": dt.datetime(2024, 1, 2), "ORDER_TIME": "10:11:12", "ORDER_STATE_FINAL": "Valid",
                            "DELIVERY_TIME": 1.5, "WITHIN_SLA": 1, "APPROVAL_TIME": None, "TOTAL_DISTANCE": 2.0}
    for place, value, message in ((1, "02/01/2024", "ORDER_DATE: '02/01/2024' is not a timestamp_ntz"), (0, None, "ORDER_ID: NULL"),
                                  (4, "fast", "DELIVERY_TIME: 'fast' is not a double")):
        bad = GOOD[:place] + (value,) + GOOD[place + 1:]
        with pytest.raises(Exception, match=message):
            ingest(spark.createDataFrame([bad], OPS), contract).collect()
    # times are coerced, as the reference does
    coerced = GOOD[:2] + ("n/a",) + GOOD[3:]
    assert ingest(spark.createDataFrame([coerced], OPS), contract).first()["ORDER_TIME"] is None
    with pytest.raises(ValueError, match="TOTAL_DISTANCE"):
        ingest(spark.createDataFrame([GOOD], OPS).drop("TOTAL_DISTANCE"), contract)


def test_rejects_name_row_column_and_reason(spark):
    bad = ("x7", "never", "25:00:00", None, "fast", "1", None, "2", 9)
    good, rejects = ingest(spark.createDataFrame([GOOD, bad], OPS), CONTRACTS["operation_details"], "reject")
    assert [r.ORDER_ID for r in good.collect()] == [1]
    assert sorted(map(tuple, rejects.collect()), key=repr) == sorted([
        ("x7", "ORDER_ID", "x7", "not a bigint"), ("x7", "ORDER_DATE", "never", "not a timestamp_ntz"),
        ("x7", "ORDER_STATE_FINAL", None, "required"), ("x7", "DELIVERY_TIME", "fast", "not a double")], key=repr)
    with pytest.raises(ValueError):
        ingest(spark.createDataFrame([GOOD], OPS), CONTRACTS["operation_details"], "loose")


def test_binding_declares_its_schemas(spark, tmp_path):
    path = tmp_path / "nation.parquet"
    pq.write_table(pa.table({"n_nationkey": pa.array([1], pa.int64()), "n_name": ["a"], "n_regionkey": pa.array([1], pa.int32())}), path)
    with pytest.raises(TypeError, match="n_nationkey"):
        binding.raw_table(spark, str(tmp_path), "nation")
    assert set(binding.RAW_SCHEMAS) == {"nation", "customer", "supplier", "part", "orders", "lineitem", "events"}


# ---- exact sums -------------------------------------------------------------

def test_sums_of_doubles_keep_their_bits(spark):
    rng = random.Random(1)
    values = [1e13, 1e-9, -1e13, 3e-9, 12.34, 0.1, 0.2, -7.25, 1e15 + 0.5, 1 / 3, 2 ** 33 + 0.3, -1e-12]
    values += [rng.gauss(0, 10 ** rng.randrange(-9, 12)) for _ in range(800)]
    want = float(sum(map(Fraction, values)))
    seen = set()
    for parts in (1, 3, 8):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(parts)
        seen.add(tuple(df.agg(exact_double_sum("x"), exact_double_avg("x")).first()))
    assert seen == {(want, want / len(values))}
    small = spark.createDataFrame([(1, 1e13), (1, 1e-9), (1, -1e13), (2, 12.34), (2, 0.1), (2, 0.2), (3, None)], "k int, x double")
    got = {r.k: r.s for r in small.groupBy("k").agg(exact_double_sum("x").alias("s")).collect()}
    assert got == {1: 1e-9, 2: 12.64, 3: None}


def test_scratch_is_removed(spark):
    import os

    from churnlift.session import release_scratch, scratch_path
    release_scratch(spark)
    paths = [scratch_path(spark, "probe") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert os.path.isdir(paths[0]) and release_scratch(spark) == 2
    assert not os.path.exists(paths[0]) and release_scratch(spark) == 0
