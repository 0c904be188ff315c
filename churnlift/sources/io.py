"""Parquet/CSV scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import nan_to_null


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None,
                 nan_as_null: bool = True) -> DataFrame:
    """Scan a parquet table.  With ``schema`` the declared columns are
    checked (name and type) against the file footer, and only they are read.
    Nanosecond timestamps, which Spark reads as long under the session settings
    of ``session``, become the declared timestamp (microseconds, rounded down).  NaN becomes NULL so comparisons
    and averages follow pandas' missing-value rules.  The scan stays lazy:
    Catalyst still prunes columns and pushes filters into it."""
    df = spark.read.parquet(path)
    if schema is not None:
        have = {f.name: f.dataType for f in df.schema.fields}
        columns = []
        for f in schema.fields:
            if f.name not in have:
                raise ValueError(f"{path}: missing column {f.name}")
            if have[f.name] == T.LongType() and isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
                at = F.timestamp_micros(F.floor(F.col(f.name) / F.lit(1000)).cast("long"))
                columns.append(at.cast(f.dataType).alias(f.name))
            elif have[f.name] != f.dataType:
                raise TypeError(f"{path}: column {f.name} is {have[f.name]}, expected {f.dataType}")
            else:
                columns.append(F.col(f.name))
        df = df.select(*columns)
    return nan_to_null(df) if nan_as_null else df


def read_table(spark: SparkSession, sf_dir: str, name: str, nan_as_null: bool = True, schema: T.StructType | None = None) -> DataFrame:
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", schema, nan_as_null)


def register_views(tables: dict[str, DataFrame]) -> None:
    """S3: name DataFrames for ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink, no index column.  Each task writes its own file; the
    committer makes the output appear atomically, so a lost executor's task
    is simply retried."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# Quotes inside a field are doubled, as pandas writes them; blanks and line
# breaks inside a field are kept.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "", "emptyValue": '""',
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
               "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header line; NULL is written as an empty field."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
