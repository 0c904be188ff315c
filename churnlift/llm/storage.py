"""Session settings of the text operators and tables written between passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Rows and bytes of one Arrow batch handed to Python; bounds a worker's memory.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches: texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage at a copy that every executor can read, and gives the
    optimiser the table's real size, so it broadcasts the small ones only.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use (names match without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
