"""Registry of named queries: key -> (Spark callable, DuckDB oracle SQL).

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the whole test tables; ``__spark_entry__`` exposes the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.binding import with_ctes


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = Entry(fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def normalized(df: DataFrame) -> DataFrame:
    """Presentation step: IEEE -0.0 -> 0.0 in double columns, decimals to
    double (the oracle engine reports averages of decimals as DOUBLE)."""
    return df.select(*[
        (F.col(f.name).cast("double") + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)) else F.col(f.name)
        for f in df.schema.fields])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Presentation step for outputs of inherently inexact float arithmetic
    (variances, model scores): doubles rounded to ``places``."""
    return df.select(*[
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def oracle(ctes: dict[str, str], body: str) -> str:
    return with_ctes(body, ctes)
