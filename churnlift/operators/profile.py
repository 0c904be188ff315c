
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import count_unique_with_null


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Counts per non-NULL value, most frequent first (value breaks ties)."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.col(name).desc(), F.col(col).asc()))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """``s.unique()`` — NULL included as a value."""
    return df.select(col).distinct()


def unique_with_null(df: DataFrame, cols) -> DataFrame:
    """Distinct counts where NULL counts as one value; one row."""
    return df.agg(*[count_unique_with_null(c).alias(f"{c}_unique") for c in cols])


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Number of NULL values per column, long form (column, nulls)."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _unpivot(wide, cols, "column", "nulls")


def column_profile(df: DataFrame) -> DataFrame:
    """Name, type and non-NULL count of every column (``df.info()``)."""
    cols = df.columns
    wide = df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
    counts = _unpivot(wide, cols, "column", "non_null")
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string")
    return types.join(counts, on="column").select("position", "column", "dtype", "non_null")


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """A10: (table, rows, columns) for each named table; one job per table,
    unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"))
               .select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _unpivot(wide: DataFrame, cols, name_col: str, value_col: str) -> DataFrame:
    return wide.unpivot([], [F.col(c).cast("bigint").alias(c) for c in cols], name_col, value_col)
