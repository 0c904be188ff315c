"""Null and NaN rules of the reference, written once as Column helpers.

The reference runs on pandas, whose missing-value rules differ from SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise float NaN to NULL in every floating column (pandas treats
    both as missing; Spark orders NaN above every number)."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
            changed = True
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs) if changed else df


def not_in_keep_null(c, values) -> Column:
    """``~s.isin(values)`` keeps rows whose value is NULL."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def count_unique_with_null(c) -> Column:
    """``unique().shape[0]`` counts NULL as one more value."""
    return F.count_distinct(col(c)) + F.max(col(c).isNull().cast("int")).cast("bigint")


def any_true(pred: Column) -> Column:
    """``(x == v).any()`` where a NULL comparison is False."""
    return F.coalesce(F.bool_or(F.coalesce(pred, F.lit(False))), F.lit(False))


def share_where(pred: Column) -> Column:
    """``(pred).sum() / len(x)`` — NULL rows stay in the denominator."""
    return F.count_if(F.coalesce(pred, F.lit(False))).cast("double") / F.count(F.lit(1)).cast("double")


def flag(pred: Column) -> Column:
    """``(x > t).astype(bool)`` with NULL/NaN comparing False."""
    return F.coalesce(pred, F.lit(False))


def null_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Pandas ``merge`` matches a NULL key with a NULL key.  ``<=>`` still
    plans as an equi-join (hash/sort-merge on the key), so it scales like ``=``."""
    r = right.withColumnRenamed(key, "__rk")
    out = left.join(r, left[key].eqNullSafe(r["__rk"]), how)
    return out.drop("__rk")


# Money and quantity aggregates are summed as DECIMAL: line values of the
# reference's data (2-decimal prices, rates and integer quantities
# multiplied together) lie exactly on a 6-decimal grid, so the sums are
# exact and do not depend on summation order — re-executed tasks and other
# engines produce bit-identical results.  A line value is DECIMAL(18, 6)
# (up to 10^12 per line, stored as a long: the fast path); Spark widens the
# sum to DECIMAL(28, 6), room for 10^22 per key, and ANSI mode fails
# loudly rather than wrapping if that were ever exceeded.
MONEY_SCALE = 6
MONEY_PRECISION = 18


def money(c, scale: int = MONEY_SCALE) -> Column:
    return col(c).cast(T.DecimalType(MONEY_PRECISION, scale))


def exact_sum(c, scale: int = MONEY_SCALE) -> Column:
    """N5 with exact arithmetic: DECIMAL sum, 0 for an all-NULL group."""
    return F.coalesce(F.sum(money(c, scale)), F.lit(0).cast(T.DecimalType(MONEY_PRECISION + 10, scale)))


def exact_avg(c, scale: int = MONEY_SCALE) -> Column:
    """Mean skipping NULL, from the exact DECIMAL sum (one final division)."""
    return F.try_divide(F.sum(money(c, scale)).cast("double"), F.count(col(c)).cast("double"))


def as_double(c) -> Column:
    return col(c).cast("double")
