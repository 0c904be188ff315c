
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.modes import attribute_values, mode_of, padded, value_counts_by_key
from ..functions.exact import exact_double_avg
from ..functions.nulls import share_where
from ..functions.scalar import hour_of_text_time, weekday_name
from .clean import operations_customer

CUSTOMER = "CUSTOMER_ID"
OPS_COLS = ["AVG_DELIVERY_TIME", "SLA_VIOLATION_RATE", "AVG_APPROVAL_TIME", "AVG_TOTAL_DISTANCE",
            "FAVORITE_WEEKDAY", "FAVORITE_HOUR"]


def with_weekday_hour(ops: DataFrame, date_col: str = "ORDER_DATE", time_col: str = "ORDER_TIME") -> DataFrame:
    """weekday name of the date, hour of the ``HH:mm:ss`` text time
    (NULL when it does not parse)."""
    return ops.withColumns({"WEEKDAY": weekday_name(date_col), "HOUR": hour_of_text_time(time_col)})


def valid_customer_operations(ops: DataFrame, cleaned: DataFrame | None, pairs: DataFrame | None = None) -> DataFrame:
    """Valid operations that found a customer through the cleaned lines
    (or through already distinct (order, customer) ``pairs``)."""
    if pairs is not None:
        oc = with_weekday_hour(ops.join(pairs, on="ORDER_ID", how="left"))
    else:
        oc = with_weekday_hour(operations_customer(ops, cleaned))
    return oc.filter((F.col("ORDER_STATE_FINAL") == "Valid") & F.col(CUSTOMER).isNotNull())


def operation_numeric_aggs():
    return [exact_double_avg("DELIVERY_TIME").alias("AVG_DELIVERY_TIME"),
            share_where(F.col("WITHIN_SLA") == 0).alias("SLA_VIOLATION_RATE"),
            exact_double_avg("APPROVAL_TIME").alias("AVG_APPROVAL_TIME"),
            exact_double_avg("TOTAL_DISTANCE").alias("AVG_TOTAL_DISTANCE")]


def operation_attribute_values(vops: DataFrame) -> DataFrame:
    return attribute_values(vops, CUSTOMER, {"FAVORITE_WEEKDAY": "WEEKDAY", "FAVORITE_HOUR": padded("HOUR")})


def operation_modes(counts: DataFrame) -> list:
    return [mode_of("FAVORITE_WEEKDAY").alias("FAVORITE_WEEKDAY"),
            mode_of("FAVORITE_HOUR").cast("bigint").alias("FAVORITE_HOUR")]


def operational_features(ops: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Mean delivery/approval time and distance, SLA violation share
    (NULL SLA stays in the denominator), favourite weekday and hour."""
    vops = valid_customer_operations(ops, cleaned)
    nums = vops.groupBy(CUSTOMER).agg(*operation_numeric_aggs())
    modes = value_counts_by_key([operation_attribute_values(vops)], CUSTOMER).groupBy(CUSTOMER).agg(
        *operation_modes(None))
    return (nums.join(modes, on=CUSTOMER, how="left")
                .withColumns({"FAVORITE_WEEKDAY": F.coalesce("FAVORITE_WEEKDAY", F.lit("Unknown")),
                              "FAVORITE_HOUR": F.coalesce("FAVORITE_HOUR", F.lit(-1).cast("bigint"))})
                .select(CUSTOMER, *OPS_COLS))
