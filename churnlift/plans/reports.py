"""

Reports that return whole rows are Spark SQL: tables are passed as DataFrame
arguments of ``spark.sql`` (no global view state) and values as named
parameters (never string formatting).  "From this year on" is a range on the
date, so that, on a stored date column, it reaches the parquet scan as a
pushed filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECENT_ORDERS = """
SELECT *
FROM {order_details}
WHERE ORDER_DATE >= CAST(:since AS TIMESTAMP_NTZ)
ORDER BY ORDER_TIMESTAMP DESC NULLS LAST, ORDER_ID, LINE_NO
"""

RECENT_OPERATIONS = """
SELECT *
FROM {operation_details}
WHERE CAST(ORDER_DATE AS TIMESTAMP_NTZ) >= CAST(:since AS TIMESTAMP_NTZ)
ORDER BY ORDER_DATE ASC NULLS LAST, ORDER_TIME DESC NULLS LAST, ORDER_ID
"""

SELECT_ALL = "SELECT * FROM {table}"


def _actives(order_details: DataFrame, start_year: int, **period) -> DataFrame:
    """Distinct customers and devices of Valid orders in each period."""
    since = F.make_timestamp_ntz(F.lit(start_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    valid = order_details.where((F.col("ORDER_DATE") >= since) & (F.col("ORDER_STATE_FINAL") == "Valid"))
    parts = [part("ORDER_DATE").cast("bigint").alias(name) for name, part in period.items()]
    return (valid.groupBy(*parts).agg(F.count_distinct("CUSTOMER_ID").alias("UNIQUE_CUSTOMERS"),
                                      F.count_distinct("DEVICE_ID").alias("UNIQUE_DEVICES"))
            .sort(*[F.asc_nulls_last(name) for name in period]))


def yearly_actives(order_details: DataFrame, start_year: int = 2022) -> DataFrame:
    """Q1: distinct customers and devices per year, Valid orders."""
    return _actives(order_details, start_year, ORDER_YEAR=F.year)


def monthly_actives(order_details: DataFrame, start_year: int = 2022) -> DataFrame:
    """Q2/Q3: distinct customers and devices per month from ``start_year``."""
    return _actives(order_details, start_year, ORDER_YEAR=F.year, ORDER_MONTH=F.month)


def recent_orders(spark: SparkSession, order_details: DataFrame, since: str = "2025-01-01") -> DataFrame:
    """Q4: every column of orders on or after ``since``, newest first."""
    return spark.sql(RECENT_ORDERS, args={"since": since}, order_details=order_details)


def recent_operations(spark: SparkSession, operation_details: DataFrame, since: str = "2025-01-01") -> DataFrame:
    """Q5: operations on or after ``since``; date ascending, time descending."""
    return spark.sql(RECENT_OPERATIONS, args={"since": since}, operation_details=operation_details)


def select_all(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Q6: full-table select."""
    return spark.sql(SELECT_ALL, table=table)


def customer_discount_lines(cleaned: DataFrame, customer_id) -> DataFrame:
    """Q7: one customer's lines with the discount breakdown that cleaning adds,
    newest first.  Columns the source lacks (delivery price, discount, gross)
    come out NULL."""
    lines = cleaned.filter(F.col("CUSTOMER_ID") == F.lit(customer_id))

    def present(c):
        return F.col(c) if c in lines.columns else F.lit(None).cast("double").alias(c)

    return (lines.sort(F.desc_nulls_last("ORDER_TIMESTAMP"), "ORDER_ID", "LINE_NO")
            .select("ORDER_ID", "ORDER_TIMESTAMP", "UNIT_QUANTITY", "UNIT_LIST_PRICE", "UNIT_OFFERED_PRICE",
                    "UNIT_CHARGED_PRICE", present("UNIT_DELIVERY_PRICE"), present("UNIT_DISCOUNT"), present("UNIT_GROSS"),
                    "UNIT_ORGANIC_DISCOUNT", "UNIT_EXTRA_DISCOUNT",
                    F.col("UNIT_TOTAL_ORGANIC_DISCOUNT").alias("UNIT_ORGANIC_DISCOUNT_TOTAL"),
                    F.col("UNIT_TOTAL_EXTRA_DISCOUNT").alias("UNIT_EXTRA_DISCOUNT_TOTAL"), "UNIT_NET"))
