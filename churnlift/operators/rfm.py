"""

Physical shape of ``customer_features`` (see plans/customer_features.py):
lines --dealt by (customer, order), agg--> written order level with the
categories of the lines --agg(customer)--> RFM + behaviour;
orders/lines/operations --stack+count--> (customer, attr, value)
--agg(customer)--> modes and diversities.  Every aggregate by customer is
partial/final, so a customer holding a large share of the rows is reduced
map-side, and every stage output is hash-partitioned on CUSTOMER_ID, which
lets the final joins reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.modes import attribute_values, mode_of, nunique_of, value_counts_by_key
from ..functions.nulls import any_true, as_double, exact_avg, exact_sum
from ..functions.scalar import whole_days_between

CUSTOMER = "CUSTOMER_ID"
ORDER = "ORDER_ID"
# Explicit stand-in for "first row in file order" (N9): the line with the
# smallest (LINE_NO, SKU_ID, STORE_ID), then the values themselves.
FIRST_ROW_ORDER = ("LINE_NO", "SKU_ID", "STORE_ID")
UNKNOWN = "Unknown"

RFM_COLS = ["Recency", "Frequency", "Monetary", "Total_Units", "Total_Organic_Discount",
            "Total_Extra_Discount", "Total_Discounts"]
BEHAVIOUR_COLS = ["AVG_ORGANIC_DISCOUNT_PER_ORDER", "USED_ORGANIC_DISCOUNT_RATIO",
                  "AVG_EXTRA_DISCOUNT_PER_ORDER", "USED_EXTRA_DISCOUNT_RATIO",
                  "AVG_TOTAL_DISCOUNT_PER_ORDER", "USED_TOTAL_DISCOUNT_RATIO",
                  "AVG_UNIT_QUANTITY_PER_ORDER", "IS_BULK_BUYER", "BUNDLE_PURCHASE_RATIO"]
FAVOURITE_COLS = ["FAVOURITE_STORE", "FAVOURITE_STORE_TYPE", "FAVOURITE_PAYMENT_METHOD"]
CATEGORY_COLS = ["CATEGORY_DIVERSITY", "FAVORITE_CATEGORY", "SUB_CATEGORY_DIVERSITY", "FAVORITE_SUB_CATEGORY"]


def latest_date(orders: DataFrame) -> Column:
    """A1: latest date over all cleaned lines (every state, with or without a
    customer), from the order level, as a scalar subquery."""
    return orders.agg(F.max("ORDER_MAX_DATE_ALL")).scalar()


def _line_aggs(state_col: str, valid: str, row_order) -> list[Column]:
    """Sums and flags of the Valid lines, the first Valid line, and the latest
    date of all lines."""
    v = F.coalesce(F.col(state_col) == valid, F.lit(False))

    def on_valid(c):
        return F.when(v, F.col(c))
    return [F.count_if(v).alias("_valid_lines"),
            F.max("ORDER_DATE").alias("ORDER_MAX_DATE_ALL"),
            exact_sum(on_valid("UNIT_TOTAL_ORGANIC_DISCOUNT")).alias("_organic"),
            exact_sum(on_valid("UNIT_TOTAL_EXTRA_DISCOUNT")).alias("_extra"),
            exact_sum(on_valid("UNIT_TOTAL_DISCOUNTS")).alias("_total"),
            exact_sum(on_valid("UNIT_QUANTITY")).alias("_quantity"),
            any_true(v & (F.col("SKU_IS_BUNDLE") == 1)).alias("_bundle"),
            F.min(F.when(v, F.struct(*row_order, "STORE_NAME", "PREFIX", "PAYMENT_METHOD"))).alias("_first"),
            # carried for RFM
            exact_sum(on_valid("UNIT_NET")).alias("ORDER_NET"),
            F.max(on_valid("ORDER_DATE")).alias("ORDER_LAST_DATE")]


def _order_columns(grouped: DataFrame, *more: str) -> DataFrame:
    def used(c):
        return (F.col(c) > 0).cast("bigint")
    return grouped.select(
        CUSTOMER, ORDER, "_valid_lines", "ORDER_MAX_DATE_ALL",
        F.col("_organic").alias("ORDER_TOTAL_ORGANIC_DISCOUNT"), used("_organic").alias("ORDER_TOTAL_ORGANIC_USED_DISCOUNT"),
        F.col("_extra").alias("ORDER_TOTAL_EXTRA_DISCOUNT"), used("_extra").alias("ORDER_TOTAL_EXTRA_USED_DISCOUNT"),
        F.col("_total").alias("ORDER_TOTAL_DISCOUNT"), used("_total").alias("ORDER_TOTAL_USED_DISCOUNT"),
        F.col("_quantity").alias("ORDER_UNIT_QUANTITY"), (F.col("_quantity") > 2).cast("bigint").alias("ORDER_IS_BULK"),
        F.col("_bundle").alias("ORDER_IS_BUNDLE"),
        F.col("_first.STORE_NAME").alias("STORE"), F.col("_first.PREFIX").alias("STORE_TYPE"),
        F.col("_first.PAYMENT_METHOD").alias("PAYMENT_METHOD"), "ORDER_NET", "ORDER_LAST_DATE", *more)


def order_level(cleaned: DataFrame, state_col: str = "ORDER_STATE_FINAL", valid: str = "Valid",
                row_order=FIRST_ROW_ORDER) -> DataFrame:
    """A3: per (customer, order) the sums, used/bulk/bundle flags and first
    line of the Valid lines, their number, and the latest date of all lines.
    Groups without a customer and orders without a Valid line are there too
    (the reference date needs them): ``valid_orders`` leaves them out."""
    return _order_columns(cleaned.groupBy(CUSTOMER, ORDER).agg(*_line_aggs(state_col, valid, row_order)))


def orders_with_lines(cleaned: DataFrame, state_col: str = "ORDER_STATE_FINAL", valid: str = "Valid",
                      row_order=FIRST_ROW_ORDER) -> DataFrame:
    """``order_level`` and ``_lines``, the (category, sub-category) of the Valid
    lines: the one pass over the fact from which the order level, the reference
    date, the (order, customer) pairs and the category counts all follow.  The
    lines are dealt by (customer, order) before they are grouped, as a partial
    aggregate of an order's few lines is wider than the lines."""
    v = F.coalesce(F.col(state_col) == valid, F.lit(False))
    read = [CUSTOMER, ORDER, state_col, *row_order, "ORDER_DATE", "UNIT_TOTAL_ORGANIC_DISCOUNT", "UNIT_TOTAL_EXTRA_DISCOUNT",
            "UNIT_TOTAL_DISCOUNTS", "UNIT_QUANTITY", "SKU_IS_BUNDLE", "UNIT_NET"]
    of_valid = ["STORE_NAME", "PREFIX", "PAYMENT_METHOD", "SKU_CATEGORY", "SKU_SUBCATEGORY"]
    lines = cleaned.select(*read, *[F.when(v, F.col(c)).alias(c) for c in of_valid]).repartition(CUSTOMER, ORDER)
    held = F.collect_list(F.when(v, F.struct("SKU_CATEGORY", "SKU_SUBCATEGORY"))).alias("_lines")
    return _order_columns(lines.groupBy(CUSTOMER, ORDER).agg(*_line_aggs(state_col, valid, row_order), held), "_lines")


def lines_of_orders(orders: DataFrame) -> DataFrame:
    """(customer, category, sub-category) of the Valid lines of ``orders_with_lines``."""
    return orders.select(CUSTOMER, F.inline("_lines"))


def valid_orders(orders: DataFrame) -> DataFrame:
    """Orders of a known customer with a Valid line.  NULL order ids form their
    own group here; ``behaviour`` ignores it, RFM sums keep it."""
    return orders.filter(F.col(CUSTOMER).isNotNull() & (F.col("_valid_lines") > 0))


def _rfm_aggs(ref_date: Column) -> list[Column]:
    return [F.max("ORDER_LAST_DATE").alias("_last"),
            F.count(F.col(ORDER)).alias("Frequency"),
            as_double(exact_sum("ORDER_NET")).alias("Monetary"),
            as_double(exact_sum("ORDER_UNIT_QUANTITY")).alias("Total_Units"),
            as_double(exact_sum("ORDER_TOTAL_ORGANIC_DISCOUNT")).alias("Total_Organic_Discount"),
            as_double(exact_sum("ORDER_TOTAL_EXTRA_DISCOUNT")).alias("Total_Extra_Discount"),
            as_double(exact_sum("ORDER_TOTAL_DISCOUNT")).alias("Total_Discounts")]


def _behaviour_aggs() -> list[Column]:
    def avg_real(c):  # orders with a non-NULL id only (pandas groupby drops NULL keys)
        return exact_avg(F.when(F.col(ORDER).isNotNull(), F.col(c)))
    return [avg_real("ORDER_TOTAL_ORGANIC_DISCOUNT").alias("AVG_ORGANIC_DISCOUNT_PER_ORDER"),
            avg_real("ORDER_TOTAL_ORGANIC_USED_DISCOUNT").alias("USED_ORGANIC_DISCOUNT_RATIO"),
            avg_real("ORDER_TOTAL_EXTRA_DISCOUNT").alias("AVG_EXTRA_DISCOUNT_PER_ORDER"),
            avg_real("ORDER_TOTAL_EXTRA_USED_DISCOUNT").alias("USED_EXTRA_DISCOUNT_RATIO"),
            avg_real("ORDER_TOTAL_DISCOUNT").alias("AVG_TOTAL_DISCOUNT_PER_ORDER"),
            avg_real("ORDER_TOTAL_USED_DISCOUNT").alias("USED_TOTAL_DISCOUNT_RATIO"),
            avg_real("ORDER_UNIT_QUANTITY").alias("AVG_UNIT_QUANTITY_PER_ORDER"),
            avg_real("ORDER_IS_BULK").alias("IS_BULK_BUYER"),
            exact_avg(F.when(F.col(ORDER).isNotNull(), F.col("ORDER_IS_BUNDLE").cast("int"))).alias("BUNDLE_PURCHASE_RATIO"),
            F.count(F.col(ORDER)).alias("_orders")]


def rfm_behaviour(orders: DataFrame, ref_date: Column) -> DataFrame:
    """A2 + A4 in one aggregation over the order level: RFM totals (every
    order), behaviour means (orders with an id), ``_orders`` = number of
    orders with an id (0 -> no behaviour row in the reference)."""
    out = orders.groupBy(CUSTOMER).agg(*_rfm_aggs(ref_date), *_behaviour_aggs())
    keep = [c for c in out.columns if c != "_last"]
    return out.select(*keep, whole_days_between(F.col("_last"), ref_date).alias("Recency"))


def rfm(orders: DataFrame) -> DataFrame:
    """A2: Recency (whole days from the last order to the reference date),
    Frequency (distinct orders), Monetary and unit/discount totals.  ``orders``
    is the order level of *all* cleaned lines (it holds the reference date)."""
    out = rfm_behaviour(valid_orders(orders), latest_date(orders))
    return out.select(CUSTOMER, *RFM_COLS)


def behaviour(cleaned: DataFrame) -> DataFrame:
    """A4 (+A5 for store/type/payment): per-customer means over orders and
    favourite store/type/payment."""
    orders = valid_orders(order_level(cleaned)).filter(F.col(ORDER).isNotNull())
    means = orders.groupBy(CUSTOMER).agg(*_behaviour_aggs()).drop("_orders")
    favs = favourites_from_counts(value_counts_by_key([order_attribute_values(orders)], CUSTOMER))
    return (means.join(favs, on=CUSTOMER, how="left")
                 .withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in FAVOURITE_COLS}))


def order_attribute_values(orders: DataFrame) -> DataFrame:
    return attribute_values(orders.filter(F.col(ORDER).isNotNull()), CUSTOMER,
                            {"FAVOURITE_STORE": "STORE", "FAVOURITE_STORE_TYPE": "STORE_TYPE",
                             "FAVOURITE_PAYMENT_METHOD": "PAYMENT_METHOD"})


def line_attribute_values(lines: DataFrame, weight: Column | None = None) -> DataFrame:
    return attribute_values(lines, CUSTOMER, {"CATEGORY": "SKU_CATEGORY", "SUB_CATEGORY": "SKU_SUBCATEGORY"}, weight)


def favourites_from_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(CUSTOMER).agg(*[mode_of(c).alias(c) for c in FAVOURITE_COLS])


def category_from_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy(CUSTOMER).agg(nunique_of("CATEGORY").alias("CATEGORY_DIVERSITY"),
                                        mode_of("CATEGORY").alias("FAVORITE_CATEGORY"),
                                        nunique_of("SUB_CATEGORY").alias("SUB_CATEGORY_DIVERSITY"),
                                        mode_of("SUB_CATEGORY").alias("FAVORITE_SUB_CATEGORY"))


def favourites(valid: DataFrame) -> DataFrame:
    """A5: favourite store, store type and payment method over orders."""
    orders = valid_orders(order_level(valid))
    base = orders.filter(F.col(ORDER).isNotNull()).select(CUSTOMER).distinct()
    favs = favourites_from_counts(value_counts_by_key([order_attribute_values(orders)], CUSTOMER))
    return (base.join(favs, on=CUSTOMER, how="left")
                .withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)) for c in FAVOURITE_COLS}))


def category_diversity(valid: DataFrame) -> DataFrame:
    """A6 + A5: distinct and favourite category / sub-category per customer."""
    base = valid.filter(F.col(CUSTOMER).isNotNull()).select(CUSTOMER).distinct()
    cats = category_from_counts(value_counts_by_key([line_attribute_values(valid)], CUSTOMER))
    return (base.join(cats, on=CUSTOMER, how="left")
                .select(CUSTOMER,
                        F.coalesce("CATEGORY_DIVERSITY", F.lit(0).cast("bigint")).alias("CATEGORY_DIVERSITY"),
                        F.coalesce("FAVORITE_CATEGORY", F.lit(UNKNOWN)).alias("FAVORITE_CATEGORY"),
                        F.coalesce("SUB_CATEGORY_DIVERSITY", F.lit(0).cast("bigint")).alias("SUB_CATEGORY_DIVERSITY"),
                        F.coalesce("FAVORITE_SUB_CATEGORY", F.lit(UNKNOWN)).alias("FAVORITE_SUB_CATEGORY")))
