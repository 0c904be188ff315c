"""

The fact is joined and read once: its lines are grouped by (customer, order),
and the order level is written to the shared checkpoint folder with the
categories of the lines.  Everything else rolls up from it: the reference
date, RFM + behaviour, the (order, customer) pairs for the operations join,
and the category counts.  The customer-keyed results share hash partitioning
on CUSTOMER_ID, so the final joins add no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.modes import modes_by_key, value_counts_by_key
from ..functions.ranking import materialize
from ..operators import clean, operations as opsf, rfm as rfmf
from ..operators.rfm import CUSTOMER, UNKNOWN

FEATURE_COLS = ([CUSTOMER] + rfmf.RFM_COLS + rfmf.BEHAVIOUR_COLS + rfmf.FAVOURITE_COLS
                + rfmf.CATEGORY_COLS + opsf.OPS_COLS)


def cleaned_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """Cleaned order lines.  The user join adds user columns only, which no
    feature reads; a user master with repeated keys would also repeat lines,
    so then, and only then, the join is made."""
    users = tables.get("user_master")
    if users is not None and clean.is_unique(users, CUSTOMER):
        users = None
    return clean.clean_order_lines(tables["order_details"], tables["store_master"], tables["product_master"], users)


def customer_features(tables: dict[str, DataFrame]) -> DataFrame:
    """The customer table; runs the pass over the fact, and returns the plan of the rest."""
    every = materialize(rfmf.orders_with_lines(cleaned_lines(tables)))
    ref = rfmf.latest_date(every)
    orders = rfmf.valid_orders(every)
    rb = rfmf.rfm_behaviour(orders, ref)

    pairs = every.filter(F.col(CUSTOMER).isNotNull()).select("ORDER_ID", CUSTOMER)
    vops = opsf.valid_customer_operations(tables["operation_details"], None, pairs=pairs)
    ops_num = vops.groupBy(CUSTOMER).agg(*opsf.operation_numeric_aggs(), F.lit(True).alias("_has_ops"))

    counts = value_counts_by_key([rfmf.order_attribute_values(orders),
                                  rfmf.line_attribute_values(rfmf.lines_of_orders(every)),
                                  opsf.operation_attribute_values(vops)], CUSTOMER)
    modes = modes_by_key(counts, CUSTOMER,
                         {**{c: c for c in rfmf.FAVOURITE_COLS}, "FAVORITE_CATEGORY": "CATEGORY",
                          "FAVORITE_SUB_CATEGORY": "SUB_CATEGORY", "FAVORITE_WEEKDAY": "FAVORITE_WEEKDAY", "FAVORITE_HOUR": "FAVORITE_HOUR"},
                         {"CATEGORY_DIVERSITY": "CATEGORY", "SUB_CATEGORY_DIVERSITY": "SUB_CATEGORY"})
    modes = modes.withColumn("FAVORITE_HOUR", F.col("FAVORITE_HOUR").cast("bigint"))

    j = rb.join(modes, on=CUSTOMER, how="left").join(ops_num, on=CUSTOMER, how="left")
    has_orders = F.col("_orders") > 0
    has_ops = F.coalesce(F.col("_has_ops"), F.lit(False))

    def when_orders(c, default):
        return F.when(has_orders, F.coalesce(F.col(c), F.lit(default)))

    exprs = {
        **{c: F.col(c) for c in [CUSTOMER] + rfmf.RFM_COLS + opsf.OPS_COLS[:4]},
        **{c: F.when(has_orders, F.col(c)) for c in rfmf.BEHAVIOUR_COLS},
        **{c: when_orders(c, UNKNOWN) for c in rfmf.FAVOURITE_COLS},
        "CATEGORY_DIVERSITY": when_orders("CATEGORY_DIVERSITY", 0).cast("bigint"),
        "FAVORITE_CATEGORY": when_orders("FAVORITE_CATEGORY", UNKNOWN),
        "SUB_CATEGORY_DIVERSITY": when_orders("SUB_CATEGORY_DIVERSITY", 0).cast("bigint"),
        "FAVORITE_SUB_CATEGORY": when_orders("FAVORITE_SUB_CATEGORY", UNKNOWN),
        "FAVORITE_WEEKDAY": F.when(has_ops, F.coalesce("FAVORITE_WEEKDAY", F.lit(UNKNOWN))),
        "FAVORITE_HOUR": F.when(has_ops, F.coalesce("FAVORITE_HOUR", F.lit(-1).cast("bigint"))),
    }
    # one projection for the whole output (each extra step re-analyses the plan);
    # doubles get + 0.0 so an IEEE -0.0 prints and hashes as 0.0
    doubles = set(rfmf.RFM_COLS[2:] + rfmf.BEHAVIOUR_COLS + opsf.OPS_COLS[:4])
    return j.select(*[(exprs[c] + F.lit(0.0) if c in doubles else exprs[c]).alias(c) for c in FEATURE_COLS])
