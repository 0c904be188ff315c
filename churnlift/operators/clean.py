"""

Joins are plain equi-joins: Catalyst turns "left join then drop unmatched"
into an inner join and pushes IS NOT NULL into the dimension scan; the
choice between broadcast and shuffle join is left to the size-checked
``autoBroadcastJoinThreshold`` and to AQE's runtime statistics, because at
full scale none of the dimensions (stores, products, users) has a fixed
size bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import not_in_keep_null, null_safe_join
from ..functions.scalar import PAYMENT_MAPPING, recode

STORE_COLS = ("STORE_NAME", "PREFIX")
PRODUCT_COLS = ("SKU_NAME", "SKU_BRAND", "SKU_CATEGORY", "SKU_SUBCATEGORY",
                "SKU_RETURNABLE_CONTAINER", "SKU_ALCOHOLIC", "SKU_OWN_CATALOG",
                "SKU_CONTAINER", "SKU_IS_RETURNABLE", "SKU_IS_BUNDLE")
USER_COLS = ("REGISTRATION_TIMESTAMP", "CREATION_DATE", "SEGMENT")
# Fixed fill values after the product join.
PRODUCT_FILL = {"SKU_CATEGORY": "Unknown", "SKU_IS_BUNDLE": 0}


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def left_enrich(facts: DataFrame, dim: DataFrame, key: str, cols, null_safe: bool = False) -> DataFrame:
    """Left join on one key, bringing ``cols`` (manual pruning, P1).

    pandas matches a NULL key with a NULL key (N1).  A plain join does not, so
    without ``null_safe`` a dimension row with a NULL key is an error."""
    right = dim.select(key, *_present(dim, cols))
    if null_safe:
        return null_safe_join(facts, right, key, "left")
    missing = F.raise_error(F.lit(f"NULL in dimension key {key}")).cast(dim.schema[key].dataType)
    return facts.join(right.withColumn(key, F.coalesce(F.col(key), missing)), on=key, how="left")


def enrich_store(lines: DataFrame, stores: DataFrame, key: str = "STORE_ID",
                 cols=STORE_COLS, drop_unmatched_on: str | None = "STORE_NAME") -> DataFrame:
    """Store attributes; lines whose store is unknown are dropped (P5)."""
    out = left_enrich(lines, stores, key, cols)
    return out.filter(F.col(drop_unmatched_on).isNotNull()) if drop_unmatched_on else out


def fill_defaults(df: DataFrame, fill: dict) -> DataFrame:
    """Fill NULL with constants (string and numeric)."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items() if c in df.columns})


def enrich_product(lines: DataFrame, products: DataFrame, key: str = "SKU_ID",
                   cols=PRODUCT_COLS, fill: dict | None = None) -> DataFrame:
    """J2 + P7: product attributes, then default category/bundle flag."""
    out = left_enrich(lines, products, key, cols)
    return fill_defaults(out, PRODUCT_FILL if fill is None else fill)


def enrich_user(lines: DataFrame, users: DataFrame, key: str = "CUSTOMER_ID",
                cols=USER_COLS, null_safe: bool = True) -> DataFrame:
    """User attributes; unmatched lines are kept.  The fact key can be
    NULL, and pandas matches NULL to NULL (N1), hence ``<=>``."""
    return left_enrich(lines, users, key, cols, null_safe=null_safe)


def recode_payment(lines: DataFrame, col: str = "PAYMENT_METHOD", mapping: dict = PAYMENT_MAPPING) -> DataFrame:
    """Recode payment methods; unmapped values become NULL."""
    return lines.withColumn(col, recode(col, mapping))


def drop_states(lines: DataFrame, states=("Fraud",), col: str = "ORDER_STATE_FINAL") -> DataFrame:
    """Drop listed states, keep NULL state."""
    return lines.filter(not_in_keep_null(col, states))


def drop_orphans(df: DataFrame, subset=("SKU_NAME",)) -> DataFrame:
    """P5: drop rows NULL in any of ``subset``."""
    return df.na.drop(how="any", subset=list(subset))


def complete_cases(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL (or NaN) anywhere."""
    return df.na.drop(how="any")


def is_unique(dim: DataFrame, key: str) -> bool:
    """True if no key value (NULL is one) stands in two rows."""
    return not dim.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()


def orphan_keys(lines: DataFrame, dim: DataFrame, key: str = "SKU_ID") -> DataFrame:
    """P10: distinct fact keys that have no dimension row (left anti join)."""
    return lines.select(key).join(dim.select(key), on=key, how="left_anti").distinct()


def add_discount_breakdown(lines: DataFrame) -> DataFrame:
    """organic = list - offered; extra = offered - charged; each times
    quantity; total = organic + extra."""
    organic = F.col("UNIT_LIST_PRICE") - F.col("UNIT_OFFERED_PRICE")
    extra = F.col("UNIT_OFFERED_PRICE") - F.col("UNIT_CHARGED_PRICE")
    return (lines.withColumns({"UNIT_ORGANIC_DISCOUNT": organic, "UNIT_EXTRA_DISCOUNT": extra})
                 .withColumns({"UNIT_TOTAL_ORGANIC_DISCOUNT": F.col("UNIT_ORGANIC_DISCOUNT") * F.col("UNIT_QUANTITY"),
                               "UNIT_TOTAL_EXTRA_DISCOUNT": F.col("UNIT_EXTRA_DISCOUNT") * F.col("UNIT_QUANTITY")})
                 .withColumn("UNIT_TOTAL_DISCOUNTS",
                             F.col("UNIT_TOTAL_ORGANIC_DISCOUNT") + F.col("UNIT_TOTAL_EXTRA_DISCOUNT")))


def clean_order_lines(lines: DataFrame, stores: DataFrame, products: DataFrame,
                      users: DataFrame | None = None, payment_mapping: dict = PAYMENT_MAPPING,
                      drop=("Fraud",)) -> DataFrame:
    """The reference's cleaning sequence: store join (drop unknown), product
    join + fills, user join, payment recode, drop Fraud (keep NULL state),
    drop unknown products, add discount breakdown.  All lines of every
    remaining state are returned; ``valid_lines`` narrows to Valid."""
    out = enrich_store(lines, stores)
    out = enrich_product(out, products)
    if users is not None:
        out = enrich_user(out, users)
    out = recode_payment(out, mapping=payment_mapping)
    out = drop_states(out, drop)
    out = drop_orphans(out, ["SKU_NAME"])
    return add_discount_breakdown(out)


def valid_lines(cleaned: DataFrame, col: str = "ORDER_STATE_FINAL", value: str = "Valid") -> DataFrame:
    """Equality filter."""
    return cleaned.filter(F.col(col) == value)


def order_customer_pairs(cleaned: DataFrame, order: str = "ORDER_ID", customer: str = "CUSTOMER_ID") -> DataFrame:
    """Distinct (order, customer) pairs; the partial aggregate removes
    duplicates map-side before the shuffle."""
    return cleaned.select(order, customer).dropDuplicates()


def operations_customer(ops: DataFrame, cleaned: DataFrame, order: str = "ORDER_ID",
                        customer: str = "CUSTOMER_ID") -> DataFrame:
    """Give each operation the customer(s) of its order; an order with two
    customers fans out, an unmatched one gets NULL."""
    return ops.join(order_customer_pairs(cleaned, order, customer), on=order, how="left")
