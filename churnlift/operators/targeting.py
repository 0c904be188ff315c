"""Target list: churned customers ranked by uplift, discount tier, ROI,
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_double_avg, exact_double_sum
from ..functions.nulls import flag
from ..functions.scalar import TREATMENT_THRESHOLD, discount_tier


def treatment_flag(df: DataFrame, col: str = "USED_EXTRA_DISCOUNT_RATIO",
                   threshold: float = TREATMENT_THRESHOLD, out: str = "Treatment") -> DataFrame:
    """Treated when the share of orders with an extra discount exceeds
    the threshold (NULL -> False)."""
    return df.withColumn(out, flag(F.col(col) > F.lit(threshold)))


def attach_scores(customers: DataFrame, scores: DataFrame, key: str = "CUSTOMER_ID",
                  score_col: str = "Uplift_Score") -> DataFrame:
    """Scores back onto the customer table; unscored customers get NULL."""
    return customers.join(scores.select(key, score_col), on=key, how="left")


def top_targets(scored: DataFrame, label_col: str, score_col: str = "Uplift_Score", n: int = 10000,
                key: str = "CUSTOMER_ID") -> DataFrame:
    """G1/K1: churned customers (label 1), highest uplift first, NULL last,
    first ``n`` (the key breaks ties).  Plans as a bounded top-k."""
    return (scored.filter(F.col(label_col) == 1)
                  .orderBy(F.col(score_col).desc_nulls_last(), F.col(key).asc()).limit(n))


def with_roi(targets: DataFrame, score_col: str = "Uplift_Score", value_col: str = "Monetary") -> DataFrame:
    """Discount tier, expected revenue saved, discount cost and
    ROI = saved / cost (a zero cost counts as 1)."""
    out = targets.withColumn("Assigned_Discount", discount_tier(score_col))
    out = out.withColumns({"Expected_Revenue_Saved": F.col(value_col) * F.col(score_col),
                           "Discount_Cost": F.col(value_col) * F.col("Assigned_Discount")})
    cost = F.when(F.col("Discount_Cost") == 0, F.lit(1.0)).otherwise(F.col("Discount_Cost"))
    return out.withColumn("ROI", F.try_divide(F.col("Expected_Revenue_Saved"), cost))


def decile(df: DataFrame, col: str = "Uplift_Score", out: str = "Uplift_Decile", q: int = 10) -> DataFrame:
    """K4: quantile bins 0..q-1 with linearly interpolated edges, right-closed
    bins, lowest edge included, NULL -> NULL; duplicate edges raise an
    error.  Edges come from the exact ``percentile`` aggregate, evaluated
    once as a scalar subquery (the input is the bounded top-k list)."""
    probs = [i / q for i in range(q + 1)]
    edges = df.agg(F.percentile(F.col(col), F.array(*[F.lit(p) for p in probs])).alias("e")).scalar()
    inner = [F.element_at(edges, i + 1) for i in range(1, q)]
    bin_ = sum((F.col(col) > e).cast("int") for e in inner)
    dup = None
    for i in range(1, q + 1):
        c = F.element_at(edges, i) >= F.element_at(edges, i + 1)
        dup = c if dup is None else (dup | c)
    checked = F.when(dup, F.raise_error(F.lit("Bin edges must be unique"))).otherwise(bin_)
    return df.withColumn(out, F.when(F.col(col).isNotNull(), checked).cast("bigint"))


def target_summary(targets: DataFrame) -> DataFrame:
    """Count, totals (2 places, half-even), mean ROI, count and share
    of ROI > 1 (NaN/NULL ROI counts as not > 1 and stays in the denominator)."""
    over = F.coalesce(F.col("ROI") > 1, F.lit(False)).cast("int")
    return targets.agg(
        F.count(F.lit(1)).alias("customers_targeted"),
        F.bround(exact_double_sum("Expected_Revenue_Saved"), 2).alias("total_expected_revenue_saved"),
        F.bround(exact_double_sum("Discount_Cost"), 2).alias("total_discount_cost"),
        F.bround(exact_double_avg("ROI"), 2).alias("mean_roi"),
        F.bround(F.avg(over) * 100, 2).alias("pct_roi_above_1"),
        F.sum(over).cast("bigint").alias("count_roi_above_1"))
