"""Deterministic scored table for the oracle-checked evaluation and targeting
keys.

Model scores (plans/modelling.py) depend on solver numerics, so an exact
SQL twin cannot reproduce them.  The evaluation operators work on any
(label, treatment, score) table; the registered keys feed them a
deterministic one derived from the customer features:

* treatment — the reference's rule, USED_EXTRA_DISCOUNT_RATIO > 0.05;
* label     — the reference notebook's recency churn rule, Recency > 60;
* score     — a feature baseline, AVG_DELIVERY_TIME / 100 (continuous,
  within [0, 1], NULL for customers without operations);
* split     — the exact stratified 70/30 split on treatment, seed 42.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TREATMENT_THRESHOLD
from ..operators.uplift.split import stratified_split

RECENCY_CHURN_DAYS = 60
SEED = 42
TEST_SIZE = 0.3


def scored_base(features: DataFrame) -> DataFrame:
    base = features.select(
        "CUSTOMER_ID", "Monetary",
        F.coalesce(F.col("USED_EXTRA_DISCOUNT_RATIO") > TREATMENT_THRESHOLD, F.lit(False)).cast("int").alias("treatment"),
        (F.col("Recency") > RECENCY_CHURN_DAYS).cast("int").alias("y"),
        (F.col("AVG_DELIVERY_TIME") / F.lit(100.0)).alias("score"))
    return stratified_split(base, "CUSTOMER_ID", "treatment", TEST_SIZE, SEED)


def test_scored(features: DataFrame) -> DataFrame:
    """Test-split customers that have a score (the evaluation population)."""
    return scored_base(features).filter(F.col("is_test") & F.col("score").isNotNull())


def scored_customers(features: DataFrame) -> DataFrame:
    """All customers; Uplift_Score only on the test split (J8 population trap)."""
    sb = scored_base(features)
    return sb.select("CUSTOMER_ID", "Monetary", "treatment", "y",
                     F.when(F.col("is_test"), F.col("score")).alias("Uplift_Score"))


EVAL_CTES = {
    "ev": f"""
select CUSTOMER_ID, Monetary,
  cast(coalesce(USED_EXTRA_DISCOUNT_RATIO > {TREATMENT_THRESHOLD}, false) as integer) as treatment,
  cast(Recency > {RECENCY_CHURN_DAYS} as integer) as y,
  AVG_DELIVERY_TIME / 100.0 as score
from features""",
    "evs": f"""
select *, row_number() over (partition by treatment order by md5('{SEED}|' || cast(CUSTOMER_ID as varchar))) as rn,
  count(*) over (partition by treatment) as sn
from ev""",
    "evsplit": f"select * exclude (rn, sn), rn <= ceil({TEST_SIZE} * sn) as is_test from evs",
    "evtest": "select * from evsplit where is_test and score is not null",
    "scored": "select CUSTOMER_ID, Monetary, treatment, y, case when is_test then score end as Uplift_Score from evsplit",
}


# ---- runs of deterministic feature scores on two rule labels (U14, U15) --------------

#: name -> score column; the runs stand for models.
FEATURE_SCORES = {"delivery": "AVG_DELIVERY_TIME", "approval": "AVG_APPROVAL_TIME", "distance": "AVG_TOTAL_DISTANCE"}
#: name -> (column, bound): the label is 1 above the bound.
RULE_LABELS = {"recency": ("Recency", RECENCY_CHURN_DAYS), "frequency": ("Frequency", 8)}


def rule_metrics(features: DataFrame) -> DataFrame:
    """(label, model, run_order, response, share) of every score on every
    label: the response among customers whose score is above its mean, and
    their share, rounded; all runs come from one pass over the customers."""
    means = {c: features.agg(F.avg(c)).scalar() for c in FEATURE_SCORES.values()}
    runs = [F.struct(F.lit(label).alias("label"), F.lit(model).alias("model"),
                     F.lit(i * len(FEATURE_SCORES) + j).alias("run_order"),
                     (F.col(column) > bound).cast("int").alias("y"), (F.col(score) > means[score]).alias("above"))
            for i, (label, (column, bound)) in enumerate(RULE_LABELS.items())
            for j, (model, score) in enumerate(FEATURE_SCORES.items())]
    return (features.select(F.inline(F.array(*runs))).groupBy("label", "model", "run_order")
            .agg(F.round(F.avg(F.when(F.col("above"), F.col("y"))), 9).alias("response"),
                 F.round(F.avg(F.coalesce(F.col("above"), F.lit(False)).cast("int")), 9).alias("share")))


def metrics_sql(body: str) -> str:
    """Oracle text over the same runs."""
    from .catalog import oracle
    from .oracle_sql import feature_ctes
    ctes = feature_ctes()
    parts = []
    for i, (label, (column, bound)) in enumerate(RULE_LABELS.items()):
        for j, (model, score) in enumerate(FEATURE_SCORES.items()):
            above = f"{score} > (select avg({score}) from features)"
            parts.append(f"""select '{label}' as label, '{model}' as model, {i * len(FEATURE_SCORES) + j} as run_order,
  round(avg(cast({column} > {bound} as integer)) filter ({above}), 9) as response,
  round(avg(cast(coalesce({above}, false) as integer)), 9) as share from features""")
    ctes["metrics"] = " union all ".join(parts)
    return oracle(ctes, body)
