"""
-> stratified split -> uplift model grid -> scores -> targets.

Every step that later passes read again is written once: the encoded points,
the scores of each labeller, the joined labels and the model input.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import materialize
from ..operators import clean, features as feat, targeting
from ..operators.outliers import iforest, lof, ocsvm
from ..operators.uplift import curves, learners
from ..operators.uplift.split import stratified_split

KEY = "CUSTOMER_ID"
#: Label -> column, in the order of the runs.
LABELS = {"Isolation Forest": "Churn_Label_IsoForest", "LOF": "Churn_Label_LOF", "OCSVM": "Churn_Label_OCSVM"}
#: Cells whose metrics are computed at a time (each is a handful of small jobs).
CELLS_AT_ONCE = 4


@dataclass(frozen=True)
class ModelInput:
    """``rows``: (id, nums, cats, features vector, treatment, Monetary, labels,
    is_test); ``size``: number of features."""

    rows: DataFrame
    size: int

    @property
    def train(self) -> DataFrame:
        return self.rows.where(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.rows.where("is_test")


def encoded_customers(customer_table: DataFrame) -> tuple[DataFrame, int]:
    """Complete customers as points (id, nums, cats, treatment, Monetary), written, and the number of features."""
    complete = materialize(targeting.treatment_flag(clean.complete_cases(customer_table)))
    encoding = feat.Encoding(complete, feat.NUMERIC_COLS)
    points = encoding.encode(complete.withColumn("treatment", F.col("Treatment").cast("int")), KEY, "treatment", "Monetary")
    return materialize(points), encoding.size


def model_input(customer_table: DataFrame, seed: int = 42, labels=tuple(LABELS.values())) -> ModelInput:
    points, size = encoded_customers(customer_table)
    makers = {"Churn_Label_IsoForest": lambda: iforest.iforest_labels(points, KEY, seed=seed),
              "Churn_Label_LOF": lambda: lof.lof_labels(points, KEY),
              "Churn_Label_OCSVM": lambda: ocsvm.ocsvm_labels(points, size, key=KEY, seed=seed)}
    out = points
    for name in labels:
        out = out.join(makers[name]().select(KEY, name), KEY)
    split = stratified_split(materialize(out), KEY, "treatment", 0.3, seed)
    return ModelInput(feat.written_vectors(split, size), size)


def fit_predict(mi: ModelInput, model_name: str, label_col: str, sizes: dict = learners.REFERENCE_SIZES) -> DataFrame:
    """(id, Uplift_Score) of the test rows."""
    scores = learners.fit_predict(mi.train, mi.test, KEY, "treatment", mi.size, [(label_col, model_name)], sizes)
    return scores.select(KEY, "Uplift_Score")


def evaluate(ev: DataFrame, k: float = 0.05) -> dict:
    """Metrics of (id, y, treatment, Uplift_Score)."""
    ev = materialize(ev)
    q = curves.qini_auc(ev, "y", "treatment", "Uplift_Score").first()[0]
    a = curves.auuc(ev, "y", "treatment", "Uplift_Score").first()[0]
    u = curves.uplift_at_k(ev, "y", "treatment", "Uplift_Score", KEY, k).first()[0]
    return {"qini_auc": q, "auuc": a, "uplift_at_k": u}


def model_grid(mi: ModelInput, sizes: dict = learners.REFERENCE_SIZES, labels=LABELS) -> DataFrame:
    """U8: every model on every label; long (label, model, run_order, metrics).
    All cells are fitted together; only the metric numbers return to the driver."""
    cells = [(column, model) for column in labels.values() for model in learners.MODELS]
    scores = materialize(learners.fit_predict(mi.train, mi.test, KEY, "treatment", mi.size, cells, sizes))
    test = mi.test.select(KEY, "treatment", *labels.values())

    def metrics(cell):
        column, model = cell
        own = scores.where((F.col("label") == column) & (F.col("model") == model)).select(KEY, "Uplift_Score")
        return evaluate(test.select(KEY, F.col(column).alias("y"), "treatment").join(own, KEY))

    with ThreadPoolExecutor(CELLS_AT_ONCE) as pool:
        found = list(pool.map(metrics, cells))
    names = {column: name for name, column in labels.items()}
    rows = [(names[c], m, i, r["qini_auc"], r["auuc"], r["uplift_at_k"]) for i, ((c, m), r) in enumerate(zip(cells, found))]
    return mi.rows.sparkSession.createDataFrame(
        rows, "label string, model string, run_order int, qini_auc double, auuc double, uplift_at_k double")


def targets(mi: ModelInput, scores: DataFrame, label_col: str = "Churn_Label_OCSVM", n: int = 10000) -> DataFrame:
    """Scores back on the customers, churned top-n, tiers, ROI, deciles.
    ``mi`` holds what is read of the customer table, which is not made again."""
    scored = targeting.attach_scores(mi.rows.select(KEY, "Monetary", label_col), scores)
    t = targeting.with_roi(targeting.top_targets(scored, label_col, n=n))
    return targeting.decile(t, "Uplift_Score")
