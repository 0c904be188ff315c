"""Outlier and uplift models: samples, sizes, stop rules, null scores."""

import os
import subprocess
import sys
import threading
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from churnlift.functions.ranking import rank_by_hash, running_totals
from churnlift.operators import margin
from churnlift.operators.features import Encoding, written_vectors
from churnlift.operators.margin import gamma_scale, kernel_map
from churnlift.operators.outliers import iforest, ocsvm
from churnlift.operators.uplift import curves, learners, svm


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 3))
    x[:30] += 6
    rows = [(i, [float(v) for v in r], [3 + i % 4, -1], int(r[0] + rng.normal() > 0), int(rng.integers(0, 2))) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "CUSTOMER_ID long, nums array<double>, cats array<int>, y int, treatment int")
    return written_vectors(df, 8).cache()


@pytest.mark.parametrize("rows, want", [(1200, 256), (100, 100)])
def test_every_tree_has_its_own_full_sample(points, rows, want):
    df = points.where(F.col("CUSTOMER_ID") < rows)
    sizes = iforest.sample_rows(df).groupBy("tree").count().collect()
    assert len(sizes) == 100 and {r["count"] for r in sizes} == {want}
    roots = iforest.fit(df, trees=7).where("node = 0").collect()
    assert [r["size"] for r in roots] == [want] * 7


def test_outliers_get_the_label(points):
    iso = iforest.iforest_labels(points, contamination=0.025)
    assert iso.where("Churn_Label_IsoForest = 1 and CUSTOMER_ID < 30").count() >= 25
    assert iso.where("Churn_Label_IsoForest = 1").count() == 30
    oc = ocsvm.ocsvm_labels(points, 8, nu=0.05)
    assert oc.where("Churn_Label_OCSVM = 1").count() == 60


def test_share_is_exact_where_scores_tie(spark):
    same = spark.createDataFrame([(i, [1.0], [1]) for i in range(101)], "CUSTOMER_ID long, nums array<double>, cats array<int>")
    for labelled, name in ((iforest.iforest_labels(same, trees=3), "Churn_Label_IsoForest"), (ocsvm.ocsvm_labels(same, 2), "Churn_Label_OCSVM")):
        assert sorted(r.CUSTOMER_ID for r in labelled.where(F.col(name) == 1).collect()) == [0, 1, 2, 3, 4, 5]


def test_rare_indicators_isolate(spark):
    rows = [(i, [0.0], [5000 + i if i < 4 else 1 + i % 2, 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "CUSTOMER_ID long, nums array<double>, cats array<int>")
    found = iforest.iforest_labels(df, trees=200, contamination=0.01)
    assert sorted(r.CUSTOMER_ID for r in found.where("Churn_Label_IsoForest = 1").collect()) == [0, 1, 2, 3]


def _one_class_objective(model, pdf, nu):
    z = model.kernel.of(np.stack(pdf["nums"]), np.stack(pdf["cats"]))
    m = np.sort(z @ model.w)
    return 0.5 * model.w @ model.w - m[:int(nu * len(m))].mean()


def test_one_class_gap_bounds_the_optimum(points):
    pdf = points.select("nums", "cats").toPandas()
    loose = ocsvm.fit(points, 8, 0.05, tolerance=0.05)
    near = ocsvm.fit(points, 8, 0.05, tolerance=1e-4)
    far = ocsvm.fit(points, 8, 0.05, tolerance=0.05, local_rows=0)
    assert near.gap <= 1e-4 * max(abs(near.objective), 1e-3) and near.kernel.error <= 0.03
    for model in (loose, near, far):
        value = _one_class_objective(model, pdf, 0.05)
        assert value <= model.objective + 1e-6
        # the optimum lies between objective - gap and objective
        assert model.objective - model.gap - 1e-9 <= near.objective <= model.objective + 1e-9


def test_kernel_map_meets_its_bound(points):
    wide, rough = (kernel_map(points, "CUSTOMER_ID", 8, bound) for bound in (0.02, 0.1))
    assert rough.components < wide.components and wide.error <= 0.02 and rough.error <= 0.1
    pdf = points.select("nums", "cats").limit(300).toPandas()
    nums, cats = np.stack(pdf["nums"]), np.stack(pdf["cats"])
    dense = np.hstack([nums, *[(cats == f).any(1)[:, None] for f in range(3, 8)]])
    exact = np.exp(-wide.gamma * np.square(dense[:, None] - dense[None]).sum(-1))
    z = wide.of(nums, cats)
    assert np.sqrt(np.square(z @ z.T - exact).mean()) < 0.03
    allcells = np.hstack([np.stack(points.select("nums").toPandas()["nums"]), np.repeat([[1 / 4] * 4 + [0]], 1200, 0)])
    assert gamma_scale(points, 8) > 0 and allcells.shape == (1200, 8)


def test_gamma_counts_the_zeros(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [2, -1]), (2, [0.0, -1.0], [4, 3])], "id long, nums array<double>, cats array<int>")
    dense = np.array([[1, 2, 1, 0, 0], [0, -1, 0, 1, 1.0]])
    assert gamma_scale(df, 5) == pytest.approx(1 / (5 * dense.var()))


@pytest.mark.parametrize("local_rows", [50_000, 0])
def test_margins_are_calibrated(spark, local_rows):
    """Probabilities of planted classes: what is said to happen with p happens with p."""
    rng = np.random.default_rng(8)
    n = 3000 if local_rows else 600
    x = rng.normal(size=(n, 2))
    p = 1 / (1 + np.exp(-2.5 * x[:, 0]))
    rows = [(i, [float(v) for v in r], [], int(rng.random() < q)) for i, (r, q) in enumerate(zip(x, p))]
    df = spark.createDataFrame(rows, "id long, nums array<double>, cats array<int>, y int").repartition(3).cache()
    model = svm.KernelSvms(df, "id", 2, [svm.Problem("p", "y"), svm.Problem("odd", "CASE WHEN id % 2 = 1 THEN y END")],
                           tolerance=0.05, error=0.06, local_rows=local_rows)
    assert set(model.models) == {(i, f) for i in (0, 1) for f in range(-1, 5)}
    assert all(m.gap <= 0.05 * max(abs(m.best), 1e-3) for m in model.models.values())
    assert model.rows[0, -1] == n and sum(n - model.rows[0, f] for f in range(5)) == n
    got = model.predict(df).toPandas().sort_values("id")["p"].to_numpy()
    assert np.abs(got - p).mean() < (0.08 if local_rows else 0.12)
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (got >= low) & (got < low + 0.25)
        assert abs(got[part].mean() - p[part].mean()) < (0.07 if local_rows else 0.15)


def test_reference_sizes_are_the_defaults():
    cells = [("y", m) for m in learners.MODELS]
    found = learners.classifiers(cells, "treatment")
    assert learners.REFERENCE_SIZES == {"gbt": {"trees": 1000, "step": 0.05, "depth": 6}, "ct_gbt": {"trees": 100, "step": 0.3, "depth": 6},
                                        "rf": {"trees": 1000}, "logreg": {"iters": 1000}}
    assert [[(c.kind, c.size) for c in found[cell]] for cell in cells] == [
        [("gbt", "gbt"), ("rf", "rf")], [("logreg", "logreg"), ("svm", None)], [("gbt", "ct_gbt")], [("rf", "rf")]]


@pytest.mark.parametrize("key", ["uplift_two_models", "model_grid", "model_targets"])
def test_registered_keys_fit_the_reference_sizes(monkeypatch, key):
    from churnlift.plans import modelling, queries
    from churnlift.plans.catalog import REGISTRY
    seen = []

    def fit(train, test, id_, t, size, cells, sizes):
        seen.append((len(cells), sizes))
        raise InterruptedError
    monkeypatch.setattr(learners, "fit_predict", fit)
    monkeypatch.setattr(queries, "_features", lambda *args: None)
    monkeypatch.setattr(modelling, "model_input", lambda *args, **kw: SimpleNamespace(train=None, test=None, size=0))
    with pytest.raises(InterruptedError):
        REGISTRY[key].fn(None, None)
    assert seen == [(12 if key == "model_grid" else 1, learners.REFERENCE_SIZES)]


def test_learners_follow_the_signal(points):
    sizes = dict(learners.REFERENCE_SIZES, gbt=dict(trees=8, step=0.3, depth=3), ct_gbt=dict(trees=5, step=0.3, depth=3), rf=dict(trees=30))
    # treatment helps where the first feature is positive
    df = points.withColumn("y", (F.col("nums")[0] * F.when(F.col("treatment") == 1, 1).otherwise(-1) > 0).cast("int"))
    got = learners.fit_predict(df, df, "CUSTOMER_ID", "treatment", 8, [("y", m) for m in learners.MODELS], sizes)
    got = got.join(df.select("CUSTOMER_ID", F.col("nums")[0].alias("x")), "CUSTOMER_ID").toPandas()
    for name, g in got.groupby("model"):
        assert len(g) == 1200 and g["Uplift_Score"].between(-1, 1).all(), name
        assert g[g.x > 0.5]["Uplift_Score"].mean() > g[g.x < -0.5]["Uplift_Score"].mean() + 0.5, name
    assert set(got["model"]) == set(learners.MODELS) and set(got["label"]) == {"y"}
    with pytest.raises(ValueError, match="both outcome classes"):
        learners.fit_predict(df.withColumn("y", F.lit(1)), df, "CUSTOMER_ID", "treatment", 8, [("y", "TwoModels_XGB_vs_RF")], sizes)


STORES = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from churnlift.session import build_session
from churnlift.operators import features
from churnlift.operators.outliers import iforest
spark = build_session(master="local[4]", shuffle_partitions=4)
n = 120_000
df = spark.range(n).select(F.col("id").alias("CUSTOMER_ID"), (F.col("id") % 100_000).alias("s"), F.rand(1).alias("x"))
df = df.select("CUSTOMER_ID", "x", F.concat(F.lit("store-"), "s").alias("FAVOURITE_STORE"), F.lit("kind").alias("KIND"))
e = features.Encoding(df, ["x"], ["FAVOURITE_STORE", "KIND"])
assert e.size == 1 + 100_000 + 1
rows = features.written_vectors(e.encode(df, "CUSTOMER_ID"), e.size)
first = rows.where("CUSTOMER_ID = 7").first()
assert first.features.size == e.size and list(first.features.indices) == [0, *first.cats]
assert rows.select(F.count_distinct(F.col("cats")[0])).first()[0] == 100_000
assert iforest.iforest_labels(rows, trees=5).where("Churn_Label_IsoForest = 1").count() == 6000
print("DONE")
"""


def test_a_hundred_thousand_stores_fit_a_small_driver():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_DRIVER_MEMORY="1g", BENCH_CPUS="4")
    out = subprocess.run([sys.executable, "-c", STORES.format(root=root)], env=env, capture_output=True, text=True, timeout=600)
    assert "DONE" in out.stdout, out.stderr[-3000:]


def test_no_dense_encoding_in_the_model_plans():
    import churnlift.operators.features as f
    import churnlift.plans.modelling as m
    for module in (f, m):
        text = open(module.__file__).read()
        assert "StringIndexer" not in text and "vector_to_array" not in text


def test_unseen_levels_encode_as_none(spark):
    schema = "CUSTOMER_ID long, x double, a string, FAVORITE_HOUR long"
    df = spark.createDataFrame([(1, 1.0, "b", 10), (2, 3.0, "a", 9), (3, 2.0, None, 9)], schema)
    e = Encoding(df, ["x"], ["a", "FAVORITE_HOUR"])
    new = spark.createDataFrame([(4, 2.0, "zz", 10), (5, 2.0, "b", None)], schema)
    got = {r.CUSTOMER_ID: (list(r.nums), list(r.cats)) for r in e.encode(df.unionByName(new), "CUSTOMER_ID").collect()}
    assert e.size == 5 and got[4] == ([0.0], [-1, 4]) and got[5] == ([0.0], [2, -1])
    assert got[1][1] == [2, 4] and got[2][1] == [1, 3] and got[3] == ([0.0], [-1, 3])


def test_null_scores_rank_last(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.9), (2, 0, 0, None), (3, 1, 0, 0.5), (4, 0, 1, float("nan"))],
                               "id long, y int, t int, s double")
    got = sorted(r.n for r in curves.curve(df, "y", "t", "s").collect())
    assert got == [0, 1, 2, 4]
    assert curves.qini_auc(df, "y", "t", "s").first()[0] is not None
    assert curves.uplift_at_k(df, "y", "t", "s", "id", 0.5).first()[0] == 0.0


def test_buckets_follow_the_rows_and_change_nothing(spark, monkeypatch):
    from churnlift.functions import ranking
    df = spark.range(500).select(F.col("id").cast("double").alias("s"), F.lit(1).alias("v")).cache()
    one = {r.s: r.cum_v for r in running_totals(df, "s", ["v"]).collect()}
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 20)
    assert ranking.bucket_count(500) == 25
    assert {r.s: r.cum_v for r in running_totals(df, "s", ["v"]).collect()} == one == {float(i): 500 - i for i in range(500)}
    ranked = rank_by_hash(df.withColumn("h", F.md5(F.col("s").cast("string"))).withColumn("k", F.lit(1)), ["k"], "h")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 501))


def test_ranges_of_running_totals_are_even(spark, monkeypatch):
    """10**7 scores, heavily skewed: no range beyond twice what it is meant to hold."""
    from churnlift.functions import ranking
    n = 10_000_000
    df = spark.range(n).select((F.col("id").cast("double") / n).alias("u"), F.lit(1).alias("v")).select(F.pow("u", F.lit(9)).alias("s"), "v")
    buckets = ranking.bucket_count(n)
    dealt = df.repartitionByRange(buckets, F.col("s").desc()).groupBy(F.spark_partition_id()).count()
    assert buckets == 100 and dealt.agg(F.max("count")).first()[0] <= 2 * ranking.ROWS_PER_BUCKET
    few = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("s"), F.lit(2).alias("v"), (F.col("id") % 2).alias("t")).cache()
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", 50)
    got = running_totals(few, "s", ["v"], descending=False, partition_cols=["t"]).collect()
    order = {t: sorted(r.s for r in few.collect() if r.t == t) for t in (0, 1)}
    assert len(got) == 1000 and all(r.cum_v == 2 * (order[r.t].index(r.s) + 1) for r in got)


def test_rank_in_order_numbers_ranges(spark):
    from churnlift.functions.ranking import rank_in_order
    df = spark.range(300).select((F.col("id") % 3).alias("c"), F.col("id").cast("string").alias("v")).repartition(5)
    got = [(r.c, r.v) for r in sorted(rank_in_order(df, ["c", "v"]).collect(), key=lambda r: r["rank"])]
    assert got == sorted((i % 3, str(i)) for i in range(300))


def test_first_planes_at_a_samples_points_save_passes(spark, monkeypatch):
    """Passes over all rows are few, and the gap stays that of all rows."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=3)], [int(rng.integers(3, 9))]) for i in range(900)]
    points = spark.createDataFrame(rows, "CUSTOMER_ID long, nums array<double>, cats array<int>").cache()
    passes, scan = [], type(points).mapInArrow
    monkeypatch.setattr(type(points), "mapInArrow", lambda self, *a, **k: passes.append(1) or scan(self, *a, **k))
    cold = ocsvm.fit(points, 9, 0.05, tolerance=0.02, local_rows=0)
    cold_passes = len(passes)
    passes.clear()
    warm = ocsvm.fit(points, 9, 0.05, tolerance=0.02, local_rows=899)
    assert len(passes) < cold_passes
    for model in (cold, warm):
        assert model.gap <= 0.02 * abs(model.objective)
    assert abs(cold.objective - warm.objective) <= 0.02 * abs(cold.objective)


def test_single_precision_features_are_those_of_the_map():
    rng = np.random.default_rng(1)
    nums, cats = rng.normal(size=(1500, 3)) * 30, rng.integers(-1, 6, (1500, 2))
    cats = np.where(cats >= 0, cats + 3, -1)
    kernel = margin.KernelMap(0.3, 64, 5)
    batch = pa.RecordBatch.from_pydict({"nums": list(nums), "cats": list(cats)})
    got = np.vstack([z for _, z in margin.SingleMap(kernel).blocks(batch)])
    assert got.dtype == np.float32 and np.abs(got - kernel.of(nums, cats)).max() < 1e-5


def test_svm_passes_start_from_a_samples_points(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in x], [int(rng.integers(2, 6))], int(x[0] + 0.3 * rng.normal() > 0)) for i, x in enumerate(rng.normal(size=(700, 2)))]
    df = spark.createDataFrame(rows, "id long, nums array<double>, cats array<int>, y int").cache()
    steps, add = [], margin.Planes.add
    monkeypatch.setattr(margin.Planes, "add", lambda self, *a, at=None, **k: steps.append(at is not None) or add(self, *a, at=at, **k))
    model = svm.KernelSvms(df, "id", 6, [svm.Problem("p", "y")], tolerance=0.05, error=0.08, local_rows=500)
    assert sum(steps) > len(model.models)  # several points of a model in the first pass
    near = svm.KernelSvms(df, "id", 6, [svm.Problem("p", "y")], tolerance=0.05, error=0.08)
    for k, p in model.models.items():
        assert p.gap <= 0.05 * max(p.best, 1e-3) and abs(p.best - near.models[k].best) <= 0.05 * p.best
    p = model.predict(df).join(df, "id").toPandas()
    assert ((p["p"] > 0.5) == p["y"]).mean() > 0.85


def test_forests_grow_while_boosters_do(spark, monkeypatch):
    at_work = threading.Event()

    class Seen(learners.forest.Forests):
        def __init__(self, *a):
            at_work.set()
            super().__init__(*a)

    def slow(*a, started, **k):
        started()
        assert at_work.wait(60)
        return fit(*a, started=started, **k)
    fit = learners.boosting.fit
    monkeypatch.setattr(learners.boosting, "fit", slow)
    monkeypatch.setattr(learners.forest, "Forests", Seen)
    rows = spark.createDataFrame([(i, [float(i % 7)], [], i % 2, (i // 2) % 2) for i in range(60)], "id long, nums array<double>, cats array<int>, t int, y int").cache()
    sizes = {"gbt": {"trees": 2, "step": 0.3, "depth": 2}, "rf": {"trees": 2}}
    out = learners.fit_predict(rows, rows, "id", "t", 1, [("y", "TwoModels_XGB_vs_RF")], sizes)
    assert out.count() == 60


def test_svm_models_are_a_task_each(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    rows = [(i, [float(i % 13), float(i % 7)], [], int(i % 13 > 6)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, nums array<double>, cats array<int>, y int").cache()
    seen, deal = [], DataFrame.repartitionById
    monkeypatch.setattr(DataFrame, "repartitionById", lambda self, n, c: seen.append(n) or deal(self, n, c))
    model = svm.KernelSvms(df, "id", 2, [svm.Problem("p", "y"), svm.Problem("odd", "CASE WHEN id % 2 = 1 THEN y END")], tolerance=0.05, error=0.1)
    assert len(model.models) == 12 and 12 in seen


def test_targets_read_the_model_input_only(spark):
    from churnlift.plans import modelling
    rows = spark.createDataFrame([(i, 10.0 * i, i % 2) for i in range(8)], "CUSTOMER_ID long, Monetary double, Churn_Label_OCSVM int")
    scores = spark.createDataFrame([(1, 0.1), (3, 0.9), (4, 0.5)], "CUSTOMER_ID long, Uplift_Score double")
    found = modelling.targets(modelling.ModelInput(rows, 0), scores).collect()
    assert {(r.CUSTOMER_ID, r.Monetary, r.Uplift_Score) for r in found} == {(1, 10.0, 0.1), (3, 30.0, 0.9), (5, 50.0, None), (7, 70.0, None)}
