"""Golden fixtures (FIXTURES.md §3-§5): small literal tables through the
same operators the registered queries use."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlift.functions.modes import grouped_modes
from churnlift.functions.nulls import count_unique_with_null
from churnlift.functions.scalar import discount_tier, hour_of_text_time
from churnlift.operators import clean, targeting
from churnlift.operators import rfm as rfmf
from churnlift.operators.uplift import curves
from churnlift.operators.uplift.split import stratified_split
from churnlift.plans.customer_features import customer_features


def _d(day):
    return dt.datetime(2024, 1, day)


@pytest.fixture(scope="module")
def golden_tables(spark):
    stores = spark.createDataFrame([("S1", "Alpha", "SM"), ("S2", "Beta", "KI")], "STORE_ID string, STORE_NAME string, PREFIX string")
    products = spark.createDataFrame(
        [("K1", "k1", "Food", "Fruit", 0), ("K2", "k2", "Food", "Veg", 1), ("K3", "k3", "Drink", None, None)],
        "SKU_ID string, SKU_NAME string, SKU_CATEGORY string, SKU_SUBCATEGORY string, SKU_IS_BUNDLE int")
    cols = ("ORDER_ID string, CUSTOMER_ID string, ORDER_DATE timestamp_ntz, SKU_ID string, STORE_ID string, "
            "UNIT_QUANTITY double, UNIT_LIST_PRICE double, UNIT_OFFERED_PRICE double, UNIT_CHARGED_PRICE double, "
            "UNIT_NET double, PAYMENT_METHOD string, ORDER_STATE_FINAL string, LINE_NO int")
    rows = [
        ("O1", "C1", _d(1), "K1", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Valid", 1),
        ("O1", "C1", _d(1), "K2", "S1", 2.0, 5.0, 5.0, 4.0, 8.0, "CASH", "Valid", 2),
        ("O2", "C1", _d(5), "K3", "S2", 1.0, 10.0, 10.0, 10.0, 10.0, "CARD ON DELIVERY", "Valid", 1),
        ("O3", "C2", _d(30), "K1", "S9", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Valid", 1),
        ("O4", "C2", _d(29), "K9", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Valid", 1),
        ("O5", "C2", _d(20), "K1", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Fraud", 1),
        ("O6", "C2", _d(15), "K1", "S2", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Invalid", 1),
        ("O7", "C2", _d(4), "K2", "S2", 3.0, 5.0, 5.0, 5.0, 15.0, "BITCOIN", "Valid", 1),
        ("O8", None, _d(2), "K1", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Valid", 1),
        ("O9", "C1", _d(9), "K1", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", None, 1),
    ]
    lines = spark.createDataFrame(rows, cols)
    ops = spark.createDataFrame([], "ORDER_ID string, ORDER_DATE timestamp_ntz, ORDER_TIME string, "
                                    "ORDER_STATE_FINAL string, DELIVERY_TIME double, WITHIN_SLA int, "
                                    "APPROVAL_TIME double, TOTAL_DISTANCE double")
    return {"order_details": lines, "store_master": stores, "product_master": products, "operation_details": ops}


def test_cleaning_counts(golden_tables):
    t = golden_tables
    cleaned = clean.clean_order_lines(t["order_details"], t["store_master"], t["product_master"])
    assert cleaned.count() == 7
    ref = cleaned.agg(F.max("ORDER_DATE")).first()[0]
    assert ref == _d(15)  # from the Invalid order


def test_customer_features_golden(golden_tables):
    f = {r["CUSTOMER_ID"]: r for r in customer_features(golden_tables).collect()}
    assert set(f) == {"C1", "C2"}
    c1, c2 = f["C1"], f["C2"]
    assert (c1.Recency, c1.Frequency, c1.Monetary, c1.Total_Units) == (10, 2, 26.0, 4.0)
    assert (c2.Recency, c2.Frequency, c2.Monetary, c2.Total_Units) == (11, 1, 15.0, 3.0)
    assert (c1.Total_Organic_Discount, c1.Total_Extra_Discount, c1.Total_Discounts) == (2.0, 2.0, 4.0)
    assert (c1.AVG_ORGANIC_DISCOUNT_PER_ORDER, c1.USED_ORGANIC_DISCOUNT_RATIO) == (1.0, 0.5)
    assert (c1.AVG_TOTAL_DISCOUNT_PER_ORDER, c1.USED_TOTAL_DISCOUNT_RATIO) == (2.0, 0.5)
    assert (c1.AVG_UNIT_QUANTITY_PER_ORDER, c1.IS_BULK_BUYER, c1.BUNDLE_PURCHASE_RATIO) == (2.0, 0.5, 0.5)
    assert (c2.AVG_UNIT_QUANTITY_PER_ORDER, c2.IS_BULK_BUYER, c2.BUNDLE_PURCHASE_RATIO) == (3.0, 1.0, 1.0)
    assert (c1.FAVOURITE_STORE, c1.FAVOURITE_STORE_TYPE, c1.FAVOURITE_PAYMENT_METHOD) == ("Alpha", "KI", "CARD")
    assert (c2.FAVOURITE_STORE, c2.FAVOURITE_STORE_TYPE, c2.FAVOURITE_PAYMENT_METHOD) == ("Beta", "KI", "Unknown")
    assert (c1.CATEGORY_DIVERSITY, c1.FAVORITE_CATEGORY, c1.SUB_CATEGORY_DIVERSITY, c1.FAVORITE_SUB_CATEGORY) == \
        (2, "Food", 2, "Fruit")
    assert (c2.CATEGORY_DIVERSITY, c2.FAVORITE_CATEGORY, c2.SUB_CATEGORY_DIVERSITY, c2.FAVORITE_SUB_CATEGORY) == \
        (1, "Food", 1, "Veg")
    assert c1.FAVORITE_HOUR is None and c1.AVG_DELIVERY_TIME is None


def test_standalone_operators_agree(golden_tables):
    t = golden_tables
    cleaned = clean.clean_order_lines(t["order_details"], t["store_master"], t["product_master"])
    valid = clean.valid_lines(cleaned)
    r = {x.CUSTOMER_ID: x for x in rfmf.rfm(rfmf.order_level(cleaned)).collect()}
    assert r["C1"].Monetary == 26.0 and r["C2"].Recency == 11
    fav = {x.CUSTOMER_ID: x.FAVOURITE_STORE for x in rfmf.favourites(valid).collect()}
    assert fav == {"C1": "Alpha", "C2": "Beta"}


UPLIFT = list(zip(range(1, 9), [1, 0, 1, 0, 1, 0, 0, 1], [1, 1, 0, 0, 1, 0, 1, 0], [.9, .8, .7, .7, .5, .4, .2, .1]))


@pytest.fixture(scope="module")
def uplift_df(spark):
    return spark.createDataFrame(UPLIFT, "id long, y int, t int, s double")


def test_qini_curve_golden(uplift_df):
    got = [(r.n, round(r.value, 6)) for r in curves.curve(uplift_df, "y", "t", "s", "qini").orderBy("n").collect()]
    assert got == [(0, 0.0), (1, 1.0), (2, 1.0), (4, 0.0), (5, 0.5), (6, 1.0), (7, 0.666667), (8, 0.0)]


def test_uplift_curve_golden(uplift_df):
    got = [(r.n, round(r.value, 6)) for r in curves.curve(uplift_df, "y", "t", "s", "uplift").orderBy("n").collect()]
    assert got == [(0, 0.0), (1, 1.0), (2, 1.0), (4, 0.0), (5, 0.833333), (6, 2.0), (7, 1.166667), (8, 0.0)]


def test_auc_and_uplift_at_k_golden(uplift_df):
    assert round(curves.qini_auc(uplift_df, "y", "t", "s").first()[0], 6) == 0.388889
    assert round(curves.auuc(uplift_df, "y", "t", "s").first()[0], 6) == 0.361111
    assert curves.uplift_at_k(uplift_df, "y", "t", "s", "id", k=0.5).first()[0] == 0.0


def test_curve_invariant_to_bucketing(uplift_df):
    a = curves.curve(uplift_df, "y", "t", "s", "qini", num_buckets=2).orderBy("n").collect()
    b = curves.curve(uplift_df, "y", "t", "s", "qini", num_buckets=64).orderBy("n").collect()
    assert a == b


def test_deciles_and_errors(spark):
    d = spark.createDataFrame([(float(i),) for i in range(1, 12)], "u double")
    assert [r.Uplift_Decile for r in targeting.decile(d, "u").orderBy("u").collect()] == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    d2 = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "u double")
    assert [r.Uplift_Decile for r in targeting.decile(d2, "u", q=2).orderBy(F.col("u").asc_nulls_first()).collect()] == \
        [None, 0, 0, 1]
    d3 = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "u double")
    with pytest.raises(Exception, match="unique"):
        targeting.decile(d3, "u", q=2).collect()


def test_modes_and_unique(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None)], "k int, v string")
    assert grouped_modes(df, "k", {"m": "v"}).first().m == "a"
    assert df.agg(count_unique_with_null("v")).first()[0] == 3
    assert df.agg(F.count_distinct("v")).first()[0] == 2


def test_tiers_and_time_parse(spark):
    df = spark.createDataFrame([(0.51,), (0.5,), (0.3,), (0.15,), (None,)], "u double")
    assert [r[0] for r in df.select(discount_tier("u")).collect()] == [0.25, 0.15, 0.05, 0.0, 0.0]
    t = spark.createDataFrame([("12:34:56",), ("bad",)], "t string")
    assert [r[0] for r in t.select(hour_of_text_time("t")).collect()] == [12, None]


def test_split_exact_and_partition_independent(spark):
    base = spark.range(1000).selectExpr("id", "cast(id % 3 = 0 as int) t")
    a = stratified_split(base, "id", "t", 0.3, 42)
    counts = {(r.t, r.is_test): r["count"] for r in a.groupBy("t", "is_test").count().collect()}
    assert counts[(0, True)] == 200 and counts[(1, True)] == 101
    b = stratified_split(base.repartition(7), "id", "t", 0.3, 42)
    assert sorted(a.filter("is_test").select("id").collect()) == sorted(b.filter("is_test").select("id").collect())


# The published score table (label, model, order, Qini AUC, AUUC).
PUBLISHED = [
    ("OCSVM", "TwoModels_XGB_vs_RF", 0, 0.6018, 0.4273),
    ("OCSVM", "TwoModels_LOGREG_vs_SVM", 1, 0.1768, 0.0568),
    ("OCSVM", "CT_XGB", 2, 0.4571, 0.5309),
    ("OCSVM", "CT_RF", 3, 0.3520, 0.5330),
    ("Isolation Forest", "TwoModels_XGB_vs_RF", 4, 0.5479, 0.3153),
    ("Isolation Forest", "TwoModels_LOGREG_vs_SVM", 5, 0.4575, 0.1481),
    ("Isolation Forest", "CT_XGB", 6, 0.3598, 0.5000),
    ("Isolation Forest", "CT_RF", 7, 0.3461, 0.4011),
    ("LOF", "TwoModels_XGB_vs_RF", 8, 0.4405, 0.2299),
    ("LOF", "TwoModels_LOGREG_vs_SVM", 9, -0.2836, -0.0461),
    ("LOF", "CT_XGB", 10, 0.2001, 0.3465),
    ("LOF", "CT_RF", 11, 0.2410, 0.5332),
]


def test_best_model_on_published_scores(spark):
    scores = spark.createDataFrame(PUBLISHED, "label string, model string, run_order int, qini_auc double, auuc double")
    best = curves.best_model(scores).first()
    assert (best.model, best.label, best.qini_auc) == ("TwoModels_XGB_vs_RF", "OCSVM", 0.6018)
    table = {r["label"]: r["CT_RF"] for r in curves.comparison_table(scores, ["CT_XGB", "CT_RF"], "auuc").collect()}
    assert table == {"OCSVM": 0.5330, "Isolation Forest": 0.4011, "LOF": 0.5332}


def test_reference_date_counts_lines_without_a_customer(spark, golden_tables):
    """A1: the latest line belongs to no customer; both paths must see it."""
    late = spark.createDataFrame([("O10", None, _d(31), "K1", "S1", 1.0, 10.0, 8.0, 8.0, 8.0, "CASH", "Valid", 1)],
                                 golden_tables["order_details"].schema)
    t = dict(golden_tables, order_details=golden_tables["order_details"].unionByName(late))
    want = {"C1": 26, "C2": 27}
    assert {r.CUSTOMER_ID: r.Recency for r in customer_features(t).collect()} == want
    cleaned = clean.clean_order_lines(t["order_details"], t["store_master"], t["product_master"])
    assert {r.CUSTOMER_ID: r.Recency for r in rfmf.rfm(rfmf.order_level(cleaned)).collect()} == want


def test_repeated_users_repeat_lines(spark, golden_tables):
    """A user master with a repeated key fans out, a unique one changes nothing."""
    unique = spark.createDataFrame([("C1", "a"), ("C2", "b")], "CUSTOMER_ID string, SEGMENT string")
    twice = spark.createDataFrame([("C1", "a"), ("C1", "b")], "CUSTOMER_ID string, SEGMENT string")

    def monetary(users):
        return {r.CUSTOMER_ID: r.Monetary for r in customer_features(dict(golden_tables, user_master=users)).collect()}
    assert monetary(unique) == {"C1": 26.0, "C2": 15.0}
    assert monetary(twice) == {"C1": 52.0, "C2": 15.0}


def test_null_dimension_keys_are_refused(spark):
    lines = spark.createDataFrame([(1, None), (2, 7)], "ORDER_ID long, STORE_ID long")
    good = spark.createDataFrame([(7, "s", "p")], "STORE_ID long, STORE_NAME string, PREFIX string")
    assert [r.ORDER_ID for r in clean.enrich_store(lines, good).collect()] == [2]
    bad = good.unionByName(spark.createDataFrame([(None, "x", "p")], good.schema))
    with pytest.raises(Exception, match="NULL in dimension key STORE_ID"):
        clean.enrich_store(lines, bad).collect()
