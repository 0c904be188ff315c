"""Skew: one customer holding a third of all lines.  The two-stage mode /
distinct-count and the order-level aggregation must give the same answer
as a brute-force pandas computation."""

import pandas as pd
from pyspark.sql import functions as F

from churnlift.functions.modes import attribute_values, mode_of, nunique_of, value_counts_by_key
from churnlift.sources import binding
from conftest import SF001


def test_hot_customer_modes_match_bruteforce(spark):
    od = binding.order_lines(spark, SF001)
    # a third of the lines move to one hot customer
    hot = od.withColumn("CUSTOMER_ID", F.when(F.col("ORDER_ID") % 3 == 0, F.lit(-1)).otherwise(F.col("CUSTOMER_ID")))
    counts = value_counts_by_key([attribute_values(hot, "CUSTOMER_ID", {"pay": "PAYMENT_METHOD", "store": "STORE_ID"})],
                                 "CUSTOMER_ID")
    got = counts.groupBy("CUSTOMER_ID").agg(mode_of("pay").alias("pay"), mode_of("store").alias("store"),
                                            nunique_of("store").alias("n_store")).toPandas()
    pdf = hot.select("CUSTOMER_ID", "PAYMENT_METHOD", F.col("STORE_ID").cast("string").alias("STORE_ID")).toPandas()
    assert (pdf["CUSTOMER_ID"] == -1).mean() > 0.3
    pdf = pdf[pdf["CUSTOMER_ID"].notna()]

    def mode(s):
        m = s.dropna().astype(str).mode()
        return m.sort_values().iloc[0] if len(m) else None
    want = pdf.groupby("CUSTOMER_ID").agg(pay=("PAYMENT_METHOD", mode), store=("STORE_ID", mode),
                                          n_store=("STORE_ID", "nunique")).reset_index()
    m = want.merge(got, on="CUSTOMER_ID", suffixes=("_w", "_g"))
    assert len(m) == len(want) == len(got)
    assert (m["pay_w"] == m["pay_g"]).all()
    assert (m["store_w"] == m["store_g"]).all()
    assert (m["n_store_w"] == m["n_store_g"]).all()
