"""The customer table's passes grow with orders and counts, whatever the number of partitions."""

import random
from collections import Counter

from churnlift.functions.modes import modes_by_key
from churnlift.operators import rfm
from churnlift.plans import customer_features as table
from churnlift.sources import binding
from conftest import SF001


def test_pass_over_lines_writes_a_row_an_order(spark, monkeypatch):
    written, plain = [], table.materialize
    monkeypatch.setattr(table, "materialize", lambda df: written.append(plain(df)) or written[-1])
    tables = binding.canonical_tables(spark, SF001)
    table.customer_features(tables)
    cleaned = table.cleaned_lines(tables)
    assert len(written) == 1
    assert written[0].count() == cleaned.select("CUSTOMER_ID", "ORDER_ID").distinct().count()
    plain_level = rfm.order_level(cleaned)
    assert written[0].select(plain_level.columns).exceptAll(plain_level).count() == 0
    valid = cleaned.where("ORDER_STATE_FINAL = 'Valid'").select("CUSTOMER_ID", "SKU_CATEGORY", "SKU_SUBCATEGORY")
    held = rfm.lines_of_orders(written[0])
    assert held.exceptAll(valid).count() == 0 and valid.exceptAll(held).count() == 0 and valid.count() > 0


def test_lines_meet_once(spark):
    cleaned = table.cleaned_lines(binding.canonical_tables(spark, SF001))
    plan = rfm.orders_with_lines(cleaned)._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.index("Join")].count("Exchange") == 1


def test_modes_by_key_against_brute_force(spark):
    draw = random.Random(7)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice("ab"), draw.choice(["x", "y", "z", "é"]), draw.randint(1, 3)) for _ in range(200)]
    rows.append((4, "a", "x", 1))
    n = Counter()
    for key, attr, value, w in rows:
        n[key, attr, value] += w
    counts = spark.createDataFrame([(*k, w) for k, w in n.items()], "k int, attr string, value string, n long").repartition(7)
    found = modes_by_key(counts, "k", {"mode_a": "a", "mode_b": "b"}, {"values_a": "a", "values_b": "b"})
    # no wide partial result is shipped: one exchange, of the counts
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for key in {k for k, _, _ in n}:
        of = {attr: {v: w for (k, a, v), w in n.items() if (k, a) == (key, attr)} for attr in "ab"}
        top = [min(of[a], key=lambda v: (-of[a][v], v)) if of[a] else None for a in "ab"]
        want[key] = (*top, len(of["a"]), len(of["b"]))
    assert {r.k: tuple(r)[1:] for r in found.collect()} == want
