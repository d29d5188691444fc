"""Percentiles and interval joins on large groups and on literal rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tallyproof.operators import intervals as I, quantiles as Q


def test_percentiles_of_one_group_of_ten_million(spark):
    n = 10_000_000
    df = spark.range(n).select(F.lit("all").alias("g"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("v"))
    got = {r.p: r.v for r in Q.percentiles(df, ["g"], "v", [0.0, 0.25, 0.333, 1.0]).collect()}
    assert got.keys() == {0.0, 0.25, 0.333, 1.0} and all(abs(v - p * (n - 1)) < 1e-6 for p, v in got.items())


def test_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.0, -3.5, 1e300, rng.random()])) for _ in range(400)]
    rows += [("one", 5.0), ("none", None), ("a", None), *[("same", 7.25)] * 50]
    out = Q.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()
    own = {g: [v for x, v in rows if x == g and v is not None] for g in {g for g, _ in rows}}
    assert len(out) == 5 * len(own)
    for r in out:
        assert r.n == len(own[r.g]) and (r.v is None) == (r.n == 0)
        assert r.v is None or np.isclose(r.v, np.quantile(own[r.g], r.p), rtol=1e-12)


def test_percentiles_without_keys_or_rows(spark):
    df = spark.range(5).select(F.col("id").cast("double").alias("v"))
    assert [(r.p, r.n, r.v) for r in Q.percentiles(df, [], "v", [0.5]).collect()] == [(0.5, 5, 2.0)]
    assert Q.percentiles(df.limit(0), [], "v", [0.5]).collect() == []


def date(k):
    return dt.date(2024, 1, 1) + dt.timedelta(k)


def test_overlapping_windows_equal_all_pairs(spark):
    rng = random.Random(5)
    window = lambda: (lambda a: (date(a), date(a + rng.choice([0, 0, 1, 6, 30, 400, 9000]))))(rng.randint(-20000, 2000))
    left = [(rng.choice("ab"), i, *window()) for i in range(120)] + [("a", 900, None, date(1)), ("a", 901, date(9), date(3)), ("c", 902, date(0), date(1))]
    right = [(rng.choice("ab"), i, *window()) for i in range(150)] + [("a", 900, date(1), None), (None, 901, date(0), date(1)), ("b", 902, dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    a = spark.createDataFrame(left, "s string, i int, x date, y date")
    b = spark.createDataFrame(right, "s string, j int, u date, v date")
    got = sorted((r.i, r.j) for r in I.overlapping(a, b, ["s"], ("x", "y"), ("u", "v")).collect())
    ok = lambda r: None not in r and r[2] <= r[3]
    assert got == sorted((p[1], q[1]) for p in filter(ok, left) for q in filter(ok, right) if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])


def test_a_store_with_very_many_windows_costs_what_it_matches(spark):
    """100,000 windows and 1,000 requests of one store: the join compares no other pairs,
    and no cell has more than a small share of them."""
    windows = spark.range(100_000).select(F.lit("s").alias("s"), F.col("id").alias("w"), F.date_add(F.lit(date(0)), F.col("id").cast("int")).alias("u")).withColumn("v", F.date_add("u", (F.col("w") % 3).cast("int")))
    asked = spark.range(1000).select(F.lit("s").alias("s"), F.col("id").alias("q"), F.date_add(F.lit(date(0)), (F.col("id") * 97).cast("int")).alias("x")).withColumn("y", F.date_add("x", 6))
    out = I.overlapping(asked, windows, ["s"], ("x", "y"), ("u", "v"))
    want = sum(1 for q in range(1000) for w in range(max(0, q * 97 - 2), min(99_999, q * 97 + 6) + 1) if w + w % 3 >= q * 97)
    assert out.count() == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_cell" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_requests_are_answered_as_before(spark):
    rec = [("a", date(0), date(0), "d", "all", "store_period", 1.0), ("a", date(1), date(1), "d", "all", "store_period", 2.0), ("b", date(0), date(6), "w", "all", "store_period", 9.0), ("c", date(0), date(3), "w", None, "store_period", 4.0)]
    records = spark.createDataFrame(rec, "store_id string, period_start date, period_end date, batch string, scope string, grain string, amount double")
    requests = spark.createDataFrame([(s, date(0), date(1)) for s in "abcd"], "store_id string, first date, last date")
    got = {r.store_id: (r.value, r.reason) for r in I.range_values(records, requests, ["amount"], []).collect()}
    assert float(got["a"][0]) == 3.0 and got["a"][1] == "complete_daily_source_values"
    assert got["b"] == (None, "ambiguous_source_scope_or_window") and got["c"] == (None, "aggregation_scope_unreviewed") and got["d"] == (None, "no_contained_source_records")
