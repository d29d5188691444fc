"""Edge cases of the library's operators on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from tallyproof.functions import numbers as N, text as T, values as V
from tallyproof.operators import intervals as I, ledger as L, panels as P, retrieval as R
from tallyproof.sources import files as S


def day(n, month=1):
    return dt.date(2024, month, n)


def test_blank_isn_t_zero_and_errors_aren_t_zero(spark):
    df = spark.createDataFrame([("0",), (" ",), (None,), ("5%",), ("1e3",), ("-3",), ("1,000",), (" 12　",), ("9223372036854775808",)], "c string")
    rows = df.select(V.canonical("c", "count").alias("v"), V.error("c", "count", "c").alias("e")).collect()
    assert [r.v for r in rows] == [0, None, None, None, None, None, None, 12, None]
    assert [r.e is not None for r in rows] == [False, False, False, True, True, True, True, False, True]


def test_dates_and_ranks_are_strict(spark):
    df = spark.createDataFrame([("2024-02-30", "0"), ("2024-2-3", "1"), ("2024-02-03", "x")], "d string, r string")
    rows = df.select(V.canonical("d", "date").alias("d"), V.canonical("r", "rank").alias("r")).collect()
    assert [(r.d, r.r) for r in rows] == [(None, None), (None, 1), (dt.date(2024, 2, 3), None)]


def test_finite_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("1e999",), ("1e-999",), ("0.0",), ("nan",), ("x",)], "c string")
    assert [r.v for r in df.select(V.finite("c").alias("v")).collect()] == [1.5, None, None, 0.0, None, None]


def test_top_sum_is_guarded(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 99.0), ("b", 1, 1.0), ("b", 2, 2.0), ("c", 1, 1.0), ("c", 1, 2.0), ("c", 3, 3.0), ("d", 1, 1.0), ("d", 2, None), ("d", 3, 3.0)]
    df = spark.createDataFrame([(s, day(1), day(31), r, v) for s, r, v in rows], "store_id string, period_start date, period_end date, sku_rank int, sku_transaction_amount double")
    assert {r.store_id: r.top3_amount for r in P.top_sum(df).collect()} == {"a": 6.0, "b": None, "c": None, "d": None}


def test_average_and_unanimous_need_every_row(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "x"), ("b", 1.0, "x"), ("b", None, "y")], "k string, v double, t string")
    rows = {r.k: (r.a, r.u) for r in df.groupBy("k").agg(N.guarded_avg("v").alias("a"), N.unanimous("t").alias("u")).collect()}
    assert rows == {"a": (1.5, "x"), "b": (None, None)}


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 3.0), (None, 3.0)], "x double, y double")
    assert [r.p for r in df.select(N.pct("x", "y").alias("p")).collect()] == [None, 33.33, None]


REC = "store_id string, period_start date, period_end date, batch string, scope string, grain string, amount decimal(38,4), users decimal(38,4)"


def reasons(spark, records, first=day(1), last=day(3)):
    req = spark.createDataFrame([("s", first, last)], "store_id string, first date, last date")
    out = I.range_values(spark.createDataFrame(records, REC), req, ["amount"], ["users"])
    return {r.field: (r.reason, None if r.value is None else float(r.value)) for r in out.collect()}


def rec(a, b, amount=1, batch="x", scope="all", grain="store_period"):
    from decimal import Decimal

    return ("s", day(a), day(b), batch, scope, grain, None if amount is None else Decimal(amount), Decimal(1))


def test_range_reasons(spark):
    days = [rec(1, 1), rec(2, 2), rec(3, 3)]
    assert reasons(spark, days) == {"amount": ("complete_daily_source_values", 3.0), "users": ("aggregation_not_registered", None)}
    assert reasons(spark, days[:2])["amount"] == ("missing_dates", None)
    assert reasons(spark, [*days[:2], rec(3, 3, None)])["amount"] == ("missing_metric_values", None)
    assert reasons(spark, [rec(1, 3, 7)])["amount"] == ("reported_value", 7.0)
    assert reasons(spark, [rec(1, 3, None)])["amount"] == ("missing_reported_value", None)
    assert reasons(spark, [rec(1, 31)])["amount"][0] == "ambiguous_source_scope_or_window"
    assert reasons(spark, [*days, rec(1, 3, batch="y")])["amount"][0] == "ambiguous_source_scope_or_window"
    assert reasons(spark, [*days, rec(2, 2, batch="y")])["amount"][0] == "ambiguous_source_scope_or_window"
    assert reasons(spark, [rec(1, 1), rec(2, 2, scope="other"), rec(3, 3)])["amount"][0] == "ambiguous_source_scope_or_window"
    assert reasons(spark, [rec(1, 1), rec(2, 2, scope=None), rec(3, 3)])["amount"][0] == "aggregation_scope_unreviewed"
    assert reasons(spark, [rec(1, 1), rec(2, 3)])["amount"][0] == "aggregation_requires_daily_source_records"
    assert reasons(spark, [rec(1, 1, grain="store_sku_period")])["amount"][0] == "ranked_records_only"
    assert reasons(spark, [rec(9, 9)]) == {"amount": ("no_contained_source_records", None), "users": ("no_contained_source_records", None)}
    assert reasons(spark, [])["amount"][0] == "no_contained_source_records"


def test_coverage_and_overlaps(spark):
    w = spark.createDataFrame([("s", day(1), day(4), "a", day(1), day(20)), ("s", day(3), day(6), "b", day(1), day(20)), ("s", day(10), day(12), "c", day(1), day(20))], "k string, period_start date, period_end date, batch string, first date, last date")
    r = I.coverage(w, ["k"]).first()
    assert (r.requested_days, r.covered_days, r.missing) == (20, 9, "2024-01-07..2024-01-09,2024-01-13..2024-01-20")
    o = I.overlaps(w, "k", "batch").collect()
    assert [(x.left, x.right, x.start, x.end) for x in o] == [("a", "b", day(3), day(4))]


def test_revisions(spark):
    rows = [("s", 1, 10, "x", None, 1, True), ("s", 2, 10, "x", None, 2, True), ("s", 3, 10, "z", None, 3, True), ("s", 4, 11, "y", None, 4, True), ("s", 5, 12, "w", 4, 5, True), ("s", 6, 13, "v", 5, 6, False), ("s", 7, 14, "u", 9, 7, True)]
    got = {r.batch_id: r.verdict for r in L.judged(spark.createDataFrame(rows, "scope string, batch_id int, upload_id int, bytes string, supersedes int, extracted_at int, valid boolean"), ["scope"]).collect()}
    assert got == {1: "validated", 2: "repeat", 3: "held: other bytes", 4: "held: no predecessor given", 5: "validated", 6: "held: invalid rows", 7: "held: wrong predecessor"}


def test_one_bad_row_holds_the_batch(spark):
    df = spark.createDataFrame([(1, False), (1, True), (2, False), (3, None)], "b int, bad boolean")
    assert {r.b: r.held for r in P.all_or_nothing(df, "b", F.col("bad")).collect()} == {1: True, 2: False, 3: False}


def test_text(spark):
    df = spark.createDataFrame([("Sales: a (b,c), d",), ("",), (None,)], "t string")
    r = df.select(T.after_label("t", "Sales").alias("a"), T.outside_parentheses("t").alias("p"), T.blank_to_null("t").alias("b"), T.span("t", "d").alias("s")).collect()
    assert r[0].a == "a (b,c), d" and r[0].p == ["Sales: a (b,c)", " d"] and (r[0].s.start, r[0].s.end) == (17, 18)
    assert r[1].b is None and r[2].b is None
    assert df.select(T.snippet(F.lit("x " * 400 + "needle " + "y " * 400), ["needle"], 40).alias("s")).first().s.find("needle") > 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(N.cosine("a", "b").alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_top_k_breaks_ties_by_document(spark):
    df = spark.createDataFrame([(1, d, s) for d, s in ((5, 0.5), (3, 0.5), (9, 0.9), (1, 0.1))], "query_id int, doc_id int, score double")
    assert [r.doc_id for r in R.top_k(df, 3).orderBy("rank").collect()] == [9, 3, 5]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,2\n\n3\n", encoding="utf-8")
    rows = S.read_csv(spark, f"{tmp_path}/a.csv", ["x", "y"]).collect()
    assert [(r.x, r.y, r._corrupt is None) for r in rows] == [("1", "2", True), ("3", None, False)]


def test_sql_function_equals_the_column(spark):
    V.sql_function(spark, "tp_count", "count")
    df = spark.createDataFrame([("7 ",), ("7%",), ("",)], "c string")
    assert [r.a for r in df.select(F.expr("tp_count(c)").alias("a")).collect()] == [7, None, None]


def test_flag_is_three_valued(spark):
    from tallyproof.plans import diagnostics as D

    base = {**{m: 1.0 for m in D.MOM}, **{r: 1 for r in D.RANKS}, "order_conversion_rate_pct": 50.0, "activity_orders": 1, "activity_cost": 1.0, "merchant_subsidy_amount": 1.0}
    base = {**dict.fromkeys([*D.CARRIED, *D.STORE_RATES], 1.0), **base}

    def months(second):
        rows = [{**base, "store_id": "s", "period_start": day(1, m), "period_end": day(28, m), "period_month": f"2024-0{m}", **(second if m == 2 else {})} for m in (1, 2)]
        panel = spark.createDataFrame(rows)
        skus = spark.createDataFrame([], "store_id string, period_start date, period_end date, sku_rank int, sku_transaction_amount double")
        return [r.tradeoff for r in D.month_over_month(panel, skus).orderBy("period_start").collect()]

    worse = {"transaction_amount": 2.0, "transaction_orders": 2.0, "order_conversion_rate_pct": 40.0, "average_order_value": 0.5}
    assert months(worse) == [False, True]
    assert months({**worse, "average_order_value": 2.0}) == [False, False]
    assert months({**worse, "average_order_value": None}) == [False, None]


def test_commas_in_quoted_cells_are_no_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"x, y",3\n1,2\n"say ""a, b""",,\n,,\n')
    row = S.physical_rows(spark, str(tmp_path), 3).first()
    assert (row.file, row.n_rows, row.n_wrong_width) == ("a.csv", 4, 1)
