"""Range reviews, reports, facts and rules on literal rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyproof.functions import numbers as N, text as T
from tallyproof.operators import intervals as I, ledger as L, panels as P, review as V
from tallyproof.plans import diagnostics as D

VALUES = "store_id string, first date, last date, field string, value decimal(38,4), basis string, reason string, role string"


def day(n, month=1):
    return dt.date(2024, month, n)


def values(spark, rows):
    """rows: (role, field, value, basis, last day)"""
    made = [("s", day(1), day(last), f, None if v is None else Decimal(v), b, "complete_daily_source_values" if v is not None else "missing_dates", r) for r, f, v, b, last in rows]
    return spark.createDataFrame(made, VALUES)


def review(spark, rows, signatures=(("baseline", "x"), ("current", "x"))):
    known = spark.createDataFrame([("s", r, x) for r, x in signatures], "store_id string, role string, signature string")
    return I.compared(values(spark, rows), ["amount", "orders"], ["amount"], known)


DAYS = "sum_non_overlapping_days"


def test_direction_and_belief_follow_the_values(spark):
    rows = lambda a, b: [("baseline", f, v, DAYS, 7) for f, v in (("amount", a), ("orders", 5))] + [("current", f, v, DAYS, 7) for f, v in (("amount", b), ("orders", 6))]
    for a, b, direction, accepted in ((10, 12, 1, "supported"), (12, 10, -1, "rejected")):
        r = review(spark, rows(a, b)).cache()
        assert {x.field: x.direction for x in r.collect()} == {"amount": direction, "orders": 1}
        assert I.alignments(r, [("align", ["amount", "orders"])]).first().verdict == accepted
        found = I.findings(r, ["amount", "orders"], [("align", ["amount", "orders"])], ["align"]).first()
        assert (found.belief, found.evidence, found.findings) == ("active", "supported", "causal_effects_unresolved")
        assert found.n_accepted == 3 + (direction > 0) and found.n_rejected == 5 + (direction < 0) and found.n_unresolved == 0


def test_unequal_windows_are_compared_and_told(spark):
    r = review(spark, [("baseline", "amount", 10, DAYS, 7), ("current", "amount", 12, DAYS, 10)])
    assert r.first().status == "compared"
    assert I.findings(r, ["amount"], [], []).first().findings == "different_window_lengths"


def test_reasons_against_a_comparison(spark):
    rows = [("baseline", "users", None, "source_records", 7), ("current", "users", 3, DAYS, 7), ("baseline", "orders", 1, DAYS, 7), ("current", "orders", 2, "reported_window", 7)]
    got = {x.field: x.against for x in review(spark, rows, (("baseline", "x"), ("current", "y"))).collect()}
    assert got == {"users": "source_values_only; baseline: missing_dates; different_comparison_scopes; different_summary_bases", "orders": "different_comparison_scopes; different_summary_bases"}
    one = review(spark, rows[2:], (("current", "y"),)).first()
    assert one.against == "comparison_scope_unreviewed; different_summary_bases" and one.direction is None
    found = I.findings(review(spark, rows), ["orders"], [], []).first()
    assert (found.belief, found.evidence, found.findings) == ("tentative", "partially_supported", "unresolved_evidence:2")


def test_scopes_need_one_reviewed_signature(spark):
    rec = spark.createDataFrame([("a", day(1), day(1), "x"), ("a", day(2), day(2), "x"), ("b", day(1), day(1), "x"), ("b", day(2), day(2), "y"), ("c", day(1), day(1), None), ("d", day(30), day(31), "x")], "store_id string, period_start date, period_end date, signature string")
    win = spark.createDataFrame([(s, "current", day(1), day(7)) for s in "abcd"], "store_id string, role string, first date, last date")
    assert {r.store_id: r.signature for r in I.scopes(rec, win).collect()} == {"a": "x", "b": None, "c": None}


def test_reverified_tells_each_difference(spark):
    now = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, x string, y int")
    was = spark.createDataFrame([(1, "a", None), (2, "z", 1), (4, "c", 2)], "k int, x string, y int")
    assert {r.k: r.outcome for r in L.reverified(was, now, ["k"]).collect()} == {2: "changed", 3: "missing", 4: "unexpected"}
    assert L.reverified(now, now, ["k"]).count() == 0


def test_digest_of_a_set_ignores_order_and_counts_repeats(spark):
    rows = [("a", f"{i:064x}") for i in range(9)]
    one = lambda x: {r.k: r.digest for r in L.set_digest(spark.createDataFrame(x, "k string, h string"), "k", "h").collect()}
    assert one(rows) == one(rows[::-1]) != one(rows + rows[:1])


def test_publications_are_addressed_by_their_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1" * 64, 1), ("a", "2" * 64, 1), ("b", "3" * 64, 2)], "k string, h string, u int")
    got = {r.k: (r.n, r.n_repeated) for r in L.published(rows, f"{tmp_path}/p", "k", "h", ["u"]).collect()}
    again = {r.k: r.n for r in L.published(rows, f"{tmp_path}/p", "k", "h", ["u"]).collect()}
    assert got == {"a": (2, 1), "b": (1, 0)} and again == {"a": 2, "b": 1}


def test_pairs_meet_once_whatever_the_blocks_are(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(40)], "g int, i int")
    want = {(a, b) for a in range(40) for b in range(a + 2, 40, 2)}
    for block in (3, 1000):
        got = [(r[0], r[1]) for r in P.pairs(df, ["g"], "i", block).select(F.col("a.i"), F.col("b.i")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_few_bytes_of_pairs_are_not_put_into_one_task(spark):
    df = spark.createDataFrame([(i % 20, i) for i in range(400)], "g int, i int")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        met = P.pairs(df, ["g"], "i").select(F.col("a.g"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(met) == 20 * 190 and len({r.task for r in met}) > 1


def test_blocks_of_pairs_compare_no_two_rows_twice(spark):
    """A block is of so many rows that follow each other, so that of two blocks each row of
    one pairs with each row of the other."""
    df = spark.createDataFrame([(f"g{i % 2}", f"s{i * 37 % 101:03}") for i in range(101)], "g string, s string")
    cells = P.pairs(df, ["g"], "s", 10).groupBy("g", "_i", "_j").agg(F.count("*").alias("n"), F.countDistinct("a.s").alias("a"), F.countDistinct("b.s").alias("b"))
    got = {(r.g, r._i, r._j): (r.n, r.a, r.b) for r in cells.collect()}
    assert all(got["g1", i, j] == (100, 10, 10) for j in range(5) for i in range(j)) and all(got["g1", i, i] == (45, 9, 9) for i in range(5)) and len(got) == 15 + 20
    assert sum(n for n, _, _ in got.values()) == 51 * 50 // 2 + 50 * 49 // 2


def test_rounded_is_round(spark):
    rows = [(None,), (0.0,), (float("nan"),), (float("inf"),), (1e300,), (-123456789012.3456,), (4e11 + 0.0001,), *[(x / 10000 - y / 10000,) for x in range(0, 10**9, 99_999_989) for y in range(1, 10**10, 888_888_887)]]
    out = spark.createDataFrame(rows, "x double").select(N.rounded("x", 4).alias("a"), F.round("x", 4).alias("b"))
    assert out.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_places_follow_the_order(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x int").repartition(7)
    assert [(r.x, r.place) for r in P.placed(df, ["x"]).orderBy("x").collect()] == [(i, i + 1) for i in range(101)]


def test_ready_needs_every_core_field_and_the_whole_window(spark):
    base = {c: 1.0 for c in D.CORE}
    rows = [("a", day(1, 3), day(31, 3), *base.values()), ("b", day(1, 3), day(30, 3), *base.values())]
    rows += [(f"c{i}", day(1, 3), day(31, 3), *(None if j == i else 1.0 for j in range(len(base)))) for i in range(len(base))]
    df = spark.createDataFrame(rows, "store_id string, period_start date, period_end date, " + ", ".join(f"{c} double" for c in base))
    got = {r.store_id: r.f for r in df.select("store_id", D.scope_flag(("2024-03-01", "2024-03-31")).alias("f")).collect()}
    assert got.pop("a") == "same_period_diagnostic_ready" and got.pop("b") == "not_comparable_period_mismatch" and set(got.values()) == {"insufficient_data"}
    assert set(D.CORE) == {"transaction_amount", "transaction_orders", "exposure_users", "entry_users", "search_exposure_users", "search_entry_users", "activity_orders", "top3_amount"}


def test_snippets(spark):
    text = "x\nkey one\nkey two\nkey three\n\ny\nkey four\nz\nkey five\nkey"
    rows = [("a", text, ["KEY", "two"]), ("b", "\n one\n\n two ", ["none"]), ("c", " \n", ["none"]), ("d", None, ["none"])]
    df = spark.createDataFrame(rows, "k string, text string, keywords array<string>")
    got = {}
    for r in V.snippets(df, "k").orderBy("k", "snippet_no").collect():
        got.setdefault(r.k, []).append((r.line_start, r.line_end, r.matched_terms, r.status, r.text))
    assert got["a"] == [(1, 3, "KEY", "keyword_matched", "x\nkey one\nkey two"), (3, 5, "KEY", "keyword_matched", "key two\nkey three"), (6, 8, "KEY", "keyword_matched", "y\nkey four\nz")]
    assert got["b"] == [(1, 2, "", "source_found_no_keyword_match", "one\n two")]
    assert got["c"] == [(None, None, "", "source_empty", None)] and got["d"] == [(None, None, "", "source_missing", None)]


def test_coverage_score(spark):
    rows = [("a", "record_matched"), ("a", "keyword_matched"), ("b", "boundary_matched"), ("b", "source_missing"), ("c", "source_found_no_keyword_match")]
    got = {r.k: r.score for r in V.coverage_score(spark.createDataFrame(rows, "k string, status string"), "k").collect()}
    assert got == {"a": 1.0, "b": round(0.25 * 0.5 + 0.15, 4), "c": 0.15}


def test_text_reports(spark):
    stores = spark.createDataFrame([("b", "store_b"), ("c", "store_c")], "alias string, store string")
    profile = V.ReportProfile(r"^Store:\s*(\S+)$", stores, "Window", {"Amount": ("amount", "number"), "Rate": ("rate", "percent")}, {"Top": "top"}, ["note"], ["Visits"])
    good = "note\nStore: b\nWindow: 2024-02\nAmount: 12.5\nRate: 3%\nTop: x 1; y 2\n\nStore: c\nWindow: 2024-02-01 to 2024-02-07\nAmount:\n"
    bad = {
        "format": good.replace("2024-02\n", "2024/02\n"), "store": good.replace("Store: c", "Store: q"), "sign": good.replace("3%", "3"), "list": good.replace("y 2", "y"), "field": good.replace("Rate:", "Mood:"),
        "none": good.replace("Window: 2024-02\n", ""), "twice": good.replace("Rate: 3%", "Amount: 1"), "unit": good + "Visits: 3", "backwards": good.replace("to 2024-02-07", "to 2024-01-07"), "empty": "note\n", "lost": "Amount: 1\n" + good,
        "no window": "Store: b\nStore: c\nWindow: 2024-02",
    }
    texts = spark.createDataFrame([("good", good), *bad.items()], "k string, text string")
    lines = V.report_lines(texts, "k", profile).cache()
    rows = V.report_rows(lines, "k").orderBy("block", "field", "place").collect()
    assert {r.k for r in rows} == {"good"}
    assert [(r.store, r.period_start, r.period_end, r.field, r.place, r.name, r.value) for r in rows] == [
        ("store_b", day(1, 2), day(29, 2), "amount", None, None, 12.5), ("store_b", day(1, 2), day(29, 2), "rate", None, None, 3.0),
        ("store_b", day(1, 2), day(29, 2), "top", 1, "x", 1.0), ("store_b", day(1, 2), day(29, 2), "top", 2, "y", 2.0), ("store_c", day(1, 2), day(7, 2), "amount", None, None, None),
    ]
    issues = {r.k: r.i for r in lines.groupBy("k").agg(F.max("issue").alias("i")).collect()}
    assert issues["good"] is None and issues["format"] == "window format" and issues["store"] == "unregistered store" and issues["sign"] == "percentage without a sign"
    assert issues["list"] == "list format" and issues["field"] == "unknown field or section" and issues["none"] == "data before a window" and issues["twice"] == "repeated field or list"
    assert issues["unit"] == "unit not confirmed" and issues["backwards"] == "window format" and issues["lost"] == "content without a store header"


def test_request_windows(spark):
    cases = {
        "sales from 2024-02-01 to 2024-02-07": (day(1, 2), day(7, 2), None), "2024-02-01至2024-02-07": (day(1, 2), day(7, 2), None), "in February 2024": (day(1, 2), day(29, 2), None),
        "2024年3月": (day(1, 3), day(31, 3), None), "2024年十二月的订单": (day(1, 12), day(31, 12), None), "2024年十一月": (day(1, 11), day(30, 11), None), "2024-02 to 2024-03": (day(1, 2), day(31, 3), None),
        "how are we doing": (None, None, None), "last month": (None, None, "relative time"), "上月": (None, None, "relative time"), "on 2024-02-01": (None, None, "sub-month date"), "since March 2024": (None, None, "open window"),
        "2024-02-30 to 2024-03-01": (None, None, "no such date"), "2024-03-02 to 2024-03-01": (None, None, "ends before it starts"), "2024-01, 2024-05": (None, None, "not one window"),
        "2024-02-01 to 2024-02-07 and March 2024": (None, None, "several windows"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", T.request_window("q").alias("w"))
    assert {r.q: (r.w.start, r.w.end, r.w.error) for r in df.collect()} == cases


def test_entity_mentions(spark):
    cases = {"Compare stores B-D with store a1": "store_b,store_c,store_d,store_a1", "stores D - B": "store_b,store_c,store_d", "store_k7 and Store z": "store_k7,store_z", "restore b, stores": "", None: "", "store b, store b": "store_b"}
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", F.array_join(T.entity_mentions("q"), ",").alias("m"))
    assert {r.q: r.m for r in df.collect()} == cases


def test_ruled_facts(spark):
    from tallyproof.plans.review import FACT_RULES

    cases = {"价格是 12.5 元": ("product_price", "12.5 元"), "今天满100减20, 现货": ("promo", "满100减20"), "现货": ("stock_status", "现货"), "7天内发货": ("shipping_policy", "7天内发货"), "主打轻便": ("product_feature", "轻便"), "价格面议": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", V.ruled_facts(F.col("q"), FACT_RULES).alias("f"))
    assert {r.q: r.f and (r.f.type, r.f.value) for r in df.collect()} == cases


def test_facts_name_their_product_and_place(spark):
    import re

    from tallyproof.plans.review import FACT_RULES, GENERIC, PRODUCT_RULES

    texts = ["蓝杯的价格是 12.5 元", " 蓝杯-2现货, 满100减20 ", "这款产品主打轻便", "cup_7支持包邮", "该产品价格是3元 主打", "我要7天内发货", "3件8折和8折", "蓝杯目前售罄", "价格面议", None]
    df = spark.createDataFrame([(k,) for k in texts], "q string").select("q", V.ruled_facts(F.col("q"), FACT_RULES, PRODUCT_RULES, GENERIC).alias("f"))
    for r in df.collect():
        t = (r.q or "").strip()
        hit = next(((kind, v or m[1].strip(), m) for kind, p, v in FACT_RULES if (m := re.search(p, t))), None)
        refs = [m[1] for p in PRODUCT_RULES if (m := re.search(p, t)) and m[1] not in GENERIC]
        assert (r.f and tuple(r.f)) == (hit and (*hit[:2], refs[0] if refs else None, hit[2].start() + 1, hit[2].end()))


def test_lines_are_accounted_for_by_ranges(spark):
    lines = [("a", n) for n in (1, 2, 3, 7, 9, 9, 10, 10, 12, 12, 0, 21, 22)] + [("b", 1), ("b", 2), ("d", 5), ("e", None), ("e", 1)] + [("f", 999_999_999)]
    df = spark.createDataFrame(lines, "k string, n int")
    want = spark.createDataFrame([("a", 20), ("b", 2), ("c", 3), ("e", 1), ("f", 1_000_000_000), ("z", 0)], "k string, n_lines int")
    got = {r.k: (r.n_expected, r.n_found, r.missing, r.repeated, r.unexpected, r.complete) for r in L.accounted(df, want, "k", "n", "n_lines").collect()}
    assert got == {
        "a": (20, 13, "4..6,8..8,11..11,13..20", "9..10,12..12", "0..0,21..22", False), "b": (2, 2, "", "", "", True), "c": (3, 0, "1..3", "", "", False),
        "d": (None, 1, "", "", "5..5", False), "e": (1, 2, "", "", "", False), "f": (1_000_000_000, 1, "1..999999998,1000000000..1000000000", "", "", False), "z": (0, 0, "", "", "", True),
    }


def test_request_windows_in_other_words(spark):
    def win(a, b):
        return dt.date.fromisoformat(a), dt.date.fromisoformat(b)

    quarter = win("2024-03-01", "2024-05-31")
    cases = {
        "Mar. 2024 through May 2024": quarter, "march to may 2024": quarter, "2024-03_to_2024-05": quarter, "2024-03–2024-05": quarter, "2024-03-2024-05": quarter, "mar-may 2024": quarter, "2024年3月～2024年5月": quarter,
        "Sept 2024": win("2024-09-01", "2024-09-30"), "sep 2024": win("2024-09-01", "2024-09-30"), "September 2024": win("2024-09-01", "2024-09-30"), "2024-01-05 through 2024-01-09": win("2024-01-05", "2024-01-09"), "2024-01-05—2024-01-09": win("2024-01-05", "2024-01-09"),
        "Dec 2023 and Jan 2024": win("2023-12-01", "2024-01-31"), "2024-03, 2024-04": win("2024-03-01", "2024-04-30"), "Jan 2024 and Mar 2024": None, "marching 2024 may": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string").select("q", T.request_window("q").alias("w"))
    for r in df.collect():
        assert (None if r.w.error else (r.w.start, r.w.end)) == cases[r.q], r
