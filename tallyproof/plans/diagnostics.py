"""Store diagnostics: month over month, same period, coverage, repeated windows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..adapters import SKU, SP, sku_period, store_period, table, tasks
from ..functions import numbers as N
from ..operators import panels as P
from ..registry import query

KEY = ["store_id", "period_start", "period_end"]
K = ", ".join(KEY)
MOM = ["transaction_amount", "transaction_orders", "estimated_income_proxy", "exposure_users", "search_exposure_users", "entry_users", "search_entry_users", "order_users", "payment_users", "average_order_value"]
RANKS = ["store_average_rank", "search_average_rank"]
SHARES = {
    "search_exposure_share_pct": ("search_exposure_users", "exposure_users"), "search_entry_share_pct": ("search_entry_users", "entry_users"),
    "search_entry_rate_pct": ("search_entry_users", "search_exposure_users"), "income_ratio_pct": ("estimated_income_proxy", "transaction_amount"),
    "activity_order_share_pct": ("activity_orders", "transaction_orders"), "merchant_subsidy_share_pct": ("merchant_subsidy_amount", "activity_cost"),
    "top3_share_pct": ("top3_amount", "transaction_amount"),
}
#: What a month must have to be called ready.
CORE = ["transaction_amount", "transaction_orders", "exposure_users", "entry_users", "search_exposure_users", "search_entry_users", "activity_orders", "top3_amount"]
TRADEOFF = ["transaction_amount", "transaction_orders", "order_conversion_rate_pct", "average_order_value"]
MONTHS = ["1996-01", "1996-02", "1996-03"]
TARGET = "1996-03"
WINDOW = ("1996-03-01", "1996-03-31")
#: Carried as they are into the results.
CARRIED = [
    "exposure_times", "store_average_rank", "search_average_rank", "entry_times", "order_times", "order_amount", "payment_amount",
    "activity_original_transaction_amount", "activity_orders", "activity_cost", "merchant_subsidy_amount", "platform_subsidy_amount",
    "refund_amount", "full_refund_orders", "refund_orders",
]
STORE_RATES = ["entry_conversion_rate_pct", "order_conversion_rate_pct", "payment_conversion_rate_pct", "activity_cost_ratio_pct"]
LISTED = ["merchant_list_exposure_users", "merchant_list_average_rank", "merchant_list_entry_users", "business_district_rank"]
CHECKED = ["transaction_amount", "transaction_orders", "entry_users", "search_exposure_users", "order_users", "payment_users", "average_order_value"]
AMOUNTS = ["transaction_amount", "transaction_orders", "exposure_users", "entry_users", "search_exposure_users", "search_entry_users"]
COUNTED = ["activity_orders"]  # differences without a percentage
DELTA_RATES = ["entry_conversion_rate_pct", "order_conversion_rate_pct", "payment_conversion_rate_pct", "activity_cost_ratio_pct"]
PIVOTED = [*AMOUNTS, *COUNTED, *DELTA_RATES]
TOP = f"top AS (SELECT {K}, CASE WHEN count(*) = 3 AND count(DISTINCT sku_rank) = 3 AND count(sku_transaction_amount) = 3 THEN CAST(round(sum(CAST(sku_transaction_amount AS DECIMAL(18, 4))), 2) AS DOUBLE) END AS top3_amount FROM sku WHERE sku_rank <= 3 GROUP BY ALL)"


def _pct(x, y):
    return f"round(CAST({x} AS DOUBLE) * 100 / nullif(CAST({y} AS DOUBLE), 0), 2)"


def _mom(c):
    return f"round((CAST({c} AS DOUBLE) - CAST(prev_{c} AS DOUBLE)) * 100 / nullif(CAST(prev_{c} AS DOUBLE), 0), 2)"


def month_over_month(panel, skus, parts=None):
    """Shares, previous values, changes and the trade-off flag of every month: at a
    store's latest month, whether amount and orders rose while order conversion and
    order value fell; null there if any of the eight inputs is missing. Earlier months come before
    the top lists, as the panel's months of a store are together."""
    df = P.with_top(P.latest(P.previous(panel, [*MOM, *RANKS, "order_conversion_rate_pct"])), skus, parts)
    df = df.withColumns({n: N.pct(x, y) for n, (x, y) in SHARES.items()})
    df = df.withColumns({f"{m}_mom_pct": N.change_pct(m, f"prev_{m}") for m in MOM} | {f"{m}_change": N.difference(m, f"prev_{m}") for m in RANKS})
    ups = [F.col(m) > F.col(f"prev_{m}") for m in TRADEOFF[:2]] + [F.col(m) < F.col(f"prev_{m}") for m in TRADEOFF[2:]]
    missing = [F.col(c).isNull() for m in TRADEOFF for c in (m, f"prev_{m}")]
    any_, all_ = missing[0], ups[0]
    for x in missing[1:]:
        any_ = any_ | x
    for x in ups[1:]:
        all_ = all_ & x
    flag = F.when(~F.col("is_latest"), False).when(any_, None).otherwise(all_)
    return df.withColumn("tradeoff", flag).select(*KEY, "period_month", "top3_amount", *MOM, *CARRIED, *STORE_RATES, *SHARES, *(f"prev_{m}" for m in [*MOM, *RANKS]), *(f"{m}_mom_pct" for m in MOM), *(f"{m}_change" for m in RANKS), "is_latest", "tradeoff")


_ANY = " OR ".join(f"{c} IS NULL" for m in TRADEOFF for c in (m, f"prev_{m}"))
_ALL = " AND ".join([f"{m} > prev_{m}" for m in TRADEOFF[:2]] + [f"{m} < prev_{m}" for m in TRADEOFF[2:]])
MOM_CTE = f"""{SP}, {SKU}, {TOP},
lagged AS (SELECT sp.*, top3_amount, {", ".join(f"lag({m}) OVER w AS prev_{m}" for m in [*MOM, *RANKS, "order_conversion_rate_pct"])}, period_start = max(period_start) OVER (PARTITION BY store_id) AS is_latest
FROM sp LEFT JOIN top USING ({K}) WINDOW w AS (PARTITION BY store_id ORDER BY period_start))"""
DIA1 = f"""WITH {MOM_CTE} SELECT {K}, period_month, top3_amount, {", ".join([*MOM, *CARRIED, *STORE_RATES])}, {", ".join(f"{_pct(x, y)} AS {n}" for n, (x, y) in SHARES.items())}, {", ".join(f"prev_{m}" for m in [*MOM, *RANKS])},
{", ".join(f"{_mom(m)} AS {m}_mom_pct" for m in MOM)}, {", ".join(f"{m} - prev_{m} AS {m}_change" for m in RANKS)}, is_latest, CASE WHEN NOT is_latest THEN false WHEN {_ANY} THEN NULL ELSE {_ALL} END AS tradeoff FROM lagged"""


@query("dia1_month_over_month", DIA1)
def dia1(spark, d):
    return month_over_month(store_period(spark, d), sku_period(spark, d), tasks(spark, d))


def scope_flag(window: tuple):
    """Whether a row can be compared within the target window (first day, last day)."""
    gaps = F.lit(False)
    for c in CORE:
        gaps = gaps | F.col(c).isNull()
    other = (F.col("period_start") != F.lit(window[0]).cast("date")) | (F.col("period_end") != F.lit(window[1]).cast("date"))
    return F.when(other, "not_comparable_period_mismatch").when(gaps, "insufficient_data").otherwise("same_period_diagnostic_ready")


def notes(high: float = 80, moderate: float = 65, concentrated: float = 25):
    """Notes on a row, joined by '; '."""
    share, top = F.col("activity_order_share_pct"), F.col("top3_share_pct")
    return F.concat_ws(
        "; ", F.when(F.col("transaction_amount").isNull(), "missing amount"), F.when(F.col("top3_amount").isNull(), "missing top-3 amount"),
        F.when(share >= high, "high activity share").when(share >= moderate, "moderate activity share"), F.when(top >= concentrated, "top-3 concentration"), F.lit("one period only"),
    )


def same_period(panel, skus, window: tuple, parts=None, **limits):
    """Every window with its metrics, shares, scope flag and notes."""
    df = P.with_top(panel, skus, parts)
    df = df.withColumns({n: N.pct(x, y) for n, (x, y) in SHARES.items()})
    return df.select(*SAME_PERIOD, scope_flag(window).alias("scope_flag"), notes(**limits).alias("notes"))


SAME_PERIOD = [*KEY, "period_month", "region_type", "store_type", "top3_amount", *MOM, *CARRIED, *LISTED, *STORE_RATES, *SHARES]


def _notes(high, moderate, concentrated):
    return f"concat_ws('; ', CASE WHEN transaction_amount IS NULL THEN 'missing amount' END, CASE WHEN top3_amount IS NULL THEN 'missing top-3 amount' END, CASE WHEN activity_order_share_pct >= {high} THEN 'high activity share' WHEN activity_order_share_pct >= {moderate} THEN 'moderate activity share' END, CASE WHEN top3_share_pct >= {concentrated} THEN 'top-3 concentration' END, 'one period only')"


SHARED_SQL = f"{SP}, {SKU}, {TOP}, sh AS (SELECT sp.*, top3_amount, {', '.join(f'{_pct(x, y)} AS {n}' for n, (x, y) in SHARES.items())} FROM sp LEFT JOIN top USING ({K}))"
FLAG_SQL = f"CASE WHEN period_start <> DATE '{WINDOW[0]}' OR period_end <> DATE '{WINDOW[1]}' THEN 'not_comparable_period_mismatch' WHEN {' OR '.join(f'{c} IS NULL' for c in CORE)} THEN 'insufficient_data' ELSE 'same_period_diagnostic_ready' END"


@query("dia2_same_period", f"WITH {SHARED_SQL} SELECT {', '.join(SAME_PERIOD)}, {FLAG_SQL} AS scope_flag, {_notes(80, 65, 25)} AS notes FROM sh")
def dia2(spark, d):
    return same_period(store_period(spark, d), sku_period(spark, d), WINDOW, tasks(spark, d))


_AVG = ", ".join(f"CASE WHEN count({m}) = count(*) THEN round(CAST(sum(CAST({m} AS DECIMAL(18, 4))) AS DOUBLE) / count({m}), 2) END AS avg_{m}" for m in CHECKED)
_UNA = lambda c: f"CASE WHEN count({c}) = count(*) AND count(DISTINCT {c}) = 1 THEN max({c}) END AS {c}"
_IN = ", ".join(f"'{m}'" for m in MONTHS)


@query("dia3_panel_coverage", f"""WITH {SP}, g AS (SELECT store_id, count(DISTINCT period_month) AS n_months, min(period_month) AS first_month, max(period_month) AS last_month, string_agg(DISTINCT period_month, '|' ORDER BY period_month) AS observed_months, {_AVG}, {_UNA("region_type")} FROM sp WHERE period_month IN ({_IN}) GROUP BY store_id)
SELECT *, n_months = 3 AND observed_months = '{"|".join(MONTHS)}' AS ready FROM g""")
def dia3(spark, d):
    return P.coverage(store_period(spark, d).where(F.col("period_month").isin(MONTHS)), MONTHS, CHECKED)


_CELLS = ", ".join(f"max(CASE WHEN period_month = '{m}' THEN {c} END) AS {c}_{m.replace('-', '_')}" for c in PIVOTED for m in MONTHS)
_A, _Z = (MONTHS[i].replace("-", "_") for i in (0, -1))
_D = ", ".join([f"round(CAST({c}_{_Z} AS DOUBLE) - CAST({c}_{_A} AS DOUBLE), 2) AS {c}_delta" for c in [*AMOUNTS, *COUNTED]] + [f"CASE WHEN {c}_{_A} > 0 THEN round((CAST({c}_{_Z} AS DOUBLE) - CAST({c}_{_A} AS DOUBLE)) * 100 / nullif(CAST({c}_{_A} AS DOUBLE), 0), 2) END AS {c}_pct" for c in AMOUNTS] + [f"round({c}_{_Z} - {c}_{_A}, 2) AS {c}_pp" for c in DELTA_RATES])


_SEEN = "count(DISTINCT period_month) AS observed_month_count, min(period_month) AS first_observed_month, max(period_month) AS last_observed_month"
_READY = f"CASE WHEN observed_month_count = 3 AND first_observed_month = '{MONTHS[0]}' AND last_observed_month = '{MONTHS[-1]}' THEN 'summary_ready_for_descriptive_review' ELSE 'insufficient_repeated_window_coverage' END AS summary_flag"


@query("dia4_repeated_windows", f"WITH {SP}, p AS (SELECT store_id, {_UNA('region_type')}, {_UNA('store_type')}, {_SEEN}, {_CELLS} FROM sp WHERE period_month IN ({_IN}) GROUP BY store_id) SELECT *, {_D}, {_READY} FROM p")
def dia4(spark, d):
    return repeated_windows(store_period(spark, d), MONTHS)


def repeated_windows(panel, months: list):
    """One row for each store: its metrics of each month, changes from the first month
    to the last, and whether every month is there."""
    out = P.endpoints(P.pivoted(panel, months, PIVOTED, seen=True), months, AMOUNTS, DELTA_RATES, COUNTED)
    whole = (F.col("observed_month_count") == len(months)) & (F.col("first_observed_month") == months[0]) & (F.col("last_observed_month") == months[-1])
    return out.withColumn("summary_flag", F.when(whole, "summary_ready_for_descriptive_review").otherwise("insufficient_repeated_window_coverage"))


@query("dia5_guardrail_sensitivity", f"""WITH {SHARED_SQL}, sc AS (SELECT * FROM (VALUES ('minus', -5), ('baseline', 0), ('plus', 5)) AS v(scenario, shift)),
n AS (SELECT store_id, period_month, scenario, {_notes('80 + shift', '65 + shift', '25 + shift')} AS notes FROM sh CROSS JOIN sc)
SELECT a.scenario, count(*) AS n_rows, count(*) FILTER (a.notes <> b.notes) AS n_changed FROM n a JOIN n b ON a.store_id = b.store_id AND a.period_month = b.period_month AND b.scenario = 'baseline' GROUP BY a.scenario""")
def dia5(spark, d):
    return guardrail_sensitivity(store_period(spark, d), sku_period(spark, d), tasks(spark, d))


def guardrail_sensitivity(panel, skus, parts=None):
    """Rows whose notes change when the limits move by five points either way: each
    row carries its notes under all scenarios, so no join is needed."""
    df = P.with_top(panel, skus, parts)
    df = df.withColumns({n: N.pct(x, y) for n, (x, y) in SHARES.items()})
    shifts = {"minus": -5, "baseline": 0, "plus": 5}
    wide = df.select(*(notes(80 + s, 65 + s, 25 + s).alias(n) for n, s in shifts.items()))
    long = wide.select("baseline", F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.col(n).alias("notes")) for n in shifts))).alias("s"))
    return long.groupBy("s.scenario").agg(F.count("*").alias("n_rows"), F.count_if(F.col("s.notes") != F.col("baseline")).alias("n_changed"))


SLOTS = [("amount", "transaction_amount"), ("conversion", "order_conversion_rate_pct"), ("activity", "activity_cost_ratio_pct")]
_SLOTS = " UNION ALL ".join(f"SELECT store_id, period_month, period_start, period_end, {i} AS slot_order, '{n}' AS slot, CAST({c} AS DOUBLE) AS value FROM sp" for i, (n, c) in enumerate(SLOTS, 1))


@query("dia6_interpretation", f"""WITH {SP}, u AS ({_SLOTS}),
g AS (SELECT store_id, period_month, count(*) AS n, count(DISTINCT slot) AS n_slots, count(DISTINCT (period_start, period_end)) AS n_windows, count(value) AS n_values FROM u GROUP BY store_id, period_month)
SELECT store_id, period_month, slot_order, slot, value, value IS NULL AS missing, n = {len(SLOTS)} AND n_slots = {len(SLOTS)} AND n_windows = 1 AS consistent_period, n_values = {len(SLOTS)} AS complete FROM u JOIN g USING (store_id, period_month)""")
def dia6(spark, d):
    return interpretation(store_period(spark, d), SLOTS)


def interpretation(panel, slots: list):
    """One row for each store, month and canonical slot, in the slots' order, with
    whether the month has every slot once and one window, and a value in each."""
    rows = F.array(*(F.struct(F.lit(i).alias("slot_order"), F.lit(n).alias("slot"), F.col(c).cast("double").alias("value")) for i, (n, c) in enumerate(slots, 1)))
    long = panel.select(*KEY, "period_month", F.inline(rows))
    w = Window.partitionBy("store_id", "period_month")
    once = F.count("*").over(w) == len(slots)
    every = F.size(F.collect_set("slot").over(w)) == len(slots)
    one = (F.min("period_start").over(w) == F.max("period_start").over(w)) & (F.min("period_end").over(w) == F.max("period_end").over(w))
    full = F.count("value").over(w) == len(slots)
    return long.select("store_id", "period_month", "slot_order", "slot", "value", F.col("value").isNull().alias("missing"), (once & every & one).alias("consistent_period"), full.alias("complete"))


@query("agg1_top3_sum", f"WITH {SP}, {SKU}, {TOP} SELECT * FROM top")
def agg1(spark, d):
    return P.top_sum(sku_period(spark, d))


@query("jn1_store_top3", f"WITH {SP}, {SKU}, {TOP} SELECT {K}, transaction_amount, top3_amount FROM sp LEFT JOIN top USING ({K})")
def jn1(spark, d):
    return P.with_top(store_period(spark, d), sku_period(spark, d), tasks(spark, d)).select(*KEY, "transaction_amount", "top3_amount")


@query("jn2_panel_months", f"WITH {SP}, o AS (SELECT store_id, string_agg(DISTINCT period_month, '|' ORDER BY period_month) AS observed FROM sp WHERE period_month < '1996-01' GROUP BY store_id) SELECT sp.store_id, period_month, observed FROM sp LEFT JOIN o USING (store_id)")
def jn2(spark, d):
    panel = store_period(spark, d)
    seen = panel.where("period_month < '1996-01'").groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_set("period_month")), "|").alias("observed"))
    return panel.select("store_id", "period_month").join(seen, "store_id", "left")


@query("agg2_guarded_average", f"WITH {SP} SELECT store_id, {_AVG} FROM sp GROUP BY store_id")
def agg2(spark, d):
    return store_period(spark, d).groupBy("store_id").agg(*(N.guarded_avg(m).alias(f"avg_{m}") for m in CHECKED))


@query("agg3_coverage", f"WITH {SP} SELECT store_id, count(DISTINCT period_month) AS n_months, min(period_month) AS first_month, max(period_month) AS last_month, count(DISTINCT period_month) >= 80 AS ready FROM sp GROUP BY store_id")
def agg3(spark, d):
    g = store_period(spark, d).groupBy("store_id").agg(F.countDistinct("period_month").alias("n_months"), F.min("period_month").alias("first_month"), F.max("period_month").alias("last_month"))
    return g.withColumn("ready", F.col("n_months") >= 80)


@query("agg4_ordered_months", f"WITH {SP} SELECT store_id, string_agg(DISTINCT period_month, '|' ORDER BY period_month) AS months FROM sp GROUP BY store_id")
def agg4(spark, d):
    return store_period(spark, d).groupBy("store_id").agg(F.array_join(F.array_sort(F.collect_set("period_month")), "|").alias("months"))


@query("agg5_month_pivot", f"WITH {SP} SELECT store_id, {_UNA('region_type')}, {_UNA('store_type')}, {_CELLS} FROM sp WHERE period_month IN ({_IN}) GROUP BY store_id")
def agg5(spark, d):
    return P.pivoted(store_period(spark, d), MONTHS, PIVOTED)


@query("agg6_unanimous", f"WITH {SP} SELECT region_type, {_UNA('store_type')}, count(*) AS n FROM sp GROUP BY region_type")
def agg6(spark, d):
    return store_period(spark, d).groupBy("region_type").agg(N.unanimous("store_type").alias("store_type"), F.count("*").alias("n"))


@query("agg7_endpoint_change", f"WITH {SP}, p AS (SELECT store_id, {_CELLS} FROM sp WHERE period_month IN ({_IN}) GROUP BY store_id) SELECT store_id, {_D} FROM p")
def agg7(spark, d):
    out = P.endpoints(P.pivoted(store_period(spark, d), MONTHS, PIVOTED), MONTHS, AMOUNTS, DELTA_RATES, COUNTED)
    return out.select("store_id", *(c for c in out.columns if c.endswith(("_delta", "_pct", "_pp")) and c not in PIVOTED))


@query("win1_previous_values", f"WITH {MOM_CTE} SELECT {K}, {', '.join(f'prev_{m}' for m in [*MOM, *RANKS])} FROM lagged")
def win1(spark, d):
    return P.previous(store_period(spark, d), [*MOM, *RANKS]).select(*KEY, *(f"prev_{m}" for m in [*MOM, *RANKS]))


@query("win2_latest_period", f"WITH {MOM_CTE} SELECT {K}, is_latest FROM lagged")
def win2(spark, d):
    return P.latest(store_period(spark, d)).select(*KEY, "is_latest")


@query("win3_period_change", f"WITH {MOM_CTE} SELECT {K}, {', '.join(f'{_mom(m)} AS {m}_mom_pct' for m in MOM)}, {', '.join(f'{m} - prev_{m} AS {m}_change' for m in RANKS)} FROM lagged")
def win3(spark, d):
    return dia1(spark, d).select(*KEY, *(f"{m}_mom_pct" for m in MOM), *(f"{m}_change" for m in RANKS))


@query("win4_tradeoff_flag", f"WITH {MOM_CTE} SELECT store_id, {K.replace('store_id, ', '')}, CASE WHEN {_ANY} THEN NULL ELSE {_ALL} END AS tradeoff FROM lagged WHERE is_latest")
def win4(spark, d):
    return dia1(spark, d).where("is_latest").select(*KEY, "tradeoff")


@query("srt1_store_order", f"WITH {SP} SELECT store_id, period_start, transaction_amount, row_number() OVER (ORDER BY store_id, period_start) AS place FROM sp")
def srt1(spark, d):
    panel = store_period(spark, d).select("store_id", "period_start", "transaction_amount")
    return P.placed(panel, ["store_id", "period_start"])


@query("fmth1_ratios", f"WITH {SP} SELECT {K}, {', '.join(f'{_pct(x, y)} AS {n}' for n, (x, y) in SHARES.items() if x != 'top3_amount')} FROM sp")
def fmth1(spark, d):
    return store_period(spark, d).select(*KEY, *(N.pct(x, y).alias(n) for n, (x, y) in SHARES.items() if x != "top3_amount"))


@query("fcnd1_scope_flag", f"WITH {SHARED_SQL} SELECT {FLAG_SQL} AS scope_flag, count(*) AS n FROM sh GROUP BY 1")
def fcnd1(spark, d):
    panel = P.with_top(store_period(spark, d), sku_period(spark, d), tasks(spark, d))
    return panel.groupBy(scope_flag(WINDOW).alias("scope_flag")).agg(F.count("*").alias("n"))


@query("fcnd2_activity_notes", f"WITH {SHARED_SQL} SELECT {_notes(80, 65, 25)} AS notes, count(*) AS n FROM sh GROUP BY 1")
def fcnd2(spark, d):
    return dia2(spark, d).groupBy("notes").agg(F.count("*").alias("n"))
