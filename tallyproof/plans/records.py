"""Source records by day, week and month; range queries, batches, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..adapters import SP, stores, store_period, table
from ..functions import numbers as N, text as T
from ..operators import intervals as I, ledger as L, panels as P
from ..registry import query
from ..sources import files
from .diagnostics import DIA1, MOM, MONTHS, RANKS, SHARES, dia1

FIRST, LAST = "2024-01-08", "2024-01-14"
REC = """dd AS (SELECT user_id AS u, user_id % 10 AS b, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS users, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DECIMAL(38, 4)) AS amount FROM events GROUP BY ALL),
daily AS (SELECT 'U' || u AS store_id, day AS period_start, day AS period_end, 'daily' AS batch, CASE WHEN b <> 7 THEN 'all' END AS scope, n, users, CASE WHEN b <> 6 OR day <> DATE '2024-01-10' THEN amount END AS amount FROM dd WHERE b NOT IN (4, 5) AND NOT (b = 2 AND day = DATE '2024-01-11')),
weekly AS (SELECT 'U' || u AS store_id, CAST(date_trunc('week', day) AS DATE) AS period_start, CAST(date_trunc('week', day) AS DATE) + 6 AS period_end, 'weekly' AS batch, 'all' AS scope, CAST(sum(n) AS BIGINT) AS n, max(users) AS users, CAST(sum(amount) AS DECIMAL(38, 4)) AS amount FROM dd WHERE b IN (3, 4) GROUP BY ALL),
monthly AS (SELECT 'U' || u AS store_id, CAST(date_trunc('month', day) AS DATE) AS period_start, last_day(date_trunc('month', day)) AS period_end, 'monthly' AS batch, 'all' AS scope, CAST(sum(n) AS BIGINT) AS n, max(users) AS users, CAST(sum(amount) AS DECIMAL(38, 4)) AS amount FROM dd WHERE b = 5 GROUP BY ALL),
rec AS (SELECT *, 'store_period' AS grain FROM daily UNION ALL SELECT *, 'store_period' FROM weekly UNION ALL SELECT *, 'store_period' FROM monthly)"""


def records(spark, d):
    """Published records of each event user, as a store: daily for most, weekly over
    daily for some, weekly or monthly only for others, with a missing day, a missing
    value and an unreviewed scope here and there."""
    user = (F.col("user_id").alias("u"), (F.col("user_id") % 10).alias("b"))
    ev = table(spark, d, "events").select(*user, F.to_date("ts").alias("day"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("v"))
    dd = ev.groupBy("u", "b", "day").agg(
        F.count("*").alias("n"), F.countDistinct("event_type").alias("users"), F.sum("v").cast("decimal(38,4)").alias("amount")
    )
    name = F.concat(F.lit("U"), F.col("u").cast("string")).alias("store_id")
    amount = F.when((F.col("b") != 6) | (F.col("day") != F.lit("2024-01-10").cast("date")), F.col("amount"))
    daily = dd.where("b not in (4, 5) and not (b = 2 and day = date'2024-01-11')").select(
        name, F.col("day").alias("period_start"), F.col("day").alias("period_end"), F.lit("daily").alias("batch"),
        F.when(F.col("b") != 7, "all").alias("scope"), "n", "users", amount.alias("amount"),
    )

    def rolled(where, start, end, batch):
        g = dd.where(where).groupBy("u", start.alias("period_start"))
        g = g.agg(F.sum("n").alias("n"), F.max("users").alias("users"), F.sum("amount").cast("decimal(38,4)").alias("amount"))
        return g.select(name, "period_start", end.alias("period_end"), F.lit(batch).alias("batch"), F.lit("all").alias("scope"), "n", "users", "amount")

    weekly = rolled("b in (3, 4)", F.date_trunc("week", "day").cast("date"), F.date_add("period_start", 6), "weekly")
    monthly = rolled("b = 5", F.trunc("day", "MM"), F.last_day("period_start"), "monthly")
    return daily.unionByName(weekly).unionByName(monthly).withColumn("grain", F.lit("store_period"))


def requests(spark, d, first=FIRST, last=LAST, longer=0):
    """A request for each user, and some for stores without records; longer: days more
    for every tenth user."""
    own = table(spark, d, "events").select("user_id").distinct()
    more = F.when(F.col("user_id") % 10 == 9, longer).otherwise(0)
    own = own.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("store_id"), more.alias("more"))
    none = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("store_id"), F.lit(0).alias("more"))
    out = own.unionByName(none).withColumns({"first": F.lit(first).cast("date"), "last": F.lit(last).cast("date")})
    return out.select("store_id", "first", F.date_add("last", F.col("more")).alias("last"))


def REQ(first, last, longer=0):
    more = f"CASE WHEN user_id % 10 = 9 THEN {longer} ELSE 0 END"
    return f"""req AS (SELECT DISTINCT 'U' || user_id AS store_id, DATE '{first}' AS first, DATE '{last}' + {more} AS last FROM events
UNION ALL SELECT 'N' || n_nationkey, DATE '{first}', DATE '{last}' FROM nation)"""


LADDER = """met AS (SELECT q.store_id, q.first, q.last, r.* EXCLUDE (store_id) FROM req q LEFT JOIN rec r ON r.store_id = q.store_id AND r.period_start <= q.last AND r.period_end >= q.first),
lng AS (SELECT store_id, first, last, period_start, period_end, batch, scope, grain, 'amount' AS field, amount AS v, true AS adds FROM met UNION ALL SELECT store_id, first, last, period_start, period_end, batch, scope, grain, 'n', CAST(n AS DECIMAL(38, 4)), true FROM met UNION ALL SELECT store_id, first, last, period_start, period_end, batch, scope, grain, 'users', CAST(users AS DECIMAL(38, 4)), false FROM met),
mk AS (SELECT *, period_start IS NOT NULL AS real, period_start IS NOT NULL AND period_start >= first AND period_end <= last AS ins, period_start <= max(period_end) OVER (PARTITION BY store_id, field ORDER BY period_start, period_end, batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clash, period_end - period_start + 1 AS nd FROM lng),
ag AS (SELECT store_id, first, last, field, adds, count(*) FILTER (ins) AS n_in, count(*) FILTER (real AND NOT ins) AS crossing, count(*) FILTER (clash) AS clashes, count(*) FILTER (grain <> 'store_period') AS ranked, count(DISTINCT CASE WHEN real THEN coalesce(scope, '-') END) AS scopes, count(*) FILTER (real AND scope IS NULL) AS unrev, count(*) FILTER (ins AND nd > 1) AS lg, count(*) FILTER (ins AND v IS NULL) AS emp, sum(v) FILTER (ins) AS total, max(CASE WHEN ins AND period_start = first AND period_end = last THEN 1 END) AS exact, count(DISTINCT CASE WHEN ins THEN period_start END) AS starts, sum(nd) FILTER (ins AND NOT coalesce(clash, false)) AS covered, last - first + 1 AS span FROM mk GROUP BY ALL),
rs AS (SELECT *, CASE WHEN ranked > 0 THEN 'ranked_records_only' WHEN (clashes > 0 OR crossing > 0 OR scopes > 1) AND adds AND unrev > 0 THEN 'aggregation_scope_unreviewed' WHEN clashes > 0 OR crossing > 0 OR scopes > 1 THEN 'ambiguous_source_scope_or_window' WHEN n_in = 0 THEN 'no_contained_source_records'
WHEN n_in = 1 AND exact = 1 THEN CASE WHEN emp = 0 THEN 'reported_value' ELSE 'missing_reported_value' END WHEN NOT adds THEN 'aggregation_not_registered' WHEN unrev > 0 THEN 'aggregation_scope_unreviewed' WHEN coalesce(covered, 0) < span THEN 'missing_dates' WHEN lg > 0 THEN 'aggregation_requires_daily_source_records' WHEN n_in <> span OR starts <> n_in THEN 'duplicate_daily_records' WHEN emp > 0 THEN 'missing_metric_values' ELSE 'complete_daily_source_values' END AS reason FROM ag),
rv AS (SELECT store_id, first, last, field, CASE WHEN reason IN ('reported_value', 'complete_daily_source_values') THEN CAST(total AS DOUBLE) END AS value, CASE WHEN reason IN ('reported_value', 'missing_reported_value') THEN 'reported_window' WHEN reason = 'complete_daily_source_values' THEN 'sum_non_overlapping_days' ELSE 'source_records' END AS basis, reason FROM rs)"""


ADDITIVE, PLAIN = ["amount", "n"], ["users"]
#: Fields with direction rules, and those whose totals may have different bases.
COMPARED, PRIMARY = ["amount", "n"], ["amount", "n"]
GROUPS = [("transaction_measures_align", ["amount", "n"]), ("background_align", ["amount", "users"])]
CAUSAL = ["background_align"]
BASELINE = ("2024-01-01", "2024-01-07")


def met(spark, d, first=FIRST, last=LAST):
    """Each request with the records that share days with it."""
    return I.overlapping(requests(spark, d, first, last), records(spark, d), ["store_id"], ("first", "last"), ("period_start", "period_end"))


def ranged(spark, d, first=FIRST, last=LAST, longer=0):
    return I.range_values(records(spark, d), requests(spark, d, first, last, longer), ADDITIVE, PLAIN)


@query("rng1_date_range_query", f"WITH {REC}, {REQ(FIRST, LAST)}, {LADDER} SELECT * FROM rv")
def rng1(spark, d):
    return ranged(spark, d).withColumn("value", F.col("value").cast("double"))


@query("agg12_range_reasons", f"WITH {REC}, {REQ(FIRST, LAST)}, {LADDER} SELECT field, reason, count(*) AS n FROM rv GROUP BY ALL")
def agg12(spark, d):
    return ranged(spark, d).groupBy("field", "reason").agg(F.count("*").alias("n"))


# A record's source and aggregation scope, from its store's number and its batch.
_SOURCE = {
    "source_system": "batch", "source_page": "CASE WHEN b = 8 AND period_start >= DATE '2024-01-10' THEN 'detail' ELSE 'overview' END",
    "scope_version": "CASE WHEN b = 1 AND period_start >= DATE '2024-01-08' THEN 'v2' ELSE 'v1' END", "timezone": "'UTC'", "selection_conditions": "'paid'",
}
_STORE = {"binding_id": "CASE WHEN b = 0 AND period_start >= DATE '2024-01-08' THEN 'b2' ELSE 'b1' END", "source_account_id": "CAST(b % 3 AS VARCHAR(9))", "source_store_id": "store_id"}
_SIGNATURE = f"concat_ws('|', {', '.join([*_SOURCE.values(), *_STORE.values()])})"
_B = "CAST(right(store_id, 1) AS INT) AS b"


def signed_records(spark, d):
    """Records with the signature of their source and scope; null: not reviewed."""
    r = records(spark, d).selectExpr("*", _B)
    return r.withColumn("signature", F.when(F.col("scope").isNotNull(), F.expr(_SIGNATURE)))


def scopes(spark, d):
    windows = [("baseline", requests(spark, d, *BASELINE)), ("current", requests(spark, d, FIRST, LAST, 3))]
    every = [w.withColumn("role", F.lit(r)) for r, w in windows]
    return I.scopes(signed_records(spark, d), every[0].unionByName(every[1]))


def reviewed(spark, d):
    """Two windows of each store compared, field by field."""
    values = [ranged(spark, d, *BASELINE).withColumn("role", F.lit("baseline")), ranged(spark, d, FIRST, LAST, 3).withColumn("role", F.lit("current"))]
    return I.compared(values[0].unionByName(values[1]), COMPARED, PRIMARY, scopes(spark, d))


_IN = lambda names: ", ".join(f"'{x}'" for x in names)
_SUP = lambda x: f"({x}.value IS NOT NULL AND {x}.basis IN ('reported_window', 'sum_non_overlapping_days'))"
_TWO = f"""WITH {REC}, r1 AS (SELECT * FROM (WITH {REQ(*BASELINE)}, {LADDER} SELECT * FROM rv)), r2 AS (SELECT * FROM (WITH {REQ(FIRST, LAST, 3)}, {LADDER} SELECT * FROM rv)),
sg AS (SELECT *, CASE WHEN scope IS NOT NULL THEN {_SIGNATURE} END AS signature FROM (SELECT *, {_B} FROM rec)),
s1 AS (SELECT q.store_id, CASE WHEN count(*) = count(signature) AND count(DISTINCT signature) = 1 THEN min(signature) END AS sig FROM (SELECT DISTINCT store_id, first, last FROM r1) q JOIN sg r ON r.store_id = q.store_id AND r.period_start >= q.first AND r.period_end <= q.last GROUP BY 1),
s2 AS (SELECT q.store_id, CASE WHEN count(*) = count(signature) AND count(DISTINCT signature) = 1 THEN min(signature) END AS sig FROM (SELECT DISTINCT store_id, first, last FROM r2) q JOIN sg r ON r.store_id = q.store_id AND r.period_start >= q.first AND r.period_end <= q.last GROUP BY 1),
ok AS (SELECT a.store_id, a.field, concat_ws('; ', CASE WHEN a.field NOT IN ({_IN(COMPARED)}) THEN 'source_values_only' END, CASE WHEN NOT {_SUP('a')} THEN 'baseline: ' || a.reason END, CASE WHEN NOT {_SUP('b')} THEN 'current: ' || b.reason END,
  CASE WHEN s1.sig IS NULL OR s2.sig IS NULL THEN 'comparison_scope_unreviewed' WHEN s1.sig <> s2.sig THEN 'different_comparison_scopes' END, CASE WHEN a.basis <> b.basis AND a.field NOT IN ({_IN(PRIMARY)}) THEN 'different_summary_bases' END) AS against,
  a.value AS v1, b.value AS v2, {_SUP('a')} AS sup1, {_SUP('b')} AS sup2, a.last - a.first AS len1, b.last - b.first AS len2 FROM r1 a JOIN r2 b ON a.store_id = b.store_id AND a.field = b.field LEFT JOIN s1 ON s1.store_id = a.store_id LEFT JOIN s2 ON s2.store_id = a.store_id),
cm AS (SELECT store_id, field, against, CASE WHEN against = '' THEN 'compared' ELSE 'unresolved' END AS status, CASE WHEN against = '' THEN v2 - v1 END AS difference, CASE WHEN against = '' THEN CAST(sign(v2 - v1) AS INT) END AS direction FROM ok)"""


@query("rng2_range_review", f"{_TWO} SELECT * FROM cm")
def rng2(spark, d):
    return reviewed(spark, d).drop("supported_baseline", "supported_current", "days_baseline", "days_current")


@query("rng3_scope_equality", f"""{_TWO} SELECT DISTINCT a.store_id, s1.sig AS baseline, s2.sig AS current, CASE WHEN s1.sig IS NULL OR s2.sig IS NULL THEN 'comparison_scope_unreviewed' WHEN s1.sig = s2.sig THEN 'same_scope' ELSE 'different_comparison_scopes' END AS verdict
FROM r1 a LEFT JOIN s1 ON s1.store_id = a.store_id LEFT JOIN s2 ON s2.store_id = a.store_id""")
def rng3(spark, d):
    side = lambda r: scopes(spark, d).where(F.col("role") == r).select("store_id", F.col("signature").alias(r))
    both = requests(spark, d).select("store_id").join(side("baseline"), "store_id", "left").join(side("current"), "store_id", "left")
    return both.withColumn("verdict", F.coalesce(I.scope_reason("baseline", "current"), F.lit("same_scope")))


@query("rng4_direction_hypotheses", f"{_TWO} SELECT store_id, field, h.hypothesis, CASE WHEN status = 'unresolved' THEN 'unresolved' WHEN direction = h.hypothesis THEN 'supported' ELSE 'rejected' END AS verdict FROM cm CROSS JOIN (VALUES (-1), (0), (1)) AS h(hypothesis) WHERE field IN ({_IN(COMPARED)})")
def rng4(spark, d):
    return I.directions(reviewed(spark, d), COMPARED)


_ALIGNED = " UNION ALL ".join(
    f"SELECT store_id, '{n}' AS hypothesis, CASE WHEN count(*) FILTER (status <> 'compared') > 0 THEN 'unresolved' WHEN count(DISTINCT direction) = 1 AND max(direction) <> 0 THEN 'supported' ELSE 'rejected' END AS verdict FROM cm WHERE field IN ({_IN(f)}) GROUP BY store_id HAVING count(*) = {len(f)}" for n, f in GROUPS
)


@query("rng5_alignment", f"{_TWO} {_ALIGNED}")
def rng5(spark, d):
    return I.alignments(reviewed(spark, d), GROUPS)


@query("rng6_findings", f"""{_TWO}, al AS ({_ALIGNED}),
hy AS (SELECT store_id, count(*) FILTER (status = 'compared') AS acc, count(*) FILTER (status = 'compared') * 2 AS rej, count(*) FILTER (status <> 'compared') * 3 AS unr FROM cm WHERE field IN ({_IN(COMPARED)}) GROUP BY store_id),
ha AS (SELECT store_id, count(*) FILTER (verdict = 'supported') AS acc, count(*) FILTER (verdict = 'rejected') AS rej, count(*) FILTER (verdict = 'unresolved') AS unr, bool_or(hypothesis IN ({_IN(CAUSAL)})) AS causal FROM al GROUP BY store_id),
ck AS (SELECT store_id, count(*) FILTER (sup1) + count(*) FILTER (sup2) + count(*) FILTER (field IN ({_IN(COMPARED)}) AND against = '') AS good, 2 * count(*) + count(*) FILTER (field IN ({_IN(COMPARED)})) AS n, max(CASE WHEN len1 <> len2 THEN 1 ELSE 0 END) AS uneven FROM ok GROUP BY store_id)
SELECT store_id, CASE WHEN good = n THEN 'active' ELSE 'tentative' END AS belief, CASE WHEN good = n THEN 'supported' WHEN good > 0 THEN 'partially_supported' ELSE 'missing' END AS evidence,
concat_ws(',', CASE WHEN good < n THEN 'unresolved_evidence:' || (n - good) END, CASE WHEN uneven = 1 THEN 'different_window_lengths' END, CASE WHEN causal THEN 'causal_effects_unresolved' END) AS findings,
hy.acc + ha.acc + 1 AS n_accepted, hy.rej + ha.rej + 1 AS n_rejected, hy.unr + ha.unr AS n_unresolved FROM ck JOIN hy USING (store_id) JOIN ha USING (store_id)""")
def rng6(spark, d):
    return I.findings(reviewed(spark, d), COMPARED, GROUPS, CAUSAL)


@query("rng7_reverified", f"""{_TWO} SELECT store_id, field, CASE WHEN store_id LIKE '%4' AND field = 'n' THEN 'missing' ELSE 'changed' END AS outcome FROM cm
WHERE (store_id LIKE '%4' AND field = 'n') OR (store_id LIKE '%1' AND difference IS NOT NULL) OR (store_id LIKE '%7' AND field = 'users')""")
def rng7(spark, d):
    """A stored review against the one computed again from the records. Some of its
    rows were altered on purpose: a difference, reasons, a row that is gone."""
    keys, rows = ["store_id", "field"], rng2(spark, d)
    ends = lambda x: F.col("store_id").endswith(x)
    stored = rows.where(~(ends("4") & (F.col("field") == "n"))).withColumns({
        "difference": F.when(ends("1"), F.col("difference") + 1).otherwise(F.col("difference")),
        "against": F.when(ends("7") & (F.col("field") == "users"), "reworded").otherwise(F.col("against")),
    })
    path = files.fresh_path(spark, "review")
    stored.write.parquet(path)
    return L.reverified(spark.read.parquet(path), rows, keys)


@query("agg8_exact_sum", "SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(38, 10))) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def agg8(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(38,10)")).cast("double").alias("total"))


_COV = f"""WITH {REC}, {REQ('2024-01-01', '2024-01-31')}, days AS (SELECT store_id, CAST(unnest(range(first, last + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day, first, last FROM req),
hit AS (SELECT d.store_id, d.day, bool_or(r.store_id IS NOT NULL) AS covered FROM days d LEFT JOIN rec r ON r.store_id = d.store_id AND d.day BETWEEN r.period_start AND r.period_end GROUP BY 1, 2),
gap AS (SELECT store_id, min(day) AS a, max(day) AS b FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY store_id ORDER BY day) AS INT) AS isl FROM hit WHERE NOT covered) GROUP BY store_id, isl)"""


@query("agg9_interval_coverage", f"{_COV} SELECT h.store_id, CAST(31 AS INT) AS requested_days, count(*) FILTER (covered) AS covered_days, coalesce((SELECT string_agg(CAST(a AS VARCHAR) || '..' || CAST(b AS VARCHAR), ',' ORDER BY a) FROM gap g WHERE g.store_id = h.store_id), '') AS missing FROM hit h GROUP BY h.store_id HAVING count(*) FILTER (covered) > 0")
def agg9(spark, d):
    return I.coverage(met(spark, d, "2024-01-01", "2024-01-31"), ["store_id"])


@query("agg10_distinct_windows", f"WITH {REC} SELECT store_id, count(DISTINCT (period_start, period_end, batch)) AS n FROM rec GROUP BY store_id")
def agg10(spark, d):
    return records(spark, d).dropDuplicates(["store_id", "period_start", "period_end", "batch"]).groupBy("store_id").agg(F.count("*").alias("n"))


@query("agg11_source_scopes", f"WITH {REC} SELECT store_id, count(DISTINCT coalesce(scope, '-')) AS n_scopes, count(DISTINCT batch) > 1 AS several_batches FROM rec GROUP BY store_id")
def agg11(spark, d):
    return records(spark, d).groupBy("store_id").agg(F.countDistinct(F.coalesce("scope", F.lit("-"))).alias("n_scopes"), (F.countDistinct("batch") > 1).alias("several_batches"))


@query("agg13_contained_crossing", f"WITH {REC} SELECT store_id, CASE WHEN period_start >= DATE '{FIRST}' AND period_end <= DATE '{LAST}' THEN 'contained' ELSE 'crossing' END AS kind, count(*) AS n FROM rec WHERE period_start <= DATE '{LAST}' AND period_end >= DATE '{FIRST}' GROUP BY ALL")
def agg13(spark, d):
    r = records(spark, d).where(f"period_start <= date'{LAST}' and period_end >= date'{FIRST}'")
    return r.groupBy("store_id", F.expr(f"case when period_start >= date'{FIRST}' and period_end <= date'{LAST}' then 'contained' else 'crossing' end").alias("kind")).agg(F.count("*").alias("n"))


@query("agg14_ordered_lists", "WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM r GROUP BY 1")
def agg14(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return g.select("l_orderkey", F.array_join(F.transform("l", lambda x: x.l_partkey.cast("string")), ",").alias("parts"))


@query("jn3_upload_resolution", "SELECT o_orderkey, c_mktsegment, n_name, c_custkey IS NULL AS quarantined FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def jn3(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    o = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return o.select("o_orderkey", "c_mktsegment", "n_name", F.col("c_custkey").isNull().alias("quarantined"))


@query("jn4_overlap_selection", f"WITH {REC} SELECT store_id, period_start, period_end, batch FROM rec WHERE period_start <= DATE '{LAST}' AND period_end >= DATE '{FIRST}'")
def jn4(spark, d):
    return met(spark, d).select("store_id", "period_start", "period_end", "batch")


@query("jn5_window_overlaps", f"""WITH {REC} SELECT a.store_id, a.batch AS "left", b.batch AS "right", greatest(a.period_start, b.period_start) AS start, least(a.period_end, b.period_end) AS "end" FROM rec a JOIN rec b ON a.store_id = b.store_id AND (a.period_start, a.batch) < (b.period_start, b.batch) AND b.period_start <= a.period_end""")
def jn5(spark, d):
    return I.overlaps(records(spark, d), "store_id", "batch")


@query("jn6_store_pairs", f"WITH {SP} SELECT a.period_month, a.store_id AS l, b.store_id AS r, round(a.transaction_amount - b.transaction_amount, 4) AS diff FROM sp a JOIN sp b ON a.region_type = b.region_type AND a.period_month = b.period_month AND a.store_id < b.store_id WHERE a.period_month IN ({', '.join(repr(m) for m in MONTHS)})")
def jn6(spark, d):
    """Unordered pairs of stores in each requested window and region. What is written
    grows with the square of the stores, as the SQL wants every pair."""
    p = store_period(spark, d).where(F.col("period_month").isin(MONTHS)).select("period_month", "region_type", "store_id", "transaction_amount")
    both = P.pairs(p, ["period_month", "region_type"], "store_id")
    return both.select("period_month", F.col("a.store_id").alias("l"), F.col("b.store_id").alias("r"), N.rounded(F.col("a.transaction_amount") - F.col("b.transaction_amount"), 4).alias("diff"))


@query("jn7_temporal_pairs", f"WITH {SP} SELECT a.store_id, a.transaction_orders AS baseline, b.transaction_orders AS current FROM sp a JOIN sp b ON a.store_id = b.store_id AND a.period_month = '1996-01' AND b.period_month = '1996-02' AND a.period_end < b.period_start")
def jn7(spark, d):
    p = store_period(spark, d)
    side = lambda m, n: p.where(F.col("period_month") == m).select("store_id", F.col("transaction_orders").alias(n), F.col("period_start").alias(f"{n}_s"), F.col("period_end").alias(f"{n}_e"))
    return side("1996-01", "baseline").join(side("1996-02", "current"), "store_id").where("baseline_e < current_s").select("store_id", "baseline", "current")


@query("jn8_missing_evidence", "WITH g AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t) SELECT g.* FROM g LEFT JOIN (SELECT DISTINCT user_id, event_type FROM events) e USING (user_id, event_type) WHERE e.user_id IS NULL")
def jn8(spark, d):
    """Entity and slot pairs without evidence: each entity's slots against the list of
    all slots, which is one row."""
    ev = table(spark, d, "events")
    every = ev.agg(F.collect_set("event_type").alias("every"))
    own = ev.groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    return own.join(every).select("user_id", F.explode(F.array_except("every", "own")).alias("event_type"))


@query("jn9_predecessors", "SELECT o_custkey, count(*) FILTER (EXISTS (SELECT 1 FROM orders p WHERE p.o_orderkey = o.o_orderkey - 1 AND p.o_custkey IS NOT NULL)) AS with_predecessor, count(*) AS n FROM orders o GROUP BY 1")
def jn9(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    has = o.join(o.where("o_custkey is not null").select((F.col("o_orderkey") + 1).alias("o_orderkey")), "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("w"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).join(has, "o_custkey", "left").select("o_custkey", F.coalesce("w", F.lit(0)).alias("with_predecessor"), "n")


_GRID = f"WITH {SP}, g AS (SELECT s.store_id, m.period_month FROM st s CROSS JOIN (SELECT DISTINCT period_month FROM sp) m)"


@query("jn10_expected_grid", f"{_GRID} SELECT g.store_id, g.period_month, 'missing' AS side FROM g ANTI JOIN sp USING (store_id, period_month) UNION ALL SELECT sp.store_id, sp.period_month, 'unexpected' FROM sp ANTI JOIN g USING (store_id, period_month)")
def jn10(spark, d):
    """Stores by months that should be there against those that are; the months are one
    row."""
    p, keys = store_period(spark, d).select("store_id", "period_month"), ["store_id", "period_month"]
    grid = stores(spark, d).select("store_id").join(p.agg(F.collect_set("period_month").alias("months"))).select("store_id", F.explode("months").alias("period_month"))
    both = grid.withColumn("wanted", F.lit(True)).join(p.withColumn("found", F.lit(True)), keys, "full_outer")
    side = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected")
    return both.select(*keys, side.alias("side")).where("side is not null")


@query("jn12_shared_keys", "WITH k AS (SELECT 'part' AS ds, l_partkey AS k FROM lineitem GROUP BY 2 UNION ALL SELECT 'supp', l_suppkey FROM lineitem GROUP BY 2 UNION ALL SELECT 'cust', o_custkey FROM orders GROUP BY 2) SELECT a.ds AS l, b.ds AS r, count(*) AS n FROM k a JOIN k b ON a.k = b.k AND a.ds < b.ds GROUP BY ALL")
def jn12(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    k = li.select(F.lit("part").alias("ds"), F.col("l_partkey").alias("k")).union(li.select(F.lit("supp"), "l_suppkey")).union(o.select(F.lit("cust"), "o_custkey")).distinct()
    a, b = k.alias("a"), k.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.ds") < F.col("b.ds"))).groupBy(F.col("a.ds").alias("l"), F.col("b.ds").alias("r")).agg(F.count("*").alias("n"))


@query("set1_view_union", "SELECT kind, count(*) AS n FROM (SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) GROUP BY kind")
def set1(spark, d):
    """A view of several datasets; their schemas must agree."""
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    if a.schema.simpleString() != b.schema.simpleString():
        raise ValueError("datasets of one view must have one schema")
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("set2_key_intersection", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT o_custkey FROM orders")
def set2(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("set3_differences", "SELECT 'left' AS side, count(*) AS n FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem) UNION ALL SELECT 'right', count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT SELECT p_partkey FROM part)")
def set3(spark, d):
    a, b = table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    count = lambda x, n: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return count(a.subtract(b), "left").union(count(b.subtract(a), "right"))


@query("set4_multiset_check", "SELECT 'left' AS side, count(*) AS n FROM (SELECT l_suppkey, l_returnflag FROM lineitem EXCEPT ALL SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber <> 1) GROUP BY 1")
def set4(spark, d):
    li = table(spark, d, "lineitem")
    diff = L.multiset_difference(li.select("l_suppkey", "l_returnflag"), li.where("l_linenumber <> 1").select("l_suppkey", "l_returnflag"))
    return diff.groupBy("side").agg(F.count("*").alias("n"))


@query("set5_ordered_distinct", "WITH e AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS kinds FROM e GROUP BY 1")
def set5(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("l"))
    return g.select("user_id", F.array_join(F.transform("l", lambda x: x.event_type), ",").alias("kinds"))


@query("set6_selection_uniqueness", f"WITH {REC} SELECT store_id, period_start, count(*) AS n FROM rec GROUP BY ALL HAVING count(*) > 1")
def set6(spark, d):
    return records(spark, d).groupBy("store_id", "period_start").agg(F.count("*").alias("n")).where("n > 1")


BATCH = """bt AS (SELECT o_custkey % 50 AS scope, o_orderkey AS batch_id, o_custkey AS upload_id, o_orderstatus AS bytes, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate, o_orderkey) END AS supersedes, o_orderdate AS extracted_at, o_orderpriority <> '5-LOW' AS valid FROM orders),
b1 AS (SELECT *, row_number() OVER (PARTITION BY scope, upload_id, bytes ORDER BY extracted_at, batch_id) AS nth, first_value(bytes) OVER (PARTITION BY upload_id ORDER BY extracted_at, batch_id) <> bytes AS other FROM bt),
b2 AS (SELECT *, lag(batch_id) OVER w AS bef, lag(extracted_at) OVER w AS bef_at FROM b1 WINDOW w AS (PARTITION BY scope, nth = 1 AND valid AND NOT other ORDER BY extracted_at, batch_id)),
jd AS (SELECT *, CASE WHEN nth > 1 THEN 'repeat' WHEN other THEN 'held: other bytes' WHEN NOT valid THEN 'held: invalid rows' WHEN bef IS NOT NULL AND supersedes IS NULL THEN 'held: no predecessor given' WHEN supersedes IS DISTINCT FROM bef THEN 'held: wrong predecessor' WHEN bef_at > extracted_at THEN 'held: backwards in time' ELSE 'validated' END AS verdict FROM b2)"""


def batches(spark, d):
    w = Window.partitionBy(F.col("o_custkey") % 50).orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("scope"), F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("upload_id"), F.col("o_orderstatus").alias("bytes"), F.when(F.col("o_orderkey") % 3 != 0, F.lag("o_orderkey").over(w)).alias("supersedes"), F.col("o_orderdate").alias("extracted_at"), (F.col("o_orderpriority") != "5-LOW").alias("valid"))


@query("ing1_batch_intake", f"WITH {BATCH} SELECT batch_id, verdict FROM jd")
def ing1(spark, d):
    return L.judged(batches(spark, d), ["scope"]).select("batch_id", "verdict")


@query("ing2_retry_key", "SELECT count(*) AS n_batches, count(DISTINCT (o_custkey, o_orderstatus)) AS n_distinct FROM orders")
def ing2(spark, d):
    b = batches(spark, d).withColumn("retry_key", T.digest("upload_id", "bytes"))
    return b.agg(F.count("*").alias("n_batches"), F.countDistinct("retry_key").alias("n_distinct"))


@query("ing3_payload_conflict", "SELECT o_custkey AS upload_id, count(DISTINCT o_orderstatus) AS n_payloads FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def ing3(spark, d):
    return batches(spark, d).groupBy("upload_id").agg(F.countDistinct("bytes").alias("n_payloads")).where("n_payloads > 1")


@query("ing4_revision_acceptance", f"WITH {BATCH} SELECT scope, verdict, count(*) AS n FROM jd GROUP BY ALL")
def ing4(spark, d):
    return L.judged(batches(spark, d), ["scope"]).groupBy("scope", "verdict").agg(F.count("*").alias("n"))


@query("win8_revision_chain", f"WITH {BATCH}, v AS (SELECT scope, batch_id, lag(batch_id) OVER (PARTITION BY scope ORDER BY extracted_at, batch_id) AS before FROM jd WHERE verdict = 'validated') SELECT * FROM v")
def win8(spark, d):
    v = L.judged(batches(spark, d), ["scope"]).where("verdict = 'validated'")
    return v.select("scope", "batch_id", F.lag("batch_id").over(Window.partitionBy("scope").orderBy("extracted_at", "batch_id")).alias("before"))


@query("ing5_document_atomicity", "SELECT l_orderkey, bool_and(l_quantity <= 45 AND s_suppkey IS NOT NULL) AS accepted FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def ing5(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return li.groupBy("l_orderkey").agg(F.bool_and((F.col("l_quantity") <= 45) & F.col("s_suppkey").isNotNull()).alias("accepted"))


@query("ing7_text_locators", """WITH l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, line_no, t AS literal, string_split(line, t) AS ps FROM l, (VALUES ('and'), ('es ')) AS v(t)),
o AS (SELECT doc_id, line_no, literal, unnest(range(1, len(ps))) AS ordinal, list_transform(ps, lambda x: length(x)) AS ns FROM p)
SELECT doc_id, literal, CAST(line_no AS INT) AS line_no, CAST(ordinal AS INT) AS ordinal, CAST(list_sum(ns[1:ordinal]) + (ordinal - 1) * length(literal) + 1 AS INT) AS column_start, CAST(list_sum(ns[1:ordinal]) + ordinal * length(literal) AS INT) AS column_end FROM o""")
def ing7(spark, d):
    """Every place of two literals, of which a line may hold many."""
    asked = table(spark, d, "documents").withColumn("literal", F.explode(F.array(F.lit("and"), F.lit("es "))))
    return T.occurrences(asked, "doc_id", "text", "literal")


@query("ing8_snapshot", f"""WITH h AS (SELECT o_orderstatus, o_custkey, o_orderdate, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderpriority)) AS h FROM orders WHERE o_orderpriority <> '5-LOW'),
i AS (SELECT o_orderstatus, {L.digest_sql('h')} AS snapshot_id, count(*) AS n FROM h GROUP BY 1), u AS (SELECT o_orderstatus, count(*) AS k FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_orderdate FROM h) GROUP BY 1)
SELECT o_orderstatus, snapshot_id, n, n - k AS n_repeated FROM i JOIN u USING (o_orderstatus)""")
def ing8(spark, d):
    """Content-addressed snapshots of the batches selected: published under the id that
    follows from their rows, read back, and checked for repeated keys."""
    o = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'")
    h = o.select("o_orderstatus", "o_custkey", "o_orderdate", T.digest("o_orderkey", "o_orderpriority").alias("h"))
    return L.published(h, files.fresh_path(spark, "published"), "o_orderstatus", "h", ["o_custkey", "o_orderdate"])


@query("ing9_replay", f"WITH {BATCH} SELECT batch_id, CASE WHEN batch_id % 89 = 5 THEN 'missing' ELSE 'changed' END AS outcome FROM jd WHERE batch_id % 89 = 5 OR batch_id % 97 = 3")
def ing9(spark, d):
    """Intake run again on the archived rows, against the verdicts stored at the time;
    in these some rows were altered and some are gone."""
    verdicts = L.judged(batches(spark, d), ["scope"]).select("batch_id", "verdict")
    altered = F.when(F.col("batch_id") % 97 == 3, F.concat(F.lit("was "), "verdict")).otherwise(F.col("verdict"))
    path = files.fresh_path(spark, "verdicts")
    verdicts.where("batch_id % 89 <> 5").withColumn("verdict", altered).write.parquet(path)
    return L.reverified(spark.read.parquet(path), verdicts, ["batch_id"])


@query("ing10_row_accounting", """WITH x AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
l AS (SELECT l_orderkey, l_linenumber AS k FROM lineitem WHERE NOT (l_orderkey % 7 = 3 AND l_linenumber IN (2, 3)) UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 11 = 4 AND l_linenumber <> 2 UNION ALL SELECT l_orderkey, l_linenumber + 20 FROM lineitem WHERE l_orderkey % 13 = 5),
c AS (SELECT l_orderkey, k, count(*) AS m FROM l GROUP BY ALL),
a AS (SELECT x.l_orderkey, i.k, coalesce(m, 0) AS m FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM x) i JOIN x USING (l_orderkey) LEFT JOIN c ON c.l_orderkey = i.l_orderkey AND c.k = i.k),
f AS (SELECT l_orderkey, k, 'missing' AS what FROM a WHERE m = 0 UNION ALL SELECT l_orderkey, k, 'repeated' FROM a WHERE m > 1 UNION ALL SELECT c.l_orderkey, k, 'unexpected' FROM c JOIN x USING (l_orderkey) WHERE k < 1 OR k > n),
r AS (SELECT l_orderkey, what, min(k) AS a, max(k) AS b FROM (SELECT *, k - row_number() OVER (PARTITION BY l_orderkey, what ORDER BY k) AS run FROM f) GROUP BY l_orderkey, what, run),
s AS (SELECT l_orderkey, coalesce(string_agg(a || '..' || b, ',' ORDER BY a) FILTER (what = 'missing'), '') AS missing, coalesce(string_agg(a || '..' || b, ',' ORDER BY a) FILTER (what = 'repeated'), '') AS repeated, coalesce(string_agg(a || '..' || b, ',' ORDER BY a) FILTER (what = 'unexpected'), '') AS unexpected FROM r GROUP BY 1)
SELECT x.l_orderkey, CAST(x.n AS INT) AS n_expected, CAST(coalesce((SELECT sum(m) FROM c WHERE c.l_orderkey = x.l_orderkey), 0) AS BIGINT) AS n_found, coalesce(missing, '') AS missing, coalesce(repeated, '') AS repeated, coalesce(unexpected, '') AS unexpected, s.l_orderkey IS NULL AS complete FROM x LEFT JOIN s USING (l_orderkey)""")
def ing10(spark, d):
    """The lines of each order against the numbers that it should have; some are gone,
    twice there or beyond the last on purpose."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    expected = li.groupBy("l_orderkey").agg(F.max("l_linenumber").cast("int").alias("n"))
    more = li.where("l_orderkey % 13 = 5").withColumn("l_linenumber", F.col("l_linenumber") + 20)
    lines = li.where("not (l_orderkey % 7 = 3 and l_linenumber in (2, 3))").unionByName(li.where("l_orderkey % 11 = 4 and l_linenumber <> 2")).unionByName(more)
    return L.accounted(lines, expected, "l_orderkey", "l_linenumber", "n")


_PLAN_SQL = """WITH p AS (SELECT c_nationkey AS plan, c_custkey AS dataset, c_mktsegment AS format, c_nationkey * 40 + 1 AS binding FROM customer WHERE c_custkey % 3 <> 0),
f AS (SELECT plan, count(DISTINCT format) = 1 AS one_format FROM p GROUP BY plan)
SELECT plan, dataset, concat_ws('; ', CASE WHEN dataset IN (SELECT o_custkey FROM orders) THEN 'already_registered' END, CASE WHEN NOT one_format THEN 'several_formats' END, CASE WHEN binding NOT IN (SELECT s_suppkey FROM supplier) THEN 'unknown_binding' END) AS refusals FROM p JOIN f USING (plan)"""


@query("ing11_registration_plan", _PLAN_SQL)
def ing11(spark, d):
    """Plans by nation: customers as new datasets, orders as those registered."""
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0")
    plans = c.select(F.col("c_nationkey").alias("plan"), F.col("c_custkey").alias("dataset"), F.col("c_mktsegment").alias("format"), (F.col("c_nationkey") * 40 + 1).alias("binding"))
    return L.plan_refusals(plans, table(spark, d, "orders").select(F.col("o_custkey").alias("dataset")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("binding")))


@query("ing12_published_reverified", f"""WITH {SP} SELECT store_id, period_month, CASE WHEN transaction_orders % 7 = 3 THEN 'missing' ELSE 'changed' END AS outcome FROM sp
WHERE transaction_orders % 7 = 3 OR (exposure_users % 11 = 0 AND entry_users IS NOT NULL)""")
def ing12(spark, d):
    """Published outputs derived again from their source, against the stored snapshot,
    in which some values were altered and some rows are gone."""
    rows = store_period(spark, d).select("store_id", "period_month", "transaction_orders", "exposure_users", "entry_users", "entry_conversion_rate_pct")
    altered = F.when(F.col("exposure_users") % 11 == 0, F.col("entry_users") + 1).otherwise(F.col("entry_users"))
    path = files.fresh_path(spark, "outputs")
    rows.where("transaction_orders % 7 <> 3").withColumn("entry_users", altered).write.parquet(path)
    return L.reverified(spark.read.parquet(path), rows, ["store_id", "period_month"])


#: Fields derived a second time from the source, and how far they may be apart.
LINEAGE = {
    "transaction_orders": ("count(DISTINCT l_orderkey)", 0.0001), "exposure_users": ("sum(l_quantity) * 10", 0.0001), "exposure_times": ("sum(l_quantity) * 13", 0.0001),
    "entry_times": ("sum(l_quantity) * 5", 0.0001), "entry_users": ("sum(l_quantity) * 4", 0.0001), "transaction_amount": ("sum(l_extendedprice * (1 - l_discount))", 0.011),
    "refund_orders": ("count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END)", 0.0001),
}
_LIMIT = "CASE field " + " ".join(f"WHEN '{f}' THEN {t}" for f, (_, t) in LINEAGE.items()) + " END"
_LONG = lambda t, v: " UNION ALL ".join(f"SELECT store_id, period_month, '{f}' AS field, CAST({f} AS DOUBLE) AS {v}, true AS in_{v} FROM {t}" for f in LINEAGE)
_LIN = f"""WITH {SP}, o AS (SELECT 'S' || l_suppkey AS store_id, strftime(l_shipdate, '%Y-%m') AS period_month, {', '.join(f'{e} AS {f}' for f, (e, _) in LINEAGE.items())} FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
j AS (SELECT store_id, period_month, field, coalesce(in_l, false) AS in_left, coalesce(in_r, false) AS in_right, l IS NULL AS no_l, r IS NULL AS no_r, CASE WHEN l IS NULL AND r IS NULL THEN true WHEN l IS NULL OR r IS NULL THEN false ELSE abs(l - r) <= {_LIMIT} END AS agrees FROM ({_LONG('sp', 'l')}) FULL JOIN ({_LONG('o', 'r')}) USING (store_id, period_month, field))"""


def _source_again(spark, d):
    """The same fields from the source rows, some of which are left out on purpose."""
    li = table(spark, d, "lineitem").where("l_linenumber <> 7")
    store = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("store_id")
    return li.groupBy(store, F.date_format("l_shipdate", "yyyy-MM").alias("period_month")).agg(*(F.expr(e).alias(f) for f, (e, _) in LINEAGE.items()))


def _lineage(spark, d):
    limits = {f: t for f, (_, t) in LINEAGE.items()}
    return L.reconciled(store_period(spark, d), _source_again(spark, d), ["store_id", "period_month"], list(LINEAGE), limits)


@query("lin1_value_lineage", f"{_LIN} SELECT * EXCLUDE (no_l, no_r) FROM j")
def lin1(spark, d):
    return _lineage(spark, d)


RATIOS = {**SHARES, "average_order_value": None, "entry_conversion_rate_pct": ("entry_users", "exposure_users"), "order_conversion_rate_pct": ("order_users", "entry_users"), "payment_conversion_rate_pct": ("payment_users", "order_users"), "activity_cost_ratio_pct": ("activity_cost", "activity_original_transaction_amount")}
_FORMULAS = {
    **{n: f"{x} * 100.0e0 / nullif({y}, 0)" if (xy := RATIOS[n]) and ((x := xy[0]), (y := xy[1])) else "transaction_amount / nullif(transaction_orders, 0)" for n in RATIOS},
    **{f"{m}_change": f"{m} - prev_{m}" for m in RANKS}, **{f"{m}_mom_pct": f"({m} - prev_{m}) * 100.0e0 / nullif(prev_{m}, 0)" for m in MOM},
}
_ALTERED = "search_entry_share_pct"
_OFF = lambda n: f"{n} + CASE WHEN '{n}' = '{_ALTERED}' AND store_id LIKE '%3' THEN 0.5 ELSE 0 END"


@query("lin3_formula_check", f"""WITH dia AS ({DIA1}), u AS ({" UNION ALL ".join(f"SELECT '{n}' AS field, CAST({_OFF(n)} AS DOUBLE) AS was, CAST({e} AS DOUBLE) AS now FROM dia" for n, e in _FORMULAS.items())})
SELECT field, count(*) FILTER (was IS NOT NULL AND now IS NOT NULL AND abs(was - now) <= 0.011) AS n_agree, count(*) FILTER (was IS NULL AND now IS NULL) AS n_both_missing, count(*) FILTER ((was IS NULL) <> (now IS NULL) OR abs(was - now) > 0.011) AS n_differ FROM u GROUP BY field""")
def lin3(spark, d):
    """Fourteen ratios and ten changes of the month-over-month result computed again
    from its own inputs; one field of some stores was altered on purpose."""
    off = F.when(F.col("store_id").endswith("3"), F.col(_ALTERED) + 0.5).otherwise(F.col(_ALTERED))
    return L.formulas_checked(dia1(spark, d).withColumn(_ALTERED, off), _FORMULAS, 0.011)


@query("lin4_source_parity", f"{_LIN} SELECT field, count(*) FILTER (agrees) AS n_agree, count(*) FILTER (NOT agrees AND NOT no_l AND NOT no_r) AS n_differ, count(*) FILTER (in_left AND no_l AND NOT no_r) AS n_missing_left, count(*) FILTER (in_right AND no_r AND NOT no_l) AS n_missing_right, count(*) FILTER (NOT in_left) AS n_left_absent, count(*) FILTER (NOT in_right) AS n_right_absent FROM j GROUP BY field")
def lin4(spark, d):
    """Source against panel by field, where a value that is missing on one side alone
    counts as such."""
    limits = {f: t for f, (_, t) in LINEAGE.items()}
    return L.parity(store_period(spark, d), _source_again(spark, d), ["store_id", "period_month"], list(LINEAGE), limits)


_WIDE = ["transaction_amount", "entry_users", "activity_orders"]


@query("lin5_pivot_parity", f"""WITH {SP}, u AS ({" UNION ALL ".join(f"SELECT store_id, period_month, '{c}' AS field, {c} IS NOT NULL AS has FROM sp WHERE period_month IN ({', '.join(repr(m) for m in MONTHS)})" for c in _WIDE)}),
e AS (SELECT *, store_id LIKE '%0' AND field = 'activity_orders' AND period_month = '{MONTHS[1]}' AS altered FROM u)
SELECT field, count(*) FILTER (NOT altered) AS n_agree, count(*) FILTER (altered) AS n_differ FROM e GROUP BY field""")
def lin5(spark, d):
    """A pivot turned back into rows against the panel that it came from; one of its
    cells was altered in some stores on purpose."""
    panel = store_period(spark, d).where(F.col("period_month").isin(MONTHS)).select("store_id", "period_month", "region_type", "store_type", *_WIDE)
    wide = P.pivoted(panel, MONTHS, _WIDE)
    cell = f"activity_orders_{MONTHS[1].replace('-', '_')}"
    wide = wide.withColumn(cell, F.when(F.col("store_id").endswith("0"), F.coalesce(cell, F.lit(0)) + 1).otherwise(F.col(cell)))
    back = P.unpivoted(wide, MONTHS, _WIDE)
    both = L.reconciled(panel, back, ["store_id", "period_month"], _WIDE, 0.0001).where("in_left")
    return both.groupBy("field").agg(F.count_if("agrees").alias("n_agree"), F.count_if(~F.col("agrees")).alias("n_differ"))


@query("lin6_row_lineage", "SELECT o_orderkey, concat_ws(':', CAST(o_custkey AS VARCHAR), CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR)) AS lineage FROM orders")
def lin6(spark, d):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(":", F.col("o_custkey").cast("string"), n.cast("string")).alias("lineage"))


@query("agg22_view_overview", f"WITH {REC} SELECT grain AS view, count(*) AS n_rows, count(DISTINCT batch) AS n_batches, count(DISTINCT store_id) AS n_stores, min(period_start) AS first_day, max(period_end) AS last_day FROM rec GROUP BY grain")
def agg22(spark, d):
    """One row of counts for each view, however many stores it has."""
    return records(spark, d).groupBy(F.col("grain").alias("view")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("batch").alias("n_batches"), F.countDistinct("store_id").alias("n_stores"),
        F.min("period_start").alias("first_day"), F.max("period_end").alias("last_day"),
    )


@query("srt2_record_order", f"WITH {REC} SELECT store_id, period_start, period_end, batch, row_number() OVER (PARTITION BY store_id ORDER BY period_start, period_end, batch, n, users) AS place FROM rec")
def srt2(spark, d):
    w = Window.partitionBy("store_id").orderBy("period_start", "period_end", "batch", "n", "users")
    return records(spark, d).select("store_id", "period_start", "period_end", "batch", F.row_number().over(w).alias("place"))
