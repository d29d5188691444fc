"""Typed values, row checks, batch rules and scalar functions, on line items whose
cells are made dirty by fixed rules."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..adapters import SP, store_period, table
from ..functions import numbers as N, text as T, values as V
from ..operators import contracts as C, ledger as L, panels as P
from ..registry import query
from .diagnostics import FLAG_SQL, SAME_PERIOD, SHARED_SQL, SHARES, WINDOW, dia2, scope_flag

DIRTY = """dirty AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 7 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '%' WHEN 6 THEN '  ' WHEN 5 THEN '1e' || CAST(CAST(l_quantity AS INT) % 10 AS VARCHAR) WHEN 4 THEN '-' || CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE ' ' || CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS q,
CASE l_linenumber WHEN 3 THEN '1,000' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR) END AS p, CASE l_linenumber WHEN 2 THEN '2024-2-3' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS d FROM lineitem)"""
COUNT_SQL = "CASE WHEN regexp_matches(trim(q), '^[0-9]+$') THEN TRY_CAST(trim(q) AS BIGINT) END"
PRICE_SQL = r"CASE WHEN regexp_matches(trim(p), '^[+-]?[0-9]+(\.[0-9]+)?$') THEN TRY_CAST(trim(p) AS DOUBLE) END"
DATE_SQL = r"CASE WHEN regexp_matches(trim(d), '^\d{4}-\d{2}-\d{2}$') THEN TRY_CAST(trim(d) AS DATE) END"
ERR_SQL = f"concat_ws('; ', CASE WHEN trim(q) <> '' AND ({COUNT_SQL}) IS NULL THEN 'q: not a count' END, CASE WHEN trim(p) <> '' AND ({PRICE_SQL}) IS NULL THEN 'p: not a decimal' END, CASE WHEN trim(d) <> '' AND ({DATE_SQL}) IS NULL THEN 'd: not a date' END)"


def dirty(spark, d):
    """Line items as text cells: percent signs, blanks, exponents, signs, commas and
    short dates where the line number says so."""
    n = F.col("l_quantity").cast("int").cast("string")
    q = F.when(F.col("l_linenumber") == 7, F.concat(n, F.lit("%"))).when(F.col("l_linenumber") == 6, "  ").when(F.col("l_linenumber") == 5, F.concat(F.lit("1e"), (F.col("l_quantity").cast("int") % 10).cast("string"))).when(F.col("l_linenumber") == 4, F.concat(F.lit("-"), n)).otherwise(F.concat(F.lit(" "), n))
    p = F.when(F.col("l_linenumber") == 3, "1,000").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    day = F.when(F.col("l_linenumber") == 2, "2024-2-3").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), p.alias("p"), day.alias("d"))


def checked(spark, d):
    cells = {"q": "count", "p": "decimal", "d": "date"}
    return dirty(spark, d).withColumns({f"{c}_value": V.canonical(c, k) for c, k in cells.items()} | {"errors": V.errors(*(V.error(c, k, c) for c, k in cells.items()))})


@query("val1_typed_values", f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, {COUNT_SQL} AS q_value, {PRICE_SQL} AS p_value, {DATE_SQL} AS d_value FROM dirty")
def val1(spark, d):
    return checked(spark, d).select("l_orderkey", "l_linenumber", "q_value", F.col("p_value").cast("double").alias("p_value"), "d_value")


@query("val2_numeric_guard", f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, TRY_CAST(trim(q) AS DOUBLE) AS value FROM dirty")
def val2(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", V.finite(F.trim("q")).alias("value"))


@query("val3_row_errors", f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, {ERR_SQL} AS errors FROM dirty")
def val3(spark, d):
    return checked(spark, d).select("l_orderkey", "l_linenumber", F.array_join("errors", "; ").alias("errors"))


@query("val4_scope_conformity", "SELECT l_orderkey, l_linenumber, l_suppkey IS NOT DISTINCT FROM s.first_supp AS same_store FROM lineitem JOIN (SELECT l_orderkey AS k, min(l_suppkey) AS first_supp FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) s ON k = l_orderkey")
def val4(spark, d):
    li = table(spark, d, "lineitem")
    context = li.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("declared"))
    return li.join(context, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("l_suppkey").eqNullSafe(F.col("declared")).alias("same_store"))


@query("val5_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 50) > 1 AS duplicate FROM lineitem")
def val5(spark, d):
    w = Window.partitionBy("l_orderkey", F.col("l_partkey") % 50)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.count("*").over(w) > 1).alias("duplicate"))


_HELD = f"WITH {DIRTY}, e AS (SELECT *, {ERR_SQL} <> '' AS bad FROM dirty), h AS (SELECT *, bool_or(bad) OVER (PARTITION BY l_orderkey) AS held FROM e)"


@query("val6_batch_hold", f"{_HELD} SELECT held, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_batches FROM h GROUP BY held")
def val6(spark, d):
    held = P.all_or_nothing(checked(spark, d), "l_orderkey", F.size("errors") > 0)
    return held.groupBy("held").agg(F.count("*").alias("n_rows"), F.countDistinct("l_orderkey").alias("n_batches"))


@query("val7_proposal_match", f"WITH {DIRTY} SELECT d.l_orderkey, d.l_linenumber, ({COUNT_SQL}) IS NOT DISTINCT FROM CAST(l.l_quantity AS BIGINT) AS agrees FROM dirty d JOIN lineitem l ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber")
def val7(spark, d):
    proposed = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("proposed"))
    return checked(spark, d).join(proposed, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("q_value").eqNullSafe(F.col("proposed")).alias("agrees"))


@query("val8_window_label", "WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CASE WHEN o_orderkey % 2 = 0 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) + 6 END AS DATE) AS e FROM orders) SELECT o_orderkey, CASE WHEN day(s) = 1 AND e = last_day(s) THEN strftime(s, '%Y-%m') END AS label, e < s AS invalid FROM w")
def val8(spark, d):
    s = F.to_date("o_orderdate")
    w = table(spark, d, "orders").select("o_orderkey", s.alias("s"), F.when(F.col("o_orderkey") % 2 == 0, F.last_day(s)).otherwise(F.date_add(s, 6)).alias("e"))
    return w.select("o_orderkey", T.month_label("s", "e").alias("label"), (F.col("e") < F.col("s")).alias("invalid"))


@query("val9_table_check", f"WITH {SP} SELECT count(*) AS n_rows, count(*) FILTER (store_id IS NULL OR period_start IS NULL) AS n_missing_key, count(*) - count(DISTINCT (store_id, period_start)) AS n_repeated, count(*) FILTER (day(period_start) <> 1 OR period_end <> last_day(period_start)) AS n_not_month FROM sp")
def val9(spark, d):
    p = store_period(spark, d)
    return p.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("store_id").isNull() | F.col("period_start").isNull()).alias("n_missing_key"),
        (F.count("*") - F.countDistinct("store_id", "period_start")).alias("n_repeated"), F.count_if(T.month_label("period_start", "period_end").isNull()).alias("n_not_month"),
    )


@query("val10_key_integrity", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def val10(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


STATUSES, SEMANTICS = ["validated", "quarantined", "withdrawn"], "store totals by paid orders"
# Batches made of orders, with a fault of each kind in some of them.
_META = {
    "file_digest": "CASE WHEN o_orderkey % 11 = 1 THEN 'sha256:' || {sha} ELSE {sha} END", "extracted_at": "o_orderdate", "received_at": "CASE WHEN o_orderkey % 11 = 2 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 2 DAY END",
    "coverage_start": "CASE WHEN o_orderkey % 11 = 3 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate - INTERVAL 30 DAY END", "coverage_end": "CASE WHEN o_orderkey % 11 = 4 THEN o_orderdate + INTERVAL 9 DAY ELSE o_orderdate END",
    "status": "CASE WHEN o_orderkey % 11 = 5 THEN 'new' ELSE 'validated' END", "semantics": "CASE WHEN o_orderkey % 11 = 6 THEN 'gross totals' ELSE '" + SEMANTICS + "' END",
}


@query("val11_batch_metadata", """SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'digest' WHEN 2 THEN 'received before extracted' WHEN 3 THEN 'coverage order' WHEN 4 THEN 'coverage after extraction' WHEN 5 THEN 'status' WHEN 6 THEN 'semantics' ELSE '' END AS errors FROM orders""")
def val11(spark, d):
    sha = "sha2(cast(o_orderkey as string), 256)"
    b = table(spark, d, "orders").select("o_orderkey", *(F.expr(e.format(sha=sha) if "{sha}" in e else e).alias(n) for n, e in _META.items()))
    return b.select("o_orderkey", F.array_join(L.metadata_errors(STATUSES, SEMANTICS), "; ").alias("errors"))


SCOPE_KEYS, ZONES = ["cohort", "entity", "metric_set", "scope_version", "timezone"], ["UTC", "Asia/Shanghai", "Europe/Paris"]
FORMATS = [
    ("1", "csv_v1", True, False, False, None), ("2", "csv_v1", True, False, False, None), ("2", "csv_v2", False, False, True, None), ("3", "csv_v1", True, False, False, None),
    ("3", "csv_v2", False, False, True, None), ("3", "text_v1", False, True, True, ["store_period"]), ("3", "text_v2", True, True, True, ["store_period"]),
]
FORMAT_TYPE = "registry_version string, mapping_version string, whole_months boolean, manual boolean, scoped boolean, datasets array<string>"
_SCOPE = '{"cohort":"all","entity":"store","metric_set":"totals","scope_version":"1","timezone":"UTC"}'
# Uploads made of orders; what each breaks follows from its number.
_UPLOAD = {
    "registry_version": "CASE f WHEN 1 THEN '9' WHEN 2 THEN '1' ELSE '3' END", "mapping_version": "CASE WHEN f IN (3, 4, 9) THEN 'csv_v1' WHEN f IN (5, 6, 8) THEN 'text_v2' ELSE 'csv_v2' END",
    "dataset_id": "CASE f WHEN 8 THEN 'other' ELSE 'store_period' END", "period_start": "CASE WHEN f IN (3, 5, 6, 8, 9) THEN first WHEN f = 12 THEN '1996-13-01' ELSE d END",
    "period_end": "CASE WHEN f IN (3, 5, 6, 8, 9) THEN last WHEN f = 11 THEN before ELSE e END", "document_id": "CASE WHEN f IN (6, 7, 8) THEN 'doc' END", "source_block_line": "CASE WHEN f IN (6, 7, 8) THEN 3 END",
    "aggregation_scope": f"CASE WHEN f IN (0, 9) THEN '{_SCOPE}' WHEN f = 14 THEN '{_SCOPE.replace('UTC', 'Mars')}' END",
    "file_sha256": "CASE WHEN f IN (10, 15) THEN 'abc' ELSE sha2(cast(o_orderkey as string), 256) END", "extracted_at": "CASE WHEN f IN (13, 15) THEN concat(d, 'T10:00:00') ELSE concat(d, 'T10:00:00+08:00') END",
}


@query("val12_registration_rules", """SELECT o_orderkey, CASE f WHEN 1 THEN 'registry version' WHEN 2 THEN 'format' WHEN 4 THEN 'window: not a month' WHEN 5 THEN 'document and line needed' WHEN 7 THEN 'document and line not known to the format'
WHEN 8 THEN 'dataset' WHEN 9 THEN 'scope not known to the format' WHEN 10 THEN 'digest' WHEN 11 THEN 'window: ends before it starts' WHEN 12 THEN 'window: not two days' WHEN 13 THEN 'extracted_at'
WHEN 14 THEN 'scope timezone: not registered' WHEN 15 THEN 'digest; extracted_at' ELSE '' END AS errors,
CASE WHEN f IN (3, 5, 6, 8, 9) THEN strftime(o_orderdate, '%Y-%m') WHEN f NOT IN (11, 12) THEN strftime(o_orderdate, '%Y-%m-%d') || '..' || strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') END AS window_label
FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 16 AS f FROM orders)""")
def val12(spark, d):
    """Uploads against the formats that their registry version knows."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 16).alias("f"), day("o_orderdate").alias("d"), day(F.date_add("o_orderdate", 6)).alias("e"), day(F.date_add("o_orderdate", -1)).alias("before"),
        day(F.trunc("o_orderdate", "month")).alias("first"), day(F.last_day("o_orderdate")).alias("last"),
    )
    u = o.select("o_orderkey", *(F.expr(x).alias(n) for n, x in _UPLOAD.items()))
    r = C.registered_uploads(u, spark.createDataFrame(FORMATS, FORMAT_TYPE), SCOPE_KEYS, "1", ZONES)
    return r.select("o_orderkey", F.array_join("errors", "; ").alias("errors"), F.col("window").alias("window_label"))


@query("val13_binding_membership", "WITH b AS (SELECT c_custkey, unnest([c_mktsegment, 'S' || (c_custkey % 7)]) AS ds FROM customer) SELECT ds, count(*) AS n, count(*) > 1 AS shared FROM b WHERE ds NOT IN (SELECT DISTINCT c_mktsegment FROM customer) GROUP BY ds")
def val13(spark, d):
    c = table(spark, d, "customer")
    known = c.select(F.col("c_mktsegment").alias("ds")).distinct()
    b = c.select(F.explode(F.array("c_mktsegment", F.concat(F.lit("S"), (F.col("c_custkey") % 7).cast("string")))).alias("ds"))
    return b.join(known, "ds", "left_anti").groupBy("ds").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("shared"))


_DECLARED = """CASE c_custkey % 9 WHEN 1 THEN concat('{ "timezone": "UTC", "scope_version": "1", "metric_set": "totals", "entity": "S', c_nationkey, '", "cohort": "', c_mktsegment, '" }')
WHEN 2 THEN '{"cohort":"a","metric_set":"totals","scope_version":"1","timezone":"UTC"}' WHEN 3 THEN '{"cohort":"a","entity":"b","metric_set":"totals","scope_version":"1","timezone":"UTC","x":"y"}'
WHEN 4 THEN '{"cohort":5,"entity":" ","metric_set":"totals","scope_version":"1","timezone":"UTC"}' WHEN 5 THEN '{"cohort":"a","entity":"b","metric_set":"totals","scope_version":"2","timezone":"UTC"}'
WHEN 6 THEN '{"cohort":"a","entity":"b","metric_set":"totals","scope_version":"1","timezone":"localtime"}' WHEN 7 THEN 'nonsense' WHEN 8 THEN NULL
ELSE concat('{"cohort":"', c_mktsegment, '","entity":"S', c_nationkey, '","metric_set":"totals","scope_version":"1","timezone":"UTC"}') END"""


@query("val14_scope_digest", """SELECT c_custkey, CASE c_custkey % 9 WHEN 2 THEN 'missing: entity' WHEN 3 THEN 'unknown: x' WHEN 4 THEN 'cohort: not a text; entity: not a text' WHEN 5 THEN 'scope_version: not registered' WHEN 6 THEN 'timezone: not registered' WHEN 7 THEN 'not an object' ELSE '' END AS errors,
CASE WHEN c_custkey % 9 < 2 THEN sha256('{"cohort":"' || c_mktsegment || '","entity":"S' || c_nationkey || '","metric_set":"totals","scope_version":"1","timezone":"UTC"}') END AS scope_digest FROM customer""")
def val14(spark, d):
    """Declared scopes, with the digest of those that break nothing: the same whatever
    the order of their keys."""
    c = table(spark, d, "customer").select("c_custkey", F.expr(_DECLARED).alias("scope")).withColumn("told", C.scope_errors("scope", SCOPE_KEYS, "1", ZONES))
    return c.select("c_custkey", F.array_join("told", "; ").alias("errors"), F.when(F.size("told") == 0, C.scope_digest("scope", SCOPE_KEYS)).alias("scope_digest"))


IDENTITIES = {
    "average_order_value": "transaction_amount / nullif(transaction_orders, 0)", "entry_conversion_rate_pct": "entry_users * 100.0e0 / nullif(exposure_users, 0)",
    "order_conversion_rate_pct": "order_users * 100.0e0 / nullif(entry_users, 0)", "payment_conversion_rate_pct": "payment_users * 100.0e0 / nullif(order_users, 0)",
    "activity_cost_ratio_pct": "activity_cost * 100.0e0 / nullif(activity_original_transaction_amount, 0)", "activity_cost": "merchant_subsidy_amount + platform_subsidy_amount",
}
_ID = " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS actual, {e} AS expected, store_id LIKE '%4' AND '{n}' = 'average_order_value' AS altered FROM sp" for n, e in IDENTITIES.items())


@query("val15_metric_identity", f"WITH {SP}, u AS ({_ID}) SELECT metric, count(*) FILTER (actual IS NOT NULL AND expected IS NOT NULL) AS n_checked, count(*) FILTER (altered AND actual IS NOT NULL AND expected IS NOT NULL) AS n_off, count(*) FILTER ((actual IS NULL) <> (expected IS NULL)) AS n_one_missing FROM u GROUP BY metric")
def val15(spark, d):
    """Metrics against what they are made of, within 0.02; one of them was altered in some
    stores on purpose."""
    off = F.when(F.col("store_id").endswith("4"), F.col("average_order_value") + 0.5).otherwise(F.col("average_order_value"))
    return L.identities(store_period(spark, d).withColumn("average_order_value", off), IDENTITIES, 0.02)


_FUNNEL = "f AS (SELECT user_id % 10 AS bucket, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS v, count(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS c, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS p FROM events GROUP BY 1)"


@query("val16_funnel_order", f"WITH {_FUNNEL} SELECT *, v >= c AND c >= p AS monotone FROM f")
def val16(spark, d):
    users = lambda e: F.countDistinct(F.when(F.col("event_type") == e, F.col("user_id")))
    f = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("bucket")).agg(users("view").alias("v"), users("click").alias("c"), users("purchase").alias("p"))
    return f.withColumn("monotone", (F.col("v") >= F.col("c")) & (F.col("c") >= F.col("p")))


@query("val17_rows_per_group", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> 3")
def val17(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 3")


_RATES = {n: xy for n, xy in SHARES.items() if set(xy) <= set(SAME_PERIOD)}
_OFF, _READY = next(iter(_RATES)), "same_period_diagnostic_ready"


@query("val18_rederivation", f"""WITH {SHARED_SQL} SELECT store_id, period_month, concat_ws('; ', CASE WHEN store_id LIKE '%4' AND {_OFF} IS NOT NULL THEN '{_OFF}: differs' WHEN store_id LIKE '%5' AND {_OFF} IS NOT NULL THEN '{_OFF}: missing' END,
CASE WHEN store_id LIKE '%7' AND ({FLAG_SQL}) <> '{_READY}' THEN 'scope_flag: differs' END, CASE WHEN store_id LIKE '%9' THEN 'notes: empty' END) AS errors FROM sh""")
def val18(spark, d):
    """The same-period output against what it is made of: all its rates within 0.05, its
    flag and its notes. Some stores' stored rows were altered on purpose."""
    ends = lambda x: F.col("store_id").endswith(x)
    off = F.when(ends("4"), F.col(_OFF) + 1).when(~ends("5"), F.col(_OFF))
    stored = dia2(spark, d).withColumns({_OFF: off, "scope_flag": F.when(ends("7"), _READY).otherwise(F.col("scope_flag")), "notes": F.when(ends("9"), " ").otherwise(F.col("notes"))})
    told = C.rederived(stored, ["store_id", "period_month"], {n: N.pct(x, y) for n, (x, y) in _RATES.items()}, ("scope_flag", scope_flag(WINDOW)), "notes", 0.05)
    return told.withColumn("errors", F.array_join("errors", "; "))


_FACT = "fact AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)"


@query("val20_period_metadata", f"WITH {SP} SELECT store_id, period_month, strftime(period_start, '%Y-%m') = period_month AND period_end = last_day(period_start) AS consistent FROM sp")
def val20(spark, d):
    return store_period(spark, d).select("store_id", "period_month", F.coalesce(T.month_label("period_start", "period_end") == F.col("period_month"), F.lit(False)).alias("consistent"))


TYPES = ["positive", "negative", "ambiguous"]
_CASE = """concat('{"expected_period_terms": ["1996-01"]', CASE f WHEN 1 THEN ', "case_type": "odd"' WHEN 2 THEN ', "case_type": 7' ELSE ', "case_type": "positive"' END, CASE f WHEN 3 THEN ', "expected_entity": 5' ELSE ', "expected_entity": null' END,
CASE f WHEN 4 THEN ', "expected_terms": "a"' WHEN 5 THEN ', "expected_terms": ["a", " "]' ELSE ', "expected_terms": []' END, CASE f WHEN 6 THEN '' ELSE ', "expected_slot": "s"' END,
CASE f WHEN 7 THEN ', "case_id": 7' WHEN 8 THEN concat(', "case_id": " c', doc_id - 2, '"') ELSE concat(', "case_id": "c', doc_id, ' "') END, CASE WHEN text IS NULL THEN '' ELSE concat(', ', substring(to_json(named_struct('query', text)), 2, length(to_json(named_struct('query', text))) - 2)) END, '}')"""


@query("val21_case_validation", """WITH c AS (SELECT doc_id, doc_id % 10 AS f, text, CASE WHEN doc_id % 10 IN (7, 9) THEN NULL WHEN doc_id % 10 = 8 THEN doc_id - 2 ELSE doc_id END AS cid, CASE WHEN doc_id % 10 <> 9 THEN nullif(trim(text), '') END AS q FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY cid) AS c1, min(doc_id) OVER (PARTITION BY q) AS q1 FROM c)
SELECT doc_id, CASE WHEN f = 9 THEN 'not an object' ELSE concat_ws('; ', CASE WHEN f = 6 THEN 'expected_slot: missing' END, CASE WHEN text IS NULL THEN 'query: missing' END, CASE WHEN f = 7 THEN 'case_id: not a text' END, CASE WHEN text IS NOT NULL AND q IS NULL THEN 'query: not a text' END,
CASE WHEN f IN (1, 2) THEN 'case_type: not registered' END, CASE WHEN f = 3 THEN 'expected_entity: not a text or null' END, CASE WHEN f IN (4, 5) THEN 'expected_terms: not a list of texts' END,
CASE WHEN cid IS NOT NULL AND c1 < doc_id THEN 'case_id: as case ' || c1 END, CASE WHEN q IS NOT NULL AND q1 < doc_id THEN 'query: as case ' || q1 END) END AS errors FROM m""")
def val21(spark, d):
    """Retrieval cases made of whole documents, with a fault of each kind in some."""
    c = table(spark, d, "documents").withColumn("f", F.col("doc_id") % 10)
    raw = F.when(F.col("f") == 9, "[1]").otherwise(F.expr(_CASE))
    return C.case_errors(c.select("doc_id", raw.alias("raw")), "doc_id", "raw", TYPES).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query("val22_published_records", f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, ({COUNT_SQL}) IS NULL AND trim(q) = '' OR CAST(({COUNT_SQL}) AS VARCHAR) = trim(q) AS canonical FROM dirty")
def val22(spark, d):
    c = checked(spark, d)
    again = F.col("q_value").cast("string")
    return c.select("l_orderkey", "l_linenumber", F.when(F.trim("q") == "", True).otherwise(again == F.trim("q")).alias("canonical"))


REGISTERED = [("orders", "o_orderkey", True), ("orders", "o_totalprice", False), ("orders", "o_orderdate", False), ("lineitem", "l_orderkey", True), ("lineitem", "l_quantity", False)]
_ASKED = "CASE o_orderkey % 8 WHEN 1 THEN array('o_totalprice') WHEN 2 THEN array('o_totalprice', 'o_totalprice') WHEN 3 THEN cast(array() as array<string>) WHEN 4 THEN array('zz', 'o_orderkey') WHEN 5 THEN array('a') WHEN 7 THEN array('o_totalprice', 'o_orderdate') END"


@query("val23_requested_fields", """SELECT o_orderkey AS request_id, CASE o_orderkey % 8 WHEN 0 THEN 'o_orderdate,o_totalprice' WHEN 1 THEN 'o_totalprice' WHEN 6 THEN 'l_quantity' WHEN 7 THEN 'o_orderdate,o_totalprice' END AS selected,
CASE o_orderkey % 8 WHEN 2 THEN 'repeated fields' WHEN 3 THEN 'no fields' WHEN 4 THEN 'not registered or keys: o_orderkey, zz' WHEN 5 THEN 'dataset' ELSE '' END AS errors FROM orders""")
def val23(spark, d):
    """Fields that requests, made of orders, ask for: all of a dataset if none is named."""
    dataset = F.when(F.col("o_orderkey") % 8 == 5, "none").when(F.col("o_orderkey") % 8 == 6, "lineitem").otherwise("orders")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), dataset.alias("dataset_id"), F.expr(_ASKED).alias("fields"))
    r = C.requested_fields(asked, spark.createDataFrame(REGISTERED, "dataset_id string, field string, is_key boolean"))
    return r.select("request_id", F.array_join("selected", ",").alias("selected"), F.array_join("errors", "; ").alias("errors"))


ALIASES = ["password", "secret", "k"]


@query("val24_forbidden_terms", f"""WITH a AS (SELECT unnest({ALIASES}) AS alias) SELECT 'text' AS kind, source AS place, alias, count(*) AS n FROM documents JOIN a ON contains(text, alias) GROUP BY ALL
UNION ALL SELECT 'name', 'events', alias, count(*) FROM (SELECT unnest(json_keys(props)) AS name FROM events) JOIN a ON name = alias GROUP BY ALL""")
def val24(spark, d):
    """Aliases that remain in texts, and as names of the events' fields."""
    names = table(spark, d, "events").select(F.lit("events").alias("place"), F.explode(F.json_object_keys("props")).alias("name"))
    return C.forbidden_names(table(spark, d, "documents").select(F.col("source").alias("place"), "text"), names, ALIASES)


SLOTS = {"purchase": {"fields": ["value", "k"], "any_of": [["1", "2"]]}, "click": {"fields": ["k"], "terms": ["7"], "any_of": [["8", "9"], ["3", "4", "5"]]}, "view": {"terms": ['"K"', "5"]}}


@query("val25_slot_coverage", """WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT unnest(['purchase', 'click', 'view']) AS slot), e AS (SELECT user_id, event_type AS slot, value, props->>'k' AS k, props AS t FROM events),
g AS (SELECT user_id, slot, count(*) AS n, bool_or(value IS NULL) AS v0, bool_or(coalesce(trim(k), '') = '') AS k0, bool_or(NOT regexp_matches(t, '[12]')) AS a0, bool_or(NOT contains(t, '7')) AS c0, bool_or(NOT regexp_matches(t, '[89]')) AS c1, bool_or(NOT regexp_matches(t, '[345]')) AS c2, bool_or(NOT contains(t, '"k"')) AS w0, bool_or(NOT contains(t, '5')) AS w1 FROM e GROUP BY 1, 2)
SELECT user_id, slot, coalesce(n, 0) AS n, concat_ws('; ', CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END, CASE WHEN slot = 'purchase' AND v0 THEN 'value: empty' END, CASE WHEN slot IN ('purchase', 'click') AND k0 THEN 'k: empty' END, CASE WHEN slot = 'purchase' AND a0 THEN 'none of 1, 2' END,
CASE WHEN slot = 'click' AND c0 THEN 'no 7' END, CASE WHEN slot = 'click' AND c1 THEN 'none of 8, 9' END, CASE WHEN slot = 'click' AND c2 THEN 'none of 3, 4, 5' END, CASE WHEN slot = 'view' AND w0 THEN 'no "K"' END, CASE WHEN slot = 'view' AND w1 THEN 'no 5' END) AS errors
FROM u CROSS JOIN s LEFT JOIN g USING (user_id, slot)""")
def val25(spark, d):
    """Every user's expected facts: there once, with the fields and terms of their slot."""
    facts = table(spark, d, "events").select("user_id", F.col("event_type").alias("slot"), "value", F.get_json_object("props", "$.k").alias("k"), "props")
    return C.slot_coverage(facts, facts, "user_id", SLOTS, "props").withColumn("errors", F.array_join("errors", "; "))


DICTIONARY = ["# Fields", "- `k`: the key of an event", "- `store_id`: the store", "* `period_month`: month of the window", "text about `value` in a line that defines nothing", "- `entry_users`: users who entered"]
HEADERS = ["store_id", "period_month", "value", "entry_users", "exposure_users"]


@query("val26_documented_fields", f"""WITH k AS (SELECT DISTINCT unnest(json_keys(props)) AS field FROM events), h AS (SELECT field FROM k UNION SELECT unnest({HEADERS}))
SELECT field, field IN ('k', 'store_id', 'period_month', 'entry_users') AS documented FROM h""")
def val26(spark, d):
    """Headers of the panel and keys of the events against the fields that lines of a
    dictionary define."""
    own = table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("field"))
    headers = spark.createDataFrame([(h,) for h in HEADERS], "field string")
    return L.documented(own.unionByName(headers), spark.createDataFrame([(x,) for x in DICTIONARY], "line string"))


CASES = [("user", ["th", "an"], ["stupid", "idiot"]), ("assistant", ["the", "of"], ["whes"])]
_CV = ", ".join(f"('{r}', {a}, {b})" for r, a, b in CASES)


@query("val27_answer_contract", f"""WITH c AS (SELECT * FROM (VALUES {_CV}) AS v(role, required, forbidden)), j AS (SELECT role, len(list_filter(required, lambda x: NOT contains(lower(coalesce(text, '')), x))) AS lacks, len(list_filter(forbidden, lambda x: contains(lower(coalesce(text, '')), x))) AS has FROM conversations JOIN c USING (role))
SELECT role, count(*) AS n, count(*) FILTER (lacks = 0 AND has = 0) AS passed, count(*) FILTER (lacks > 0) AS n_lacking, count(*) FILTER (has > 0) AS n_forbidden, round(count(*) FILTER (lacks = 0 AND has = 0) * CAST(1 AS DOUBLE) / count(*), 4) AS pass_rate FROM j GROUP BY role""")
def val27(spark, d):
    """Messages against the terms that their role's case requires and forbids."""
    cases = spark.createDataFrame(CASES, "role string, required array<string>, forbidden array<string>")
    low, both = F.lower(F.coalesce("text", F.lit(""))), table(spark, d, "conversations").join(cases, "role")
    j = both.select("role", F.forall("required", lambda x: F.contains(low, x)).alias("has_all"), F.exists("forbidden", lambda x: F.contains(low, x)).alias("has_bad"))
    ok = F.col("has_all") & ~F.col("has_bad")
    return j.groupBy("role").agg(F.count("*").alias("n"), F.count_if(ok).alias("passed"), F.count_if(~F.col("has_all")).alias("n_lacking"), F.count_if("has_bad").alias("n_forbidden"), F.round(F.count_if(ok) / F.count("*"), 4).alias("pass_rate"))


@query("udf1_retail_value", f"WITH {DIRTY} SELECT count({COUNT_SQL}) AS n_counts, count({PRICE_SQL}) AS n_prices FROM dirty")
def udf1(spark, d):
    """The canonical value as a SQL function, which Catalyst inlines."""
    V.sql_function(spark, "tallyproof_count", "count")
    V.sql_function(spark, "tallyproof_decimal", "decimal")
    return dirty(spark, d).agg(F.expr("count(tallyproof_count(q))").alias("n_counts"), F.expr("count(tallyproof_decimal(p))").alias("n_prices"))


@query("fstr1_blank_to_null", f"WITH {DIRTY} SELECT l_orderkey, l_linenumber, nullif(trim(q), '') AS q FROM dirty")
def fstr1(spark, d):
    return dirty(spark, d).select("l_orderkey", "l_linenumber", T.blank_to_null("q").alias("q"))


@query("fstr2_notes", "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_totalprice > 200000 THEN 'large' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, 'order') AS note FROM orders")
def fstr2(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("; ", F.when(F.col("o_totalprice") > 200000, "large"), F.when(F.col("o_orderstatus") == "P", "pending"), F.lit("order")).alias("note"))


@query("fstr3_terms", "SELECT doc_id, contains(lower(text), 'the') AND contains(lower(text), 'and') AS has_all, contains(lower(text), 'der') OR contains(lower(text), 'les') AS has_any FROM documents")
def fstr3(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contains_all("text", ["The", "and"]).alias("has_all"), T.contains_any("text", ["der", "les"]).alias("has_any"))


@query("fstr4_word_match", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AS hit FROM documents")
def fstr4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_word("text", "the").alias("hit"))


@query("fstr5_label_tail", r"SELECT p_partkey, nullif(regexp_extract(p_type || ' ' || p_brand, '^' || 'STANDARD' || '[\s:]+(.*)$', 1), '') AS tail FROM part")
def fstr5(spark, d):
    return table(spark, d, "part").select("p_partkey", T.after_label(F.concat_ws(" ", "p_type", "p_brand"), "STANDARD").alias("tail"))


@query("fstr6_split_list", "SELECT p_partkey, 3 AS n, p_name AS first, p_brand || ' (a,b)' AS second FROM part")
def fstr6(spark, d):
    parts = T.outside_parentheses(F.concat("p_name", F.lit(","), "p_brand", F.lit(" (a,b),"), "p_type"))
    return table(spark, d, "part").select("p_partkey", F.size(parts).alias("n"), parts[0].alias("first"), parts[1].alias("second"))


@query("fstr7_labelled_number", "SELECT p_partkey, p_name AS name, CAST(p_size AS BIGINT) AS n FROM part")
def fstr7(spark, d):
    t = F.concat("p_name", F.lit("（销量"), F.col("p_size").cast("string"), F.lit("）"))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(t, "^(.*)（销量([0-9]+)）$", 1).alias("name"), F.regexp_extract(t, "^(.*)（销量([0-9]+)）$", 2).cast("bigint").alias("n"))


@query("fstr8_squeeze", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS h FROM documents")
def fstr8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeeze("text")).alias("h"))


@query("fstr9_span", "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN CAST(strpos(text, 'the') AS INT) END AS s, CASE WHEN strpos(text, 'the') > 0 THEN CAST(strpos(text, 'the') + 3 AS INT) END AS e FROM documents")
def fstr9(spark, d):
    return table(spark, d, "documents").select("doc_id", T.span("text", "the").alias("at")).select("doc_id", F.col("at.start").alias("s"), F.col("at.end").alias("e"))


FILLERS = ["the", "of", "and", "in", "that", "an"]
REPLACED = [("with", "using"), ("from", "out of"), ("what", "which"), ("for", "in favour of")]
_SQ = r"trim(regexp_replace({}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"
_PARA = "q"
for _a, _b in REPLACED:
    _PARA = rf"regexp_replace({_PARA}, '\b{_a}\b', '{_b}', 'gi')"


@query("fstr10_query_variants", rf"""WITH b AS (SELECT item_id, {_SQ.format('text')} AS q FROM benchmark), w AS (SELECT *, string_split(q, ' ') AS w FROM b),
k AS (SELECT *, list_filter(w, lambda x: NOT list_contains([{', '.join(f"'{x}'" for x in FILLERS)}], lower(regexp_replace(x, '[^A-Za-z0-9_%-]', '', 'g')))) AS kept, CAST(len(w) // 2 AS BIGINT) AS half, {_PARA} AS para FROM w),
v AS (SELECT item_id, 1 AS i, 'original' AS variant, q AS wording FROM k
UNION ALL SELECT item_id, 2, 'shortened', CASE WHEN len(kept) >= 4 THEN array_to_string(kept[1:18], ' ') WHEN len(w) > 8 THEN array_to_string(w[1:8], ' ') ELSE q END FROM k
UNION ALL SELECT item_id, 3, 'paraphrased', CASE WHEN para = q THEN 'What evidence is available for: ' || q ELSE para END FROM k
UNION ALL SELECT item_id, 4, 'noise', replace(replace(array_to_string(list_transform(w, lambda x, n: CASE WHEN n = item_id % len(w) + 1 AND length(x) >= 5 THEN substr(x, 1, 1) || substr(x, 3, 1) || substr(x, 2, 1) || substr(x, 4) ELSE x END), ' '), ',', ''), ';', '') || ' ??' FROM k
UNION ALL SELECT item_id, 5, 'reordered', CASE WHEN len(w) < 6 THEN q || ' evidence' ELSE array_to_string(list_concat(w[half + 1:], w[:half]), ' ') END FROM k)
SELECT item_id, arg_min(variant, i) AS variant, wording FROM (SELECT item_id, i, variant, {_SQ.format('wording')} AS wording FROM v) GROUP BY item_id, wording""")
def fstr10(spark, d):
    """Wordings of each question, each once: without fillers, paraphrased, with two
    letters of one word swapped, and with its halves exchanged."""
    return variants(table(spark, d, "benchmark"), "item_id", "text")


def variants(items, key: str, text: str):
    b = items.select(key, T.squeeze(text).alias("q")).withColumn("w", F.split("q", " ")).withColumn("n", F.size("w"))
    kept = F.filter("w", lambda x: ~F.lower(F.regexp_replace(x, "[^A-Za-z0-9_%-]", "")).isin(FILLERS))
    para = F.col("q")
    for a, c in REPLACED:
        para = F.regexp_replace(para, rf"(?i)\b{a}\b", c)
    b = b.withColumns({"kept": kept, "para": para})
    half, line = F.floor(F.col("n") / 2).cast("int"), lambda x: F.array_join(x, " ")
    turned = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, 3, 1), F.substring(x, 2, 1), F.substring(x, 4, 1 << 20))
    noisy = F.transform("w", lambda x, i: F.when((i == F.col(key) % F.col("n")) & (F.char_length(x) >= 5), turned(x)).otherwise(x))
    made = {
        "original": F.col("q"),
        "shortened": F.when(F.size("kept") >= 4, line(F.slice("kept", 1, 18))).when(F.col("n") > 8, line(F.slice("w", 1, 8))).otherwise(F.col("q")),
        "paraphrased": F.when(F.col("para") == F.col("q"), F.concat(F.lit("What evidence is available for: "), "q")).otherwise(F.col("para")),
        "noise": F.concat(F.regexp_replace(line(noisy), "[,;]", ""), F.lit(" ??")),
        "reordered": F.when(F.col("n") < 6, F.concat("q", F.lit(" evidence"))).otherwise(line(F.concat(F.slice("w", half + 1, F.col("n")), F.slice("w", F.lit(1), half)))),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("variant"), T.squeeze(v).alias("wording")) for i, (k, v) in enumerate(made.items())))
    return b.select(key, F.inline(rows)).groupBy(key, "wording").agg(F.min_by("variant", "i").alias("variant"))


_ASK = """CASE doc_id % 9 WHEN 0 THEN concat('Compare stores B-', char(67 + doc_id % 4), ' with store a1') WHEN 1 THEN 'store_k7_x and Store z' WHEN 2 THEN 'restore b, stores; storefront c' WHEN 3 THEN 'Stores F—D, h and 12; store e'
WHEN 4 THEN concat('store b to d & store x through z, ', doc_id) WHEN 5 THEN 'b3店 和 门店 7' WHEN 6 THEN 'StoreB2 StoreC storeD' WHEN 7 THEN 'panel B - F' ELSE source END"""


@query("fstr11_entity_mentions", """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN array_to_string(list_transform(range(0, CAST(doc_id % 4 + 2 AS BIGINT)), lambda i: 'store_' || chr(CAST(98 + i AS INT))), ',') || ',store_a1' WHEN 1 THEN 'store_k7_x,store_z'
WHEN 3 THEN 'store_d,store_e,store_f,store_h,store_12' WHEN 4 THEN 'store_b,store_c,store_d,store_x,store_y,store_z,store_' || doc_id WHEN 5 THEN 'store_b3,store_7' WHEN 6 THEN 'store_b2,store_c' WHEN 7 THEN 'store_b,store_c,store_d,store_e,store_f' ELSE '' END AS stores FROM documents""")
def fstr11(spark, d):
    """Stores named in requests that are made up from documents' numbers."""
    return table(spark, d, "documents").select("doc_id", F.array_join(T.entity_mentions(F.expr(_ASK)), ",").alias("stores"))


@query("fstr12_chunks", r"""WITH c AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n\s*\n')) AS c FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
t AS (SELECT *, contains(line, ' | ') AS is_row FROM l), s AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER (PARTITION BY doc_id ORDER BY n), false) AS top FROM t),
h AS (SELECT *, last_value(CASE WHEN top THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS header FROM s),
r AS (SELECT doc_id, count(*) AS n_rows, CAST(sum(length(trim(header))) AS BIGINT) AS header_chars FROM h WHERE is_row AND NOT top GROUP BY doc_id)
SELECT doc_id, count(*) FILTER (n >= 80) AS n_chunks, CAST(sum(n) FILTER (n >= 80) AS BIGINT) AS n_chars, coalesce(any_value(n_rows), 0) AS n_rows, coalesce(any_value(header_chars), 0) AS header_chars FROM (SELECT doc_id, length(trim(c)) AS n FROM c) LEFT JOIN r USING (doc_id) GROUP BY doc_id""")
def fstr12(spark, d):
    """Paragraphs of 80 characters or more, between blank lines, and the rows of tables
    with their header. Sentences of the supplied texts are set apart first, as these have
    no blank lines; their table rows are lines with ' | '."""
    docs, text = table(spark, d, "documents"), F.replace("text", F.lit(". "), F.lit(".\n\n"))
    c = T.paragraphs(docs.select("doc_id", text.alias("text")), "doc_id", "text").withColumn("n", F.char_length(F.trim("chunk")))
    rows = T.table_rows(docs, "doc_id", "text", lambda line: F.contains(line, F.lit(" | "))).groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum(F.char_length("header")).alias("header_chars"))
    g = c.groupBy("doc_id").agg(F.count_if(F.col("n") >= 80).alias("n_chunks"), F.sum(F.when(F.col("n") >= 80, F.col("n"))).alias("n_chars"))
    return g.join(rows, "doc_id", "left").fillna(0, ["n_rows", "header_chars"])


@query("fstr14_snippet", rf"""WITH t AS (SELECT doc_id, {_SQ.format('text')} AS t FROM documents), p AS (SELECT *, length(t) AS n, list_min(list_filter([strpos(lower(t), 'with'), strpos(lower(t), 'der'), strpos(lower(t), 'les')], lambda x: x > 0)) - 1 AS pos FROM t),
q AS (SELECT *, greatest(0, pos - 96) AS f FROM p), r AS (SELECT *, least(n, f + 314) AS e FROM q), s AS (SELECT *, greatest(0, least(f, e - 314)) AS s FROM r)
SELECT doc_id, CASE WHEN n <= 320 THEN t WHEN pos IS NULL THEN rtrim(substr(t, 1, 317)) || '...' ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(t, s + 1, e - s)) || CASE WHEN e < n THEN '...' ELSE '' END END AS snippet FROM s""")
def fstr14(spark, d):
    return table(spark, d, "documents").select("doc_id", T.snippet("text", ["with", "der", "les"], 320).alias("snippet"))


@query("fdat1_month_bounds", f"WITH {SP} SELECT DISTINCT period_month, CAST(period_month || '-01' AS DATE) AS first, last_day(CAST(period_month || '-01' AS DATE)) AS last FROM sp")
def fdat1(spark, d):
    first, last = T.month_bounds("period_month")
    return store_period(spark, d).select("period_month", first.alias("first"), last.alias("last")).distinct()


@query("fdat2_day_counts", f"WITH {SP} SELECT store_id, period_month, CAST(period_end - period_start + 1 AS INT) AS days FROM sp")
def fdat2(spark, d):
    return store_period(spark, d).select("store_id", "period_month", T.days("period_start", "period_end").alias("days"))


_REQUEST = """CASE o_orderkey % 9 WHEN 0 THEN 'from ' || d || ' to ' || e WHEN 1 THEN 'in ' || m || ' ' || y WHEN 2 THEN y || '年' || k || '月' WHEN 3 THEN 'sales for ' || y || '-' || mm WHEN 4 THEN 'on ' || d
WHEN 5 THEN 'last month' WHEN 6 THEN 'March ' || y || ' to May ' || y WHEN 7 THEN 'since ' || m || ' ' || y ELSE 'how are we doing' END"""


@query("fdat3_request_window", """WITH o AS (SELECT o_orderkey, o_orderkey % 9 AS f, CAST(o_orderdate AS DATE) AS a, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)
SELECT o_orderkey, CASE WHEN f = 0 THEN a WHEN f IN (1, 2, 3) THEN m WHEN f = 6 THEN CAST(y || '-03-01' AS DATE) END AS period_start, CASE WHEN f = 0 THEN a + 6 WHEN f IN (1, 2, 3) THEN last_day(m) WHEN f = 6 THEN CAST(y || '-05-31' AS DATE) END AS period_end,
CASE f WHEN 4 THEN 'sub-month date' WHEN 5 THEN 'relative time' WHEN 7 THEN 'open window' END AS error FROM o""")
def fdat3(spark, d):
    """Windows of requests that are written in several ways, made from orders' dates."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.date_format(F.date_add("o_orderdate", 6), "yyyy-MM-dd").alias("e"), F.date_format("o_orderdate", "MMMM").alias("m"),
        F.date_format("o_orderdate", "yyyy").alias("y"), F.date_format("o_orderdate", "MM").alias("mm"), F.get(F.array(*map(F.lit, T.CJK_MONTHS)), F.month("o_orderdate") - 1).alias("k"),
    )
    return o.select("o_orderkey", T.request_window(F.expr(_REQUEST)).alias("w")).select("o_orderkey", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), F.col("w.error").alias("error"))


@query("fdat4_freshness", "SELECT event_id, ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AS fresh FROM events")
def fdat4(spark, d):
    return table(spark, d, "events").select("event_id", T.fresh(F.col("ts").cast("timestamp"), "2024-01-31 00:00:00", 7).alias("fresh"))


@query("fmth2_difference", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_tax AS DECIMAL(10, 4)) - CAST(l_discount AS DECIMAL(10, 4)) AS DOUBLE) AS diff, CAST(sign(CAST(l_tax AS DECIMAL(10, 4)) - CAST(l_discount AS DECIMAL(10, 4))) AS INT) AS direction FROM lineitem")
def fmth2(spark, d):
    a, b = F.col("l_discount").cast("decimal(10,4)"), F.col("l_tax").cast("decimal(10,4)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.difference(b, a).cast("double").alias("diff"), N.direction(b, a).alias("direction"))


@query("fmth4_tolerance", f"WITH {SP} SELECT store_id, period_month, CASE WHEN entry_users IS NULL AND search_exposure_users IS NULL THEN true WHEN entry_users IS NULL OR search_exposure_users IS NULL THEN false ELSE abs(entry_users - search_exposure_users) <= 500 END AS close FROM sp")
def fmth4(spark, d):
    return store_period(spark, d).select("store_id", "period_month", N.close("entry_users", "search_exposure_users", 500).alias("close"))


@query("farr1_error_arrays", f"WITH {DIRTY} SELECT {ERR_SQL} AS errors, count(*) AS n FROM dirty GROUP BY 1")
def farr1(spark, d):
    return checked(spark, d).groupBy(F.array_join(F.array_distinct("errors"), "; ").alias("errors")).agg(F.count("*").alias("n"))


@query("fjsn1_row_identity", "SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS identity FROM orders")
def fjsn1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.digest("o_orderkey", "o_orderstatus", "o_orderpriority").alias("identity"))


@query("fjsn2_corpus_digest", f"WITH h AS (SELECT source, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), md5(text))) AS h FROM documents) SELECT source, {L.digest_sql('h')} AS digest FROM h GROUP BY source")
def fjsn2(spark, d):
    """A digest of each source that doesn't depend on row order."""
    h = table(spark, d, "documents").select("source", T.digest("doc_id", F.md5("text")).alias("h"))
    return L.set_digest(h, "source", "h").select("source", "digest")
