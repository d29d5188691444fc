"""Retrieval over vectors, evidence review of questions and documents, and the life
of typed facts."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..adapters import SKU, SP, sku_period, store_period, table, tasks
from ..functions import numbers as N, text as T, values as V
from ..operators import beliefs as B, corpus as C, ledger as L, panels as P, quantiles as Q, retrieval as R, review as RV, rules as RU
from ..registry import ORACLES, query
from ..sources import files as S
from .connectors import _MARKDOWN, dictionaries
from .diagnostics import MONTHS
from .review import rac4

THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5]
HITS = """em AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), sc AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label AS q_label, d.label AS d_label, list_cosine_similarity(q.v, d.v) AS s FROM em q JOIN em d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
tk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 5)"""


def hits(spark, d, k=5):
    e = table(spark, d, "embeddings")
    return R.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", k, ["label"])


@query("fmth3_cosine", "WITH em AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM em a JOIN em b ON b.vec_id = a.vec_id + 1")
def fmth3(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(N.cosine("embedding", "other"), 6).alias("score"))


@query("jn11_query_scores", "WITH em AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.v, d.v), 6) AS score FROM em q JOIN em d ON q.vec_id % 100 = 0")
def jn11(spark, d):
    e = table(spark, d, "embeddings")
    return R.scores(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", digits=6)


@query("win5_topk_documents", f"WITH {HITS} SELECT query_id, doc_id, CAST(rank AS INT) AS rank FROM tk")
def win5(spark, d):
    return hits(spark, d).select("query_id", "doc_id", "rank")


@query("win6_score_margin", f"WITH {HITS} SELECT query_id, round(max(s) FILTER (rank = 1) - max(s) FILTER (rank = 2), 6) AS margin FROM tk GROUP BY query_id")
def win6(spark, d):
    m = hits(spark, d, 2).withColumn("next", F.lead("score").over(Window.partitionBy("query_id").orderBy("rank")))
    return m.where("rank = 1").select("query_id", F.round(F.col("score") - F.col("next"), 6).alias("margin"))


@query("rtv2_filtered_topk", "WITH em AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), sc AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_cosine_similarity(q.v, d.v) AS s FROM em q JOIN em d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND d.label < 5) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS INT) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) <= 5")
def rtv2(spark, d):
    e = table(spark, d, "embeddings")
    return R.nearest(e.where("vec_id % 100 = 0"), e.where("label < 5"), "vec_id", "vec_id", "embedding", 5).select("query_id", "doc_id", "rank")


# A query's expectations (null: none), from its label: entity, slot, period; some can't be met.
_WANTS = {"entity": "CASE WHEN q_label % 3 <> 0 THEN q_label END", "slot": "CASE WHEN q_label % 2 = 1 THEN q_label % 5 END", "period": "CASE WHEN q_label % 4 = 0 THEN 1 END"}
_HAS = {"entity": "d_label", "slot": "d_label % 5", "period": "doc_id % 3"}
_MET = " AND ".join(f"(({_WANTS[k]}) IS NULL OR ({_WANTS[k]}) = {_HAS[k]})" for k in _WANTS)


@query("rtv3_contract_hits", f"WITH {HITS}, m AS (SELECT *, q_label % 7 <> 0 AND {_MET} AS met FROM tk) SELECT query_id, bool_or(met) AS hit, count(*) FILTER (met) AS n_hits, min(rank) FILTER (met) AS first_rank FROM m GROUP BY query_id")
def rtv3(spark, d):
    """Hits that meet every expectation of their query; queries that nothing should
    answer have none."""
    h = hits(spark, d)
    cols = {f"expected_{k}": F.expr(e) for k, e in _WANTS.items()} | {f"own_{k}": F.expr(e) for k, e in _HAS.items()}
    return R.contract_hits(h.withColumns(cols).withColumn("negative", F.col("q_label") % 7 == 0), list(_WANTS))


@query("rtv4_score_detail", f"WITH {HITS} SELECT query_id, q_label % 5 AS case_type, round(max(s), 6) AS top1, bool_or(q_label = d_label) AS hit FROM tk GROUP BY ALL")
def rtv4(spark, d):
    return hits(spark, d).groupBy("query_id", (F.col("q_label") % 5).alias("case_type")).agg(F.round(F.max("score"), 6).alias("top1"), F.bool_or(F.col("q_label") == F.col("d_label")).alias("hit"))


_TOP = f"WITH {HITS}, t1 AS (SELECT query_id, CAST(q_label % 5 AS INT) AS case_type, round(s, 6) AS s, q_label = d_label AS hit FROM tk WHERE rank = 1)"


def _top1(spark, d):
    return hits(spark, d, 1).select("query_id", (F.col("q_label") % 5).alias("case_type"), F.round("score", 6).alias("s"), (F.col("q_label") == F.col("d_label")).alias("hit"))


@query("agg18_percentiles", f"{_TOP} SELECT case_type, round(quantile_cont(s, 0.25), 5) AS p25, round(quantile_cont(s, 0.5), 5) AS p50, round(quantile_cont(s, 0.75), 5) AS p75, min(s) AS least, max(s) AS most FROM t1 GROUP BY case_type")
def agg18(spark, d):
    path = S.fresh_path(spark, "hits")  # read three times, searched once
    _top1(spark, d).write.parquet(path)
    hit = spark.read.parquet(path)
    found = Q.percentiles(hit, ["case_type"], "s", [0.25, 0.5, 0.75]).withColumn("s", F.round("s", 5))
    at = lambda p: F.max(F.when(F.col("p") == p, F.col("s"))).alias(f"p{int(100 * p)}")
    ends = hit.groupBy("case_type").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    return found.groupBy("case_type").agg(*map(at, (0.25, 0.5, 0.75))).join(ends, "case_type")


@query("agg19_threshold_proposal", f"{_TOP} SELECT round((quantile_cont(s, 0.25) FILTER (case_type = 0) + quantile_cont(s, 0.75) FILTER (case_type = 1)) / 2, 5) AS threshold FROM t1")
def agg19(spark, d):
    found = Q.percentiles(_top1(spark, d).where("case_type in (0, 1)"), ["case_type"], "s", [0.25, 0.75])
    at = lambda c, p: F.max(F.when((F.col("case_type") == c) & (F.col("p") == p), F.col("s")))
    return found.agg(F.round((at(0, 0.25) + at(1, 0.75)) / 2, 5).alias("threshold"))


@query("agg20_threshold_sweep", f"{_TOP}, th AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}]) AS t) SELECT CAST(t AS DOUBLE) AS threshold, case_type, count(*) FILTER (s >= t) AS above, count(*) AS n, count(*) FILTER (s >= t AND hit) AS hits_kept FROM t1 CROSS JOIN th GROUP BY ALL")
def agg20(spark, d):
    t = _top1(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    return t.groupBy("threshold", "case_type").agg(F.count_if(F.col("s") >= F.col("threshold")).alias("above"), F.count("*").alias("n"), F.count_if((F.col("s") >= F.col("threshold")) & F.col("hit")).alias("hits_kept"))


_VAR = "WITH em AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT vec_id, label, 'original' AS variant, v FROM em WHERE vec_id % 100 = 0 UNION ALL SELECT vec_id, label, 'shorten', list_transform(v, lambda x, i: CASE WHEN i <= 48 THEN x ELSE 0.0 END) FROM em WHERE vec_id % 100 = 0), sc AS (SELECT q.vec_id AS query_id, q.variant, q.label AS ql, d.vec_id AS doc_id, d.label AS dl, list_cosine_similarity(q.v, d.v) AS s FROM q JOIN em d ON q.vec_id <> d.vec_id), t1 AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY s DESC, doc_id) = 1), ch AS (SELECT b.query_id, a.doc_id <> b.doc_id AS changed, round(b.s - a.s, 6) AS delta, b.ql = b.dl AS hit FROM t1 a JOIN t1 b ON a.query_id = b.query_id AND a.variant = 'original' AND b.variant = 'shorten')"


def _variants(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0")
    short = q.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < 48, x).otherwise(F.lit(0.0).cast("float"))))
    first = lambda x, n: R.nearest(x, e, "vec_id", "vec_id", "embedding", 1, ["label"]).select("query_id", F.col("doc_id").alias(f"doc_{n}"), F.col("score").alias(f"score_{n}"), (F.col("q_label") == F.col("d_label")).alias(f"hit_{n}"))
    both = first(q, "a").join(first(short, "b"), "query_id")
    return both.select("query_id", (F.col("doc_a") != F.col("doc_b")).alias("changed"), F.round(F.col("score_b") - F.col("score_a"), 6).alias("delta"), F.col("hit_b").alias("hit"))


@query("win7_variant_change", f"{_VAR} SELECT query_id, changed, delta FROM ch")
def win7(spark, d):
    return _variants(spark, d).select("query_id", "changed", "delta")


@query("rtv5_wording_robustness", f"{_VAR} SELECT * FROM ch")
def rtv5(spark, d):
    return _variants(spark, d)


@query("agg21_robustness_summary", f"{_VAR} SELECT count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (changed) AS changed FROM ch")
def agg21(spark, d):
    return _variants(spark, d).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("changed").alias("changed"))


@query("srt5_top1_gate", f"""WITH {HITS}, g AS (SELECT query_id, max(s) FILTER (rank = 1 AND query_id % 300 <> 0) AS a, max(s) FILTER (rank = 2 AND query_id % 300 <> 0) AS b FROM tk GROUP BY 1)
SELECT query_id, coalesce(a >= 0.60 AND (b IS NULL OR a >= 0.92 OR a - b >= 0.05), query_id % 200 = 0) AS passes FROM g""")
def srt5(spark, d):
    """Every third query has no hits on purpose, and every second one is a typed message."""
    found = hits(spark, d, 2).where("query_id % 300 <> 0").groupBy("query_id").agg(*(F.max(F.when(F.col("rank") == r, F.col("score"))).alias(f"top{r}") for r in (1, 2)))
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % 200 == 0).alias("typed"))
    return R.gated(asked, found)


#: Slots of facts with their confidence and fields; the list slot also has the top items.
FACT_SLOTS = [
    ("visibility_entry", "high", ["exposure_users", "entry_users", "entry_conversion_rate_pct"]), ("activity_lever", "high", ["activity_orders", "activity_cost", "activity_cost_ratio_pct"]),
    ("transaction_conversion", "high", ["transaction_amount", "transaction_orders", "order_conversion_rate_pct"]), ("top3_sku_product_mix", "medium", ["transaction_amount"]),
    ("single_metric_attribution_guard", "high", ["order_users", "payment_users"]),
]
LISTING = "top3_sku_product_mix"
_DEC = "CAST(CAST(round({f} + 1e-9, 2) AS DECIMAL(20, 2)) AS {t})"
_JSON = lambda fs, more="", t="VARCHAR": "concat('{', " + ", ', ', ".join(f"""'"{f}": ', coalesce({_DEC.format(f=f, t=t)}, 'null')""" for f in fs) + more + ", '}')"
_ITEMS = """, ', "top_items": [', items, ']'"""
_FACTS = " UNION ALL ".join(
    f"SELECT store_id, period_month, '{s}' AS slot, '{c}' AS confidence, '{','.join(fs)}' AS source_fields, {_JSON(fs, _ITEMS if s == LISTING else '')} AS observed_values FROM ft" for s, c, fs in FACT_SLOTS
)
_FT = f"""{SP}, {SKU}, it AS (SELECT store_id, period_start, string_agg('"' || sku_name || ' ' || sales_volume || '"', ', ' ORDER BY sku_rank) AS items, count(*) AS n_items FROM sku WHERE sku_rank <= 3 GROUP BY ALL), ft AS (SELECT sp.*, coalesce(items, '') AS items, coalesce(n_items, 0) AS n_items FROM sp LEFT JOIN it USING (store_id, period_start))"""


def fact_slots(panel, skus, top: int = 3, parts: int | None = None):
    """Five facts of each store-period: observed values as JSON, their fields and the
    confidence. A value is written with two decimals, a missing one as null. parts: tasks
    among which the store-periods are dealt."""
    keys = ["store_id", "period_start"]
    item = F.concat(F.lit('"'), "sku_name", F.lit(" "), F.col("sales_volume").cast("string"), F.lit('"'))
    lists = P.dealt(skus.where(F.col("sku_rank") <= top), parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sku_rank", item.alias("item")))).alias("l"))
    items = F.coalesce(F.array_join(F.transform("l", lambda x: x["item"]), ", "), F.lit(""))
    p = P.dealt(panel, parts, *keys).join(lists, keys, "left").withColumn("items", items)
    json = lambda s, fs: F.expr(_JSON(fs, _ITEMS if s == LISTING else "", "STRING"))
    rows = (F.struct(F.lit(s).alias("slot"), F.lit(c).alias("confidence"), F.lit(",".join(fs)).alias("source_fields"), json(s, fs).alias("observed_values")) for s, c, fs in FACT_SLOTS)
    return p.select("store_id", "period_month", F.inline(F.array(*rows)))


@query("agg15_fact_slots", f"WITH {_FT} {_FACTS}")
def agg15(spark, d):
    return fact_slots(store_period(spark, d), sku_period(spark, d), parts=tasks(spark, d))


_SEEN = " UNION ALL ".join(f"SELECT store_id, period_month, n_items, '{s}' AS slot, '{f}' AS field, {f} IS NULL AS gone FROM ft" for s, _, fs in FACT_SLOTS for f in fs)


@query("rtv1_corpus_units", f"""WITH {_FT}, f AS ({_FACTS}), c AS (SELECT unnest(string_split(text, chr(10))) AS c FROM documents),
u AS (SELECT 'chunk' AS kind, length(trim(c)) AS n FROM c WHERE length(trim(c)) >= 80 UNION ALL SELECT 'question', length(text) FROM benchmark
UNION ALL SELECT 'fact', length(concat_ws(chr(10), 'store: ' || store_id, 'month: ' || period_month, 'slot: ' || slot, 'confidence: ' || confidence, 'fields: ' || source_fields, observed_values)) FROM f)
SELECT kind, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_chars FROM u GROUP BY kind""")
def rtv1(spark, d):
    """The corpus of a retrieval index: chunks of documents, questions and facts as text."""
    c = table(spark, d, "documents").select(F.explode(F.split("text", "\n", -1)).alias("text")).select(F.lit("chunk").alias("kind"), F.char_length(F.trim("text")).alias("n")).where("n >= 80")
    q = table(spark, d, "benchmark").select(F.lit("question").alias("kind"), F.char_length("text").alias("n"))
    f = agg15(spark, d).select(F.lit("fact").alias("kind"), F.char_length(T.fact_text()).alias("n"))
    return c.unionByName(q).unionByName(f).groupBy("kind").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_chars"))


_CORPUS = f"""WITH {_FT}, f AS ({_FACTS}), {_MARKDOWN}
SELECT store_id || '|' || period_month || '|' || slot AS doc_id, 'generated_memory_fact' AS doc_type, 'facts/panel.json' AS source_file, store_id AS entity_id, slot, period_month AS period_label,
 md5(concat_ws(chr(10), 'source_file: facts/panel.json', 'fact_id: ' || store_id || '|' || period_month || '|' || slot, 'kind: ', 'type: ', 'entity_id: ' || store_id, 'slot: ' || slot, 'period_label: ' || period_month, 'period_start: ', 'period_end: ', 'value: ',
 'observed_values: ' || observed_values, 'calculation: ', 'source_fields: ["' || replace(source_fields, ',', '","') || '"]', 'source_path: ', 'supporting_source_paths: []', 'lineage_path: ', 'confidence: ' || confidence, 'limitations: []', 'is_active: ', 'period: ' || period_month)) AS h FROM f
UNION ALL SELECT doc_id, doc_type, source_file, '', slot, '', md5(text) FROM md"""


def corpus(spark, d):
    """Every fact of the panel and every unit of the dictionaries in one schema."""
    named = F.concat_ws("|", "store_id", "period_month", "slot").alias("fact_id")
    fields = F.split("source_fields", ",").alias("source_fields")
    facts = agg15(spark, d).select(named, F.col("store_id").alias("entity_id"), "slot", F.col("period_month").alias("period"), fields, "observed_values", "confidence")
    return C.units([C.fact_units(facts, "facts/panel.json")], dictionaries(spark, d))


@query("rtv1_corpus_documents", _CORPUS)
def rtv1_documents(spark, d):
    return corpus(spark, d).select("doc_id", "doc_type", "source_file", "entity_id", "slot", "period_label", F.md5("text").alias("h"))


@query("fstr13_fact_text", f"WITH {_FT}, f AS ({_FACTS}) SELECT store_id, period_month, slot, md5(concat_ws(chr(10), 'store: ' || store_id, 'month: ' || period_month, 'slot: ' || slot, 'confidence: ' || confidence, 'fields: ' || source_fields, observed_values)) AS h FROM f")
def fstr13(spark, d):
    return agg15(spark, d).select("store_id", "period_month", "slot", F.md5(T.fact_text()).alias("h"))


DECLARED = ["exposure_users", "entry_users", "entry_conversion_rate_pct", "activity_orders", "activity_cost", "activity_cost_ratio_pct", "transaction_amount", "transaction_orders", "order_conversion_rate_pct", "order_users", "payment_users"]


@query("val19_fact_contract", f"""WITH {_FT}, f AS ({_FACTS}) SELECT store_id, period_month, slot, CASE right(store_id, 1) WHEN '1' THEN 'confidence of slot' WHEN '2' THEN 'slot; confidence of slot' WHEN '3' THEN 'undeclared field: weather' WHEN '4' THEN 'empty: observed_values' WHEN '5' THEN 'empty: source_fields' WHEN '6' THEN 'empty: period_month; period' ELSE '' END AS errors
FROM (SELECT store_id, CASE WHEN store_id LIKE '%6' THEN '' ELSE period_month END AS period_month, CASE WHEN store_id LIKE '%2' THEN 'mood' ELSE slot END AS slot FROM f)""")
def val19(spark, d):
    """Facts, some of them damaged on purpose, against their contract."""
    ends, own = lambda x: F.col("store_id").endswith(x), F.col
    f = agg15(spark, d).withColumns({
        "confidence": F.when(ends("1"), "low").otherwise(own("confidence")), "slot": F.when(ends("2"), "mood").otherwise(own("slot")),
        "source_fields": F.when(ends("3"), F.concat("source_fields", F.lit(",weather"))).when(ends("5"), "").otherwise(own("source_fields")),
        "observed_values": F.when(ends("4"), "").otherwise(own("observed_values")), "period_month": F.when(ends("6"), "").otherwise(own("period_month")),
    })
    return f.select("store_id", "period_month", "slot", RV.fact_errors({s: c for s, c, _ in FACT_SLOTS}, DECLARED).alias("errors"))


#: Slots by keyword; further phrases come from the table itself.
KEYWORDS = [("visibility", "the"), ("visibility", "der"), ("activity", "of"), ("activity", "und"), ("conversion", "and"), ("conversion", "les"), ("comparison", "of the"), ("comparison", "in the")]
_KEYWORDS = ", ".join(f"('{s}', '{t}')" for s, t in KEYWORDS)


@query("rtv6_slot_inference", rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark),
kw AS (SELECT * FROM (VALUES {_KEYWORDS}) AS k(slot, term) UNION SELECT 'opening', array_to_string(ws[1:3], ' ') FROM b WHERE item_id % 10 = 0 AND len(ws) > 0),
p AS (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS place FROM b),
g AS (SELECT item_id, place, array_to_string(ws[place:place + n - 1], ' ') AS term FROM p, (VALUES (1), (2), (3)) AS s(n) WHERE place + n - 1 <= len(ws)),
m AS (SELECT item_id, slot, min(place) AS place FROM g JOIN kw USING (term) GROUP BY ALL)
SELECT b.item_id, coalesce(string_agg(slot, ',' ORDER BY place, slot), '') AS slots FROM b LEFT JOIN m USING (item_id) GROUP BY b.item_id""")
def rtv6(spark, d):
    """The slots of each item in order of first mention, by a keyword table: some terms
    of one or two words, and the first three words of every tenth item."""
    items = table(spark, d, "benchmark")
    opening = items.where("item_id % 10 = 0").select(F.lit("opening").alias("slot"), F.concat_ws(" ", F.slice(RU.tokens(F.col("text")), 1, 3)).alias("term")).where("term <> ''")
    keywords = spark.createDataFrame(KEYWORDS, "slot string, term string").unionByName(opening)
    return RU.slots(items, "item_id", "text", keywords).select("item_id", F.concat_ws(",", "slots").alias("slots"))


@query("lin2_nested_lists", f"""WITH {_FT}, u AS ({_SEEN}),
v AS (SELECT store_id, period_month, slot, field, CASE WHEN store_id LIKE '%6' AND field = 'activity_orders' THEN 'differs' WHEN gone THEN 'both missing' ELSE 'agrees' END AS outcome FROM u
UNION ALL SELECT store_id, period_month, '{LISTING}', 'top_items', CASE WHEN store_id LIKE '%2' AND n_items > 2 THEN 'differs' ELSE 'agrees' END FROM ft)
SELECT slot, field, outcome, count(*) AS n FROM v GROUP BY ALL""")
def lin2(spark, d):
    """Facts, read back from their JSON, against the panel and its top lists, which are
    compared as sorted arrays. Some facts were altered on purpose."""
    panel, skus, n = store_period(spark, d), sku_period(spark, d), tasks(spark, d)
    facts = fact_slots(panel.withColumn("activity_orders", F.col("activity_orders") + F.col("store_id").endswith("6").cast("int")), skus.where(~(F.col("store_id").endswith("2") & (F.col("sku_rank") == 3))), parts=n)
    return L.facts_checked(facts, panel, skus, {s: fs for s, _, fs in FACT_SLOTS}, LISTING, 0.011, parts=n).groupBy("slot", "field", "outcome").agg(F.count("*").alias("n"))


LIMITS = {"visibility_entry": ["no cause is inferred", "users may be counted twice"], "transaction_conversion": ["no cause is inferred", "one store"], "top3_sku_product_mix": ["top items only", "one store"]}
_LV = ", ".join(f"('{s}', {list(ls)!r})" for s, ls in LIMITS.items())


@query("rtv9_answers", f"""WITH {_FT}, f AS ({_FACTS}), c AS (SELECT f.*, limits FROM f JOIN (VALUES {_LV}) AS v(slot, limits) USING (slot)),
a AS (SELECT store_id, period_month, string_agg(slot || ' ' || observed_values, '; ' ORDER BY slot) AS answer, flatten(list(limits ORDER BY slot)) AS l FROM c GROUP BY store_id, period_month)
SELECT store_id, period_month, answer, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS limitations FROM a""")
def rtv9(spark, d):
    """Each store's selected facts of each month in slot order, then their distinct
    limitations."""
    limits = spark.createDataFrame([(s, ls) for s, ls in LIMITS.items()], "slot string, limits array<string>")
    facts = agg15(spark, d).join(limits, "slot")
    g = facts.groupBy("store_id", "period_month").agg(F.array_sort(F.collect_list(F.struct("slot", "observed_values", "limits"))).alias("f"))
    answer = F.array_join(F.transform("f", lambda x: F.concat_ws(" ", x.slot, x.observed_values)), "; ")
    return g.select("store_id", "period_month", answer.alias("answer"), F.array_join(F.array_distinct(F.flatten(F.transform("f", lambda x: x.limits))), "; ").alias("limitations"))


LINES = "ln AS (SELECT doc_id, unnest(range(0, len(ls))) AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), hl AS (SELECT *, contains(lower(line), 'the') AS hit FROM ln)"


def _lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.withColumn("hit", T.contains_any("line", ["the"]))


@query("win11_snippet_context", f"WITH {LINES}, c AS (SELECT doc_id, n, hit, lag(length(line)) OVER w AS before, lead(length(line)) OVER w AS after FROM hl WINDOW w AS (PARTITION BY doc_id ORDER BY n)) SELECT doc_id, n, before, after FROM c WHERE hit")
def win11(spark, d):
    w = Window.partitionBy("doc_id").orderBy("n")
    c = _lines(spark, d).withColumns({"before": F.lag(F.char_length("line")).over(w).cast("bigint"), "after": F.lead(F.char_length("line")).over(w).cast("bigint")})
    return c.where("hit").select("doc_id", F.col("n").cast("bigint").alias("n"), "before", "after")


_CHECK = f"WITH {SP}, a AS (SELECT store_id, transaction_amount AS x FROM sp WHERE period_month = '1996-01'), b AS (SELECT store_id, transaction_amount AS y FROM sp WHERE period_month = '1996-02'), c AS (SELECT coalesce(a.store_id, b.store_id) AS store_id, CASE WHEN x IS NULL OR y IS NULL THEN 'unresolved' ELSE 'compare' END AS kind, CAST(sign(y - x) AS INT) AS direction FROM a FULL JOIN b ON a.store_id = b.store_id)"


def _checks(spark, d):
    p = store_period(spark, d)
    side = lambda m, n: p.where(F.col("period_month") == m).select("store_id", F.col("transaction_amount").alias(n))
    both = side("1996-01", "x").join(side("1996-02", "y"), "store_id", "full_outer")
    return both.select("store_id", F.when(F.col("x").isNull() | F.col("y").isNull(), "unresolved").otherwise("compare").alias("kind"), N.direction("y", "x").alias("direction"))


@query("rac6_record_checks", f"{_CHECK} SELECT * FROM c")
def rac6(spark, d):
    return _checks(spark, d)


OUTCOMES, DRIVER, ACTIVITY = ["transaction_amount", "transaction_orders"], "search_exposure_users", ["activity_cost", "activity_original_transaction_amount"]
FACTORS = {"transaction_amount": "transaction_amount", "transaction_orders": "transaction_orders", DRIVER: "search_exposure", **dict.fromkeys(ACTIVITY, "promotion_intensity")}
ANCHORS = ["the", "der", "password", "licen"]
_BOTH = "a AS (SELECT * FROM sp WHERE period_month = '1996-01'), b AS (SELECT * FROM sp WHERE period_month = '1996-02')"
_MADE = " UNION ALL ".join(
    f"SELECT store_id AS key, '{f}' AS factor, '{c}' AS field, CASE WHEN a.{c} IS NULL OR b.{c} IS NULL THEN 'missing' WHEN a.{c} < 0 OR b.{c} < 0 THEN 'invalid' ELSE 'supported' END AS status, CASE WHEN b.{c} > a.{c} THEN 'increased' WHEN b.{c} < a.{c} THEN 'decreased' WHEN b.{c} = a.{c} THEN 'unchanged' END AS result FROM a FULL JOIN b USING (store_id)"
    for c, f in FACTORS.items()
)
_STORED = " UNION ALL ".join(f"SELECT region_type AS key, '{c}' AS factor, '{c}' AS field, {c} IS NOT NULL AS ok FROM m" for c in OUTCOMES)


def _changes(spark, d):
    """Checks of each store's fields between two months."""
    p = store_period(spark, d)
    side = lambda m, n: p.where(F.col("period_month") == m).select("store_id", *(F.col(c).cast("double").alias(f"{n}_{c}") for c in FACTORS))
    both = side("1996-01", "a").join(side("1996-02", "b"), "store_id", "full_outer")

    def check(field, factor):
        a, b = F.col(f"a_{field}"), F.col(f"b_{field}")
        status = F.when(a.isNull() | b.isNull(), "missing").when((a < 0) | (b < 0), "invalid").otherwise("supported")
        return F.struct(F.lit(factor).alias("factor"), F.lit(field).alias("field"), status.alias("status"), F.when(b > a, "increased").when(b < a, "decreased").when(b == a, "unchanged").alias("result"))

    return both.select(F.col("store_id").alias("key"), F.inline(F.array(*(check(c, f) for c, f in FACTORS.items()))))


def _presence(spark, d):
    """Checks of each region's stores: records of the month and of all three."""
    p = store_period(spark, d).where(F.col("period_month").isin(MONTHS))
    months = p.groupBy("store_id", "region_type").agg(F.count_distinct("period_month").alias("n"), F.max(F.col("period_month") == MONTHS[0]).alias("here"), *(F.max(F.when(F.col("period_month") == MONTHS[0], F.col(c).cast("double"))).alias(c) for c in OUTCOMES))
    row = lambda factor, field, ok: F.struct(F.lit(factor).alias("factor"), F.lit(field).alias("field"), F.when(ok, "supported").otherwise("missing").alias("status"), F.lit(None).cast("string").alias("result"))
    rows = [row("same_reporting_period", "period", F.col("here")), row("repeated_reporting_windows", "months", F.col("n") == len(MONTHS)), *(row(c, c, F.col(c).isNotNull()) for c in OUTCOMES)]
    return months.select(F.col("region_type").alias("key"), F.inline(F.array(*rows)))


def _anchors(spark, d):
    """Checks of each source: whether any of its documents has an anchor."""
    g = table(spark, d, "documents").groupBy(F.col("source").alias("key")).agg(*(F.max(F.coalesce(F.contains(F.lower("text"), F.lit(t)), F.lit(False))).alias(t) for t in ANCHORS))
    row = lambda t: F.struct(F.lit(t).alias("factor"), F.lit(t).alias("field"), F.when(F.col(t), "supported").otherwise("missing").alias("status"), F.lit(None).cast("string").alias("result"))
    return g.select("key", F.inline(F.array(*map(row, ANCHORS))))


_ANCHORED = ", ".join(f"bool_or(contains(lower(coalesce(text, '')), '{t}'))" for t in ANCHORS)


@query("rac7_review_hypotheses", f"""WITH {SP}, {_BOTH}, ch AS ({_MADE}),
w AS (SELECT key, {', '.join(f"max(CASE WHEN field = '{c}' AND status = 'supported' THEN result END) AS r_{c}" for c in FACTORS)}, count(*) FILTER (status <> 'supported') AS n_open, count(*) FILTER (factor = 'promotion_intensity' AND status <> 'supported') AS a_open, count(*) FILTER (factor = 'promotion_intensity' AND result IN ('increased', 'decreased')) AS a_changed FROM ch GROUP BY key),
x AS (SELECT *, {' AND '.join(f'r_{c} IS NOT NULL' for c in OUTCOMES)} AS complete, CASE WHEN {' AND '.join(f'r_{c} IS NOT NULL' for c in OUTCOMES)} AND n_open = 0 THEN 'active' ELSE 'tentative' END AS belief FROM w),
m AS (SELECT store_id, region_type, count(DISTINCT period_month) AS n, bool_or(period_month = '{MONTHS[0]}') AS here, {', '.join(f"max(CASE WHEN period_month = '{MONTHS[0]}' THEN {c} END) AS {c}" for c in OUTCOMES)} FROM sp WHERE period_month IN ({', '.join(map(repr, MONTHS))}) GROUP BY ALL),
pc AS (SELECT region_type AS key, bool_and(here AND {' AND '.join(f'{c} IS NOT NULL' for c in OUTCOMES)}) AS ready, bool_and(n = {len(MONTHS)}) AS repeated FROM m GROUP BY 1),
an AS (SELECT source AS key, list_bool_and([{_ANCHORED}]) AS whole FROM documents GROUP BY 1)
SELECT 'causal' AS kind, key, 'H1' AS hypothesis, CASE WHEN complete THEN 'strong' ELSE 'unsupported' END AS status, belief FROM x
UNION ALL SELECT 'causal', key, 'H2', CASE WHEN NOT complete OR r_{DRIVER} IS NULL THEN 'unsupported' WHEN r_{DRIVER} <> 'unchanged' AND {' AND '.join(f'r_{c} = r_{DRIVER}' for c in OUTCOMES)} THEN 'plausible' ELSE 'rejected' END, belief FROM x
UNION ALL SELECT 'causal', key, 'H3', CASE WHEN a_open > 0 THEN 'unsupported' WHEN a_changed > 0 THEN 'plausible' ELSE 'weak' END, belief FROM x
UNION ALL SELECT 'comparison', key, h, CASE WHEN ready AND h = 'H1' THEN 'strong' ELSE 'unsupported' END, CASE WHEN ready AND repeated THEN 'active' ELSE 'tentative' END FROM pc CROSS JOIN (VALUES ('H1'), ('H2')) AS v(h)
UNION ALL SELECT 'documents', key, h, CASE WHEN whole AND h = 'H1' THEN 'strong' ELSE 'unsupported' END, CASE WHEN whole THEN 'active' ELSE 'tentative' END FROM an CROSS JOIN (VALUES ('H1'), ('H2')) AS v(h)""")
def rac7(spark, d):
    """Hypotheses and beliefs of questions for causes (by store), of comparisons (by
    region) and of questions that documents answer (by source)."""
    c = B.causal(_changes(spark, d), "key", OUTCOMES, DRIVER, "promotion_intensity")
    p = B.comparison(_presence(spark, d), "key", "same_reporting_period", OUTCOMES, "repeated_reporting_windows")
    kinds = {"causal": c, "comparison": p, "documents": B.documents(_anchors(spark, d), "key")}
    first, *rest = [x.select(F.lit(k).alias("kind"), "key", "hypothesis", "status", "belief") for k, x in kinds.items()]
    for x in rest:
        first = first.unionByName(x)
    return first


_PREMISES = f"{_CHECK} SELECT store_id, CASE WHEN kind = 'unresolved' THEN 'unresolved' WHEN direction > 0 THEN 'premise holds' ELSE 'premise rejected' END AS finding FROM c"


def _premises(spark, d):
    return _checks(spark, d).select("store_id", F.when(F.col("kind") == "unresolved", "unresolved").when(F.col("direction") > 0, "premise holds").otherwise("premise rejected").alias("finding"))


@query("rac8_premise_check", f"""WITH {SP}, {_BOTH}, ch AS ({_MADE}), q AS (SELECT DISTINCT store_id AS key, right(store_id, 1) IN ('0', '2', '4', '6', '8') AS asks, right(store_id, 1) NOT IN ('3', '6', '9') AS causal FROM sp),
g AS (SELECT key, bool_or(field IN ({', '.join(map(repr, OUTCOMES))}) AND status = 'supported' AND result <> 'increased') AS against, count(*) FILTER (status <> 'supported') AS n_open FROM ch GROUP BY 1),
j AS (SELECT q.*, coalesce(asks AND causal AND against, false) AS rejected, coalesce(n_open, 0) AS n_open FROM q LEFT JOIN g USING (key)), f AS (SELECT *, CASE WHEN rejected OR n_open > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS fact_check FROM j)
SELECT key, 0 AS place, 'premise' AS issue, 'high' AS severity, fact_check FROM f WHERE rejected
UNION ALL SELECT key, 1, field, CASE WHEN status = 'invalid' THEN 'high' ELSE 'medium' END, fact_check FROM f JOIN ch USING (key) WHERE status <> 'supported'
UNION ALL SELECT key, 2, CASE WHEN causal THEN 'other explanations' ELSE 'comparability' END, CASE WHEN causal THEN 'high' ELSE 'medium' END, fact_check FROM f""")
def rac8(spark, d):
    """What a critic finds in each store's question, which takes growth for granted in
    every second one."""
    ends = lambda *x: F.substring("store_id", -1, 1).isin(*x)
    kind = F.when(ends("3", "6", "9"), "comparability_judgment").otherwise("causal_diagnostic")
    q = store_period(spark, d).select("store_id").distinct().select(F.col("store_id").alias("key"), kind.alias("kind"), F.when(ends(*"02468"), "Why did sales Increase?").otherwise("What are the increasing figures?").alias("question"))
    return B.findings(_changes(spark, d), q, "key", OUTCOMES)


SECTIONS = [
    ("question", "Did amounts rise?"), ("evidence", "{n_found} of {n_expected} months, {n_repeated} repeated"), ("missing months", "{missing}"), ("missing fields", "{gaps}"),
    ("finding", "{finding}"), ("limits", "One store; no cause is inferred."),
]


def _filled(template: str, value, text):
    """The parts of a template: literals and columns."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [text(template[at : m.start()]), value(m[1])]
        at = m.end()
    return [*out, text(template[at:])]


_BODY = " UNION ALL ".join(
    f"SELECT store_id, {i} AS place, '{n}' AS section, concat({', '.join(_filled(t, lambda c: f'CAST({c} AS VARCHAR)', repr))}) AS body FROM x" for i, (n, t) in enumerate(SECTIONS, 1)
)


@query("rac9_report_sections", f"""WITH r4 AS (SELECT * FROM ({ORACLES['rac4_record_grounding']})), r8 AS (SELECT * FROM ({_PREMISES})),
x AS (SELECT r8.store_id, finding, coalesce(n_expected, 0) AS n_expected, coalesce(n_found, 0) AS n_found, coalesce(n_repeated, 0) AS n_repeated, coalesce(nullif(missing, ''), 'none') AS missing, coalesce(nullif(gaps, ''), 'none') AS gaps FROM r8 LEFT JOIN r4 USING (store_id)), u AS ({_BODY})
SELECT store_id, place, section, body, sha256(string_agg(section || ': ' || body, chr(10) ORDER BY place) OVER (PARTITION BY store_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS report FROM u""")
def rac9(spark, d):
    """A report of each store as ordered section rows, with a digest of the whole."""
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(F.col(c)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    c = _premises(spark, d).join(rac4(spark, d), "store_id", "left").select("store_id", "finding", *map(zero, ("n_expected", "n_found", "n_repeated")), *map(none, ("missing", "gaps")))
    body = lambda t: F.concat(*_filled(t, lambda x: F.col(x).cast("string"), F.lit))
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(n).alias("section"), body(t).alias("body")) for i, (n, t) in enumerate(SECTIONS, 1)))
    c = c.withColumn("rows", rows)
    report = F.sha2(F.array_join(F.transform("rows", lambda x: F.concat_ws(": ", x.section, x.body)), "\n"), 256)
    return c.select("store_id", report.alias("report"), F.inline("rows"))


ANCHORS = {"evidence": r"^[0-9]+ of [0-9]+ months", "finding": "^(premise holds|premise rejected|unresolved)$"}
FORBIDDEN = ["because", "best store"]


@query("rac10_report_gate", f"""WITH r8 AS (SELECT * FROM ({_PREMISES})) SELECT store_id, CASE right(store_id, 1) WHEN '1' THEN 'missing section: limits' WHEN '2' THEN 'forbidden claim: because' WHEN '3' THEN 'empty row: finding; missing anchor: finding'
WHEN '4' THEN 'missing anchor: evidence' WHEN '5' THEN 'repeated section: question' ELSE '' END AS problems FROM r8""")
def rac10(spark, d):
    """Reports, some of them damaged on purpose, against the gate's rules."""
    ends, section = lambda x: F.col("store_id").endswith(x), lambda n: F.col("section") == n
    r = rac9(spark, d).where(~(ends("1") & section("limits")))
    r = r.withColumn("body", F.when(ends("2") & section("limits"), F.concat("body", F.lit(" because"))).when(ends("3") & section("finding"), "").when(ends("4") & section("evidence"), "some months").otherwise(F.col("body")))
    r = r.unionByName(r.where(ends("5") & section("question")))
    return RV.gated_reports(r, "store_id", [n for n, _ in SECTIONS], FORBIDDEN, ANCHORS)


POLICY = [("view", "visibility", True, 7, 0.65), ("click", "interest", True, 3, 0.65), ("purchase", "order", True, 30, 0.65), ("error", "problem", False, 30, 0.60)]
_PV = ", ".join(f"('{a}', '{b}', {str(c).lower()}, {n}, CAST({t} AS DOUBLE))" for a, b, c, n, t in POLICY)
AS_OF = "2024-01-31 00:00:00"
FACTS = f"fa AS (SELECT event_id, user_id, e.event_type, ts, value, coalesce(slot, 'other') AS slot, coalesce(single, false) AS single, coalesce(days, 30) AS days, coalesce(least_score, CAST(0.0 AS DOUBLE)) AS least_score FROM events e LEFT JOIN (VALUES {_PV}) AS p(event_type, slot, single, days, least_score) ON p.event_type = e.event_type), sf AS (SELECT *, CASE WHEN single THEN lead(ts) OVER (PARTITION BY user_id, slot ORDER BY ts, event_id) END AS valid_to FROM fa)"


def facts(spark, d):
    """Events as typed facts, with the policy of their type or the default one."""
    p = spark.createDataFrame(POLICY, "event_type string, slot string, single boolean, days int, least_score double")
    j = table(spark, d, "events").join(F.broadcast(p), "event_type", "left")
    return j.select("event_id", "user_id", "event_type", "ts", "value", F.coalesce("slot", F.lit("other")).alias("slot"), F.coalesce("single", F.lit(False)).alias("single"), F.coalesce("days", F.lit(30)).alias("days"), F.coalesce("least_score", F.lit(0.0)).alias("least_score"))


@query("jn13_fact_policy", f"WITH {FACTS} SELECT event_id, slot, single, days FROM fa")
def jn13(spark, d):
    return facts(spark, d).select("event_id", "slot", "single", "days")


@query("mem1_message_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) >= 20 AND NOT regexp_matches(text, '\\?\\s*$')")
def mem1(spark, d):
    c = table(spark, d, "conversations")
    return c.where((F.col("role") == "user") & (F.char_length(F.trim("text")) >= 20) & ~F.col("text").rlike(r"\?\s*$")).select("conv_id", "turn")


@query("mem3_policy_keys", f"WITH {FACTS} SELECT event_id, concat_ws('::', CAST(user_id AS VARCHAR), CASE WHEN single THEN 'product' ELSE 'self' END, slot) AS entity FROM fa")
def mem3(spark, d):
    return facts(spark, d).select("event_id", F.concat_ws("::", F.col("user_id").cast("string"), F.when(F.col("single"), "product").otherwise("self"), "slot").alias("entity"))


def _superseded(spark, d):
    return R.superseded(facts(spark, d), ["user_id", "slot"], F.col("single"), "ts", "event_id")


@query("mem4_supersede", f"WITH {FACTS} SELECT event_id, valid_to, valid_to IS NULL AS active FROM sf")
def mem4(spark, d):
    return _superseded(spark, d).select("event_id", "valid_to", F.col("valid_to").isNull().alias("active"))


@query("mem5_drop_reasons", f"WITH {FACTS} SELECT event_id, CASE WHEN valid_to IS NOT NULL THEN 'inactive' WHEN ts < TIMESTAMP '{AS_OF}' - to_days(days) THEN 'stale' WHEN event_type = 'signup' THEN 'type_mismatch' WHEN value IS NULL THEN 'empty_text' WHEN value / 100 < least_score THEN 'below_score_threshold' END AS reason FROM sf")
def mem5(spark, d):
    stale = ~T.fresh(F.col("ts").cast("timestamp"), AS_OF, F.col("days"))
    why = R.first_reason((F.col("valid_to").isNotNull(), "inactive"), (stale, "stale"), (F.col("event_type") == "signup", "type_mismatch"), (F.col("value").isNull(), "empty_text"), (F.col("value") / 100 < F.col("least_score"), "below_score_threshold"))
    return _superseded(spark, d).select("event_id", why.alias("reason"))


@query("mem6_last_seen", "SELECT user_id, event_type, max(ts) AS last_seen FROM events GROUP BY ALL")
def mem6(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_seen"))


@query("srt4_best_fact", f"WITH {FACTS} SELECT user_id, event_id FROM sf WHERE valid_to IS NULL AND value / 100 >= least_score QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def srt4(spark, d):
    best = _superseded(spark, d).where("valid_to is null and value / 100 >= least_score")
    return best.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("win12_repeated_messages", "WITH m AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM conversations WHERE role = 'user') SELECT conv_id, turn, text = before AS repeated FROM m WHERE before IS NOT NULL")
def win12(spark, d):
    m = table(spark, d, "conversations").where("role = 'user'").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")))
    return m.where("before is not null").select("conv_id", "turn", (F.col("text") == F.col("before")).alias("repeated"))


@query("jn14_label_lookup", f"WITH {LINES}, lb AS (SELECT * FROM (VALUES ('The', 'article'), ('Then', 'time'), ('In', 'place')) AS v(label, kind)), m AS (SELECT doc_id, n, kind, row_number() OVER (PARTITION BY doc_id, n ORDER BY length(label) DESC) AS r FROM ln JOIN lb ON starts_with(line, label || ' ')) SELECT doc_id, n, kind FROM m WHERE r = 1")
def jn14(spark, d):
    """The longest label of a dictionary that a line starts with. The dictionary is a
    parameter, so it is part of the expression and nothing is joined."""
    labels = [("Then", "time"), ("The", "article"), ("In", "place")]
    kind = R.first_reason(*((F.col("line").startswith(a + " "), b) for a, b in sorted(labels, key=lambda x: -len(x[0]))))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), kind.alias("kind")).where("kind is not null")


@query("gate1_comparability", f"WITH {SP} SELECT a.period_month, a.store_id AS l, b.store_id AS r, CASE WHEN a.entry_users IS NULL OR b.entry_users IS NULL THEN 'insufficient_data' WHEN a.store_type <> b.store_type THEN 'context_only' WHEN greatest(a.transaction_amount, b.transaction_amount) > 3 * least(a.transaction_amount, b.transaction_amount) THEN 'not_comparable' ELSE 'comparable' END AS decision FROM sp a JOIN sp b ON a.region_type = b.region_type AND a.period_month = b.period_month AND a.store_id < b.store_id WHERE a.period_month IN ({', '.join(repr(m) for m in MONTHS)})")
def gate1(spark, d):
    """Pairs of one region and requested window: whether they can be compared, by ratio
    bands."""
    s = store_period(spark, d).where(F.col("period_month").isin(MONTHS)).select("period_month", "region_type", "store_id", "store_type", "entry_users", "transaction_amount")
    big, small = F.greatest("a.transaction_amount", "b.transaction_amount"), F.least("a.transaction_amount", "b.transaction_amount")
    verdict = R.first_reason((F.col("a.entry_users").isNull() | F.col("b.entry_users").isNull(), "insufficient_data"), (F.col("a.store_type") != F.col("b.store_type"), "context_only"), (big > 3 * small, "not_comparable"))
    both = P.pairs(s, ["period_month", "region_type"], "store_id")
    return both.select("period_month", F.col("a.store_id").alias("l"), F.col("b.store_id").alias("r"), F.coalesce(verdict, F.lit("comparable")).alias("decision"))
