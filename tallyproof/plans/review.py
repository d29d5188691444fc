"""Evidence review with rule tables: questions, routes, snippets, text reports, facts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..adapters import SKU, SP, sku_period, store_period, stores, table
from ..operators import review as V, rules as RU
from ..registry import query
from .diagnostics import MONTHS

#: Ordered rules of question types, and what a question without a match is.
TYPES = [("comparability_judgment", ["from", "with"]), ("strategic_recommendation", ["that", "what"]), ("technical_design", ["and"])]
DEFAULT = "factual"
BUCKETS = {"high": 0.85, "medium": 0.72, "low": 0.60}
FACTORS = [
    ("comparability_judgment", "transaction_amount", "high"), ("comparability_judgment", "region_type", "medium"), ("comparability_judgment", "product_mix", "low"),
    ("strategic_recommendation", "activity_orders", "high"), ("strategic_recommendation", "transaction_amount", "medium"),
    ("technical_design", "typed_memory", "high"), ("technical_design", "limitations", "low"), ("factual", "transaction_amount", "high"), ("factual", "entry_users", "medium"),
]
#: (question type or None for all, factor, source, role)
ROUTES = [
    (None, "transaction_amount", "panel", "quantitative_evidence"), (None, "entry_users", "panel", "quantitative_evidence"), (None, "region_type", "src0", "context_evidence"),
    (None, "product_mix", "src1", "boundary_evidence"), (None, "activity_orders", "src2", "definition_evidence"), (None, "activity_orders", "gone", "definition_evidence"),
    ("strategic_recommendation", "transaction_amount", "src3", "boundary_evidence"), (None, "typed_memory", "src4", "design_evidence"),
]
KEYWORDS = {"region_type": ["qqqq"], "product_mix": ["the", "der"], "activity_orders": ["of", "que"], "transaction_amount": ["and", "les"], "typed_memory": ["zzzz"]}
LANGUAGE_TERMS = {"en": ["with", "that"], "fr": ["que", "les"], "de": ["der", "und"]}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_STR = lambda x: "NULL" if x is None else f"'{x}'"


def _case(rules, default, text="text"):
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {t!r})' for t in terms)} THEN '{label}'" for label, terms in rules)
    return f"CASE {whens} ELSE {_STR(default)} END"


_K = f"k AS (SELECT item_id, {_case(TYPES, DEFAULT)} AS kind FROM benchmark)"
_F = "f AS (SELECT item_id, kind, factor, weight FROM k JOIN (VALUES " + ", ".join(f"('{k}', '{f}', CAST({BUCKETS[b]} AS DOUBLE))" for k, f, b in FACTORS) + ") AS v(kind, factor, weight) USING (kind))"
_V = "rt AS (SELECT * FROM (VALUES " + ", ".join(f"({_STR(k)}, '{f}', '{s}', '{r}')" for k, f, s, r in ROUTES) + ") AS v(kind, factor, source, role))"
_R = """r AS (SELECT f.*, coalesce(a.source, b.source) AS source, coalesce(a.role, b.role) AS role FROM f LEFT JOIN rt a ON a.kind = f.kind AND a.factor = f.factor
LEFT JOIN rt b ON a.source IS NULL AND b.kind IS NULL AND b.factor = f.factor)"""
ROUTED = f"{_K}, {_F}, {_V}, {_R}"


@query("rac1_question_types", f"WITH {_K} SELECT * FROM k")
def rac1(spark, d):
    return table(spark, d, "benchmark").select("item_id", V.classified(F.col("text"), TYPES, DEFAULT).alias("kind"))


@query("rac2_factor_weights", f"WITH {_K}, {_F} SELECT item_id, factor, weight FROM f")
def rac2(spark, d):
    return V.weighted(rac1(spark, d), FACTORS, BUCKETS).select("item_id", "factor", "weight")


def routed(spark, d):
    return V.routed(V.weighted(rac1(spark, d), FACTORS, BUCKETS), ROUTES)


@query("rac3_evidence_routing", f"WITH {ROUTED} SELECT item_id, factor, source, role, CASE WHEN source IS NULL THEN 'unregistered route: ' || kind || '/' || factor END AS error FROM r")
def rac3(spark, d):
    error = F.when(F.col("source").isNull(), F.concat(F.lit("unregistered route: "), "kind", F.lit("/"), "factor"))
    return routed(spark, d).select("item_id", "factor", "source", "role", error.alias("error"))


_EXPECTED = f"e AS (SELECT s.store_id, m.period_month FROM st s CROSS JOIN (VALUES {', '.join(f'({m!r})' for m in MONTHS)}) AS m(period_month))"
_GAPS = ["entry_users", "search_exposure_users"]
_GAP = ", ".join(f"CASE WHEN {f} IS NULL THEN period_month || ':{f}' END" for f in _GAPS)


@query("rac4_record_grounding", f"""WITH {SP}, {_EXPECTED}, rc AS (SELECT * FROM sp UNION ALL SELECT * FROM sp WHERE store_id LIKE '%5' AND period_month = '{MONTHS[1]}'),
p AS (SELECT store_id, period_month, count(*) AS m, list_filter([{', '.join(f"max(CASE WHEN {f} IS NULL THEN period_month || ':{f}' END)" for f in _GAPS)}], lambda x: x IS NOT NULL) AS g FROM rc GROUP BY ALL),
q AS (SELECT e.store_id, count(*) AS n_expected, count(m) AS n_found, count(*) FILTER (m > 1) AS n_repeated, coalesce(string_agg(CASE WHEN m IS NULL THEN e.period_month END, ',' ORDER BY e.period_month), '') AS missing,
  array_to_string(list_sort(flatten(list(g) FILTER (g IS NOT NULL))), ',') AS gaps FROM e LEFT JOIN p ON p.store_id = e.store_id AND p.period_month = e.period_month GROUP BY e.store_id)
SELECT store_id, n_expected, n_found, n_repeated, missing, coalesce(gaps, '') AS gaps, CASE WHEN n_repeated > 0 THEN 'ambiguous_records' WHEN n_found = 0 THEN 'records_missing' WHEN missing <> '' THEN 'partial_records' WHEN coalesce(gaps, '') <> '' THEN 'missing_fields' ELSE 'record_matched' END AS status FROM q""")
def rac4(spark, d):
    """Expected store-months against a panel in which some are there twice."""
    p = store_period(spark, d).select("store_id", "period_month", *_GAPS)
    p = p.unionByName(p.where(F.col("store_id").endswith("5") & (F.col("period_month") == MONTHS[1])))
    expected = stores(spark, d).select("store_id", F.explode(F.array(*map(F.lit, MONTHS))).alias("period_month"))
    return V.grounded_records(expected, p, ["store_id", "period_month"], "store_id", _GAPS)


_KW = "kw AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {_LIST(v)})" for k, v in LANGUAGE_TERMS.items()) + ") AS v(lang, keywords))"


@query("rac5_keyword_snippets", f"""WITH {_KW}, t AS (SELECT doc_id, text, coalesce(keywords, []) AS keywords FROM documents LEFT JOIN kw USING (lang)),
ln AS (SELECT doc_id, keywords, unnest(range(0, len(ls))) AS n, unnest(ls) AS line, len(ls) AS m FROM (SELECT *, string_split(text, chr(10)) AS ls FROM t)),
h AS (SELECT *, list_filter(keywords, lambda k: contains(lower(line), k)) AS terms, regexp_replace(concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w), '^\\s+|\\s+$', '', 'g') AS shown FROM ln WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM h WHERE len(terms) > 0),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY n) AS p FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM a WHERE p % 2 = 1),
bare AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS kept FROM t WHERE doc_id NOT IN (SELECT doc_id FROM b))
SELECT doc_id, CAST(k AS INT) AS snippet_no, CAST(greatest(0, n - 1) + 1 AS INT) AS line_start, CAST(least(m - 1, n + 1) + 1 AS INT) AS line_end, array_to_string(terms, ',') AS matched_terms, 'keyword_matched' AS status, md5(shown) AS digest FROM b WHERE k <= 3
UNION ALL SELECT doc_id, CASE WHEN len(kept) > 0 THEN 1 END, CASE WHEN len(kept) > 0 THEN 1 END, CASE WHEN len(kept) > 0 THEN CAST(least(8, len(kept)) AS INT) END, '',
CASE WHEN text IS NULL THEN 'source_missing' WHEN len(kept) > 0 THEN 'source_found_no_keyword_match' ELSE 'source_empty' END, CASE WHEN len(kept) > 0 THEN md5(regexp_replace(array_to_string(kept[1:8], chr(10)), '^\\s+|\\s+$', '', 'g')) END FROM bare""")
def rac5(spark, d):
    """Snippets of every document for its language's keywords."""
    terms = spark.createDataFrame(list(LANGUAGE_TERMS.items()), "lang string, keywords array<string>")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").join(terms, "lang", "left")
    docs = docs.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return V.snippets(docs, "doc_id").withColumn("digest", F.md5("text")).drop("text")


def packets(spark, d):
    """Each routed source of each item's factors with its status: the panel has records
    or none; a source's documents are all read, and one with a keyword is enough."""
    named = {f: F.coalesce(F.max(V.any_of(F.lower("text"), terms)), F.lit(False)) for f, terms in KEYWORDS.items()}
    by = table(spark, d, "documents").groupBy("source").agg(F.count("text").alias("n"), F.count_if(F.col("text").rlike(r"\S")).alias("filled"), F.array(*(F.struct(F.lit(f).alias("factor"), m.alias("matched")) for f, m in named.items())).alias("m"))
    found = by.select("source", "n", "filled", F.inline("m"))
    asked = spark.createDataFrame([(s, f) for s, f in sorted({(s, f) for _, f, s, _ in ROUTES if s != "panel"})], "source string, factor string")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "source_missing").when(F.col("matched"), "keyword_matched").when(F.col("filled") == 0, "source_empty").otherwise("source_found_no_keyword_match")
    status = asked.join(by.select("source", "n", "filled"), "source", "left").join(found.select("source", "factor", "matched"), ["source", "factor"], "left").select("source", "factor", status.alias("status"))
    panel = store_period(spark, d).limit(1).agg(F.count("*").alias("n")).select(F.lit("panel").alias("source"), F.when(F.col("n") > 0, "record_matched").otherwise("source_missing").alias("panel_status"))
    out = routed(spark, d).where("source is not null").join(status, ["source", "factor"], "left").join(panel, "source", "left")
    own = F.when((F.col("role") == "boundary_evidence") & (F.col("status") == "keyword_matched"), "boundary_matched").otherwise(F.col("status"))
    return out.select("item_id", "factor", "source", "role", F.coalesce("panel_status", own).alias("status"))


_HAS = " OR ".join(f"(r.factor = '{f}' AND h{i})" for i, f in enumerate(KEYWORDS))
_MET = ", ".join(f"bool_or({' OR '.join(f'contains(lower(text), {t!r})' for t in terms)}) AS h{i}" for i, terms in enumerate(KEYWORDS.values()))
PACKETS = rf"""{ROUTED}, s AS (SELECT source, count(text) AS n_text, count(*) FILTER (regexp_matches(text, '\S')) AS filled, {_MET} FROM documents GROUP BY source),
pk AS (SELECT r.item_id, r.factor, r.source, r.role, CASE WHEN r.source = 'panel' THEN 'record_matched' WHEN coalesce(n_text, 0) = 0 THEN 'source_missing' WHEN {_HAS} THEN CASE WHEN r.role = 'boundary_evidence' THEN 'boundary_matched' ELSE 'keyword_matched' END
  WHEN filled = 0 THEN 'source_empty' ELSE 'source_found_no_keyword_match' END AS status FROM r LEFT JOIN s ON s.source = r.source WHERE r.source IS NOT NULL)"""


@query("agg16_role_counts", f"WITH {PACKETS} SELECT role, status, count(*) AS n, count(DISTINCT item_id) AS n_items FROM pk GROUP BY role, status")
def agg16(spark, d):
    return packets(spark, d).groupBy("role", "status").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


_N = lambda s: f"count(*) FILTER (status = '{s}')"


@query("agg17_coverage_score", f"""WITH {PACKETS}, g AS (SELECT item_id, count(*) AS total, {_N('record_matched')} AS records, {_N('keyword_matched')} AS keywords, {_N('boundary_matched')} AS boundaries, {_N('source_found_no_keyword_match')} AS fallbacks, {_N('source_missing')} AS missing FROM pk GROUP BY item_id)
SELECT *, round(CAST(0.45 AS DOUBLE) * (records + keywords) / total + CAST(0.25 AS DOUBLE) * (records + keywords + boundaries) / total + CAST(0.15 AS DOUBLE) * CAST(missing = 0 AS INT) + CAST(0.15 AS DOUBLE) * CAST(fallbacks = 0 AS INT), 4) AS score FROM g""")
def agg17(spark, d):
    return V.coverage_score(packets(spark, d), "item_id")


_SCORE = "CASE status " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.STATUS_SCORES.items()) + " ELSE 0 END"


@query("srt3_best_source", f"WITH {PACKETS} SELECT item_id, factor, source, status FROM pk QUALIFY row_number() OVER (PARTITION BY item_id, factor ORDER BY {_SCORE} DESC, status <> 'source_missing' DESC, source) = 1")
def srt3(spark, d):
    """The best candidate source of each item's factor: by status, then one that exists,
    then by name."""
    best = F.min_by(F.struct("source", "status"), F.struct(-V.status_score(F.col("status")), F.col("status") == "source_missing", F.col("source")))
    return packets(spark, d).groupBy("item_id", "factor").agg(best.alias("b")).select("item_id", "factor", "b.source", "b.status")


@query("srt6_evidence_limit", f"WITH {ROUTED} SELECT item_id, count(*) > 2 AS refused FROM r GROUP BY item_id")
def srt6(spark, d):
    return routed(spark, d).groupBy("item_id").agg((F.count("*") > 2).alias("refused"))


@query("agg23_report_totals", f"WITH {ROUTED} SELECT factor, count(*) AS n, count(DISTINCT item_id) AS n_items FROM r GROUP BY GROUPING SETS ((factor), ())")
def agg23(spark, d):
    return routed(spark, d).rollup("factor").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query("rac11_state_integrity", f"""WITH {PACKETS}, w AS (SELECT item_id, factor FROM f UNION ALL SELECT item_id, factor FROM f WHERE item_id % 13 = 2 AND factor = 'transaction_amount'),
a AS (SELECT item_id, factor, count(*) AS nw FROM w GROUP BY ALL), b AS (SELECT item_id, factor, count(*) AS np FROM pk GROUP BY ALL)
SELECT item_id, count(*) FILTER (nw > 1) AS repeated_weights, count(*) FILTER (np IS NULL) AS factors_without_packet, count(*) FILTER (np > 1) AS factors_with_several, count(*) FILTER (nw IS NULL) AS dangling_packets FROM a FULL JOIN b USING (item_id, factor) GROUP BY item_id""")
def rac11(spark, d):
    """Each factor of an item must have one weight and one packet, and each packet a
    factor; some weights are there twice on purpose."""
    w = rac2(spark, d).select("item_id", "factor")
    w = w.unionByName(w.where("item_id % 13 = 2 and factor = 'transaction_amount'"))
    count = lambda x, n: x.groupBy("item_id", "factor").agg(F.count("*").alias(n))
    both = count(w, "nw").join(count(packets(spark, d), "np"), ["item_id", "factor"], "full_outer")
    n = lambda c: F.count_if(c)
    return both.groupBy("item_id").agg(
        n(F.col("nw") > 1).alias("repeated_weights"), n(F.col("np").isNull()).alias("factors_without_packet"),
        n(F.col("np") > 1).alias("factors_with_several"), n(F.col("nw").isNull()).alias("dangling_packets"),
    )


#: Refusal rules: name, priority, reason; and what a message must and mustn't have. Terms
#: with @ are conditions on the request: who asks, how far on, and how long.
REFUSALS = [
    ("period_late", 1, "other_period"), ("period_word", 1, "other_period"), ("entity_pair", 2, "other_entity"), ("entity_list", 2, "other_entity"),
    ("personal", 3, "personal_data"), ("personal_own", 3, "personal_data"), ("cause", 4, "causal_claim"), ("cause_of", 4, "causal_claim"),
    ("rank", 5, "ranking"), ("rank_all", 5, "ranking"), ("forecast", 6, "forecast"), ("forecast_late", 6, "forecast"),
    ("scope", 7, "out_of_scope"), ("scope_wide", 7, "out_of_scope"), ("advice", 8, "advice"), ("advice_long", 8, "advice"),
    ("empty_request", 9, "nothing_asked"), ("short_reply", 9, "nothing_asked"), ("unsure", 10, "unclear"), ("unsure_long", 10, "unclear"),
]
REFUSAL_PARTS = [
    ("period_late", "all", "@late"), ("period_late", "all", "from"), ("period_late", "none", "was"), ("period_word", "all", "at"), ("period_word", "any", "from"), ("period_word", "any", "by"), ("period_word", "none", "the"),
    ("entity_pair", "all", "and"), ("entity_pair", "all", "with"), ("entity_pair", "none", "be"), ("entity_list", "all", "of the"), ("entity_list", "any", "for"), ("entity_list", "any", "with"), ("entity_list", "none", "that"),
    ("personal", "all", "you"), ("personal", "none", "@assistant"), ("personal_own", "any", "his"), ("personal_own", "any", "their"), ("cause", "any", "because"), ("cause", "any", "as the"), ("cause", "none", "this"),
    ("cause_of", "all", "of"), ("cause_of", "all", "is"), ("cause_of", "none", "it"), ("cause_of", "none", "be"), ("rank", "all", "in the"), ("rank", "none", "a"), ("rank_all", "any", "best"), ("rank_all", "any", "most"),
    ("forecast", "any", "will"), ("forecast", "any", "to be"), ("forecast_late", "all", "@late"), ("forecast_late", "all", "to"), ("forecast_late", "none", "the"), ("scope", "all", "@assistant"), ("scope", "all", "a"), ("scope", "none", "of"),
    ("scope_wide", "all", "all"), ("advice", "all", "with the"), ("advice_long", "all", "@long"), ("advice_long", "all", "was"), ("advice_long", "none", "to"),
    ("empty_request", "none", "the"), ("empty_request", "none", "of"), ("empty_request", "none", "and"), ("short_reply", "all", "@assistant"), ("short_reply", "none", "@long"), ("short_reply", "none", "to"),
    ("unsure", "any", "or"), ("unsure", "any", "it is"), ("unsure_long", "all", "@long"), ("unsure_long", "none", "@assistant"),
]
_rows = lambda rows: ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)
_IS = "CASE term WHEN '@assistant' THEN role = 'assistant' WHEN '@late' THEN turn >= 4 WHEN '@long' THEN len(ws) > 40 ELSE contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || term || ' ') END"


@query("rtv8_refusals", rf"""WITH c AS (SELECT conv_id, turn, role, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM conversations),
r AS (SELECT * FROM (VALUES {_rows(REFUSALS)}) AS r(rule, priority, reason)), p AS (SELECT * FROM (VALUES {_rows(REFUSAL_PARTS)}) AS p(rule, kind, term)),
x AS (SELECT conv_id, turn, rule, kind, {_IS} AS so FROM c CROSS JOIN p),
h AS (SELECT conv_id, turn, rule FROM x GROUP BY ALL HAVING count(*) FILTER (kind = 'all' AND NOT so) = 0 AND count(*) FILTER (kind = 'none' AND so) = 0 AND (count(*) FILTER (kind = 'any') = 0 OR count(*) FILTER (kind = 'any' AND so) > 0)),
f AS (SELECT conv_id, turn, arg_min(reason, (priority, rule)) AS reason FROM h JOIN r USING (rule) GROUP BY ALL)
SELECT c.conv_id, c.turn, reason FROM c LEFT JOIN f USING (conv_id, turn)""")
def rtv8(spark, d):
    """The first refusal rule that a message meets."""
    messages = table(spark, d, "conversations").withColumn("message", F.struct("conv_id", "turn"))
    is_so = {"@assistant": F.col("role") == "assistant", "@late": F.col("turn") >= 4, "@long": F.size(RU.tokens(F.col("text"))) > 40}
    facts = messages.select("message", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in is_so.items())))).alias("term"))
    rules = spark.createDataFrame(REFUSALS, "rule string, priority int, reason string")
    parts = spark.createDataFrame(REFUSAL_PARTS, "rule string, kind string, term string")
    return RU.refused(messages, "message", "text", rules, parts, facts).select("message.*", "reason")


WEEK, LEAST = "2024-01-08", 0.3
_FACT = f"""x AS (SELECT user_id, event_type, CAST(date_trunc('week', ts) AS DATE) AS wk, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY ALL),
fa AS (SELECT user_id, event_type, wk, hi AS e FROM x UNION ALL SELECT user_id, event_type, wk, lo FROM x WHERE user_id % 7 = 3 AND lo <> hi),
fb AS (SELECT user_id, event_type, CASE WHEN user_id % 11 = 4 THEN 0 WHEN user_id % 13 = 5 AND event_type = 'view' THEN 1 WHEN user_id % 17 = 6 THEN 3 END AS flaw, (e % 100) / 100.0 >= {LEAST} AS taken FROM fa WHERE wk = DATE '{WEEK}' AND event_type IN ('view', 'click')),
g AS (SELECT u.user_id, t.event_type, count(fb.user_id) AS n, min(flaw) AS flaw, count(*) FILTER (taken) AS n_taken FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('view'), ('click')) AS t(event_type) LEFT JOIN fb ON fb.user_id = u.user_id AND fb.event_type = t.event_type GROUP BY 1, 2),
o AS (SELECT user_id, min(flaw) AS flaw, bool_or(n > 1) AS several, sum(least(n_taken, 1)) AS taken, string_agg(CASE WHEN n_taken = 0 THEN event_type END, ',' ORDER BY event_type) AS lacking FROM g GROUP BY user_id),
z AS (SELECT user_id, CAST(taken AS BIGINT) AS taken, CASE WHEN flaw IS NOT NULL THEN ['missing its statement or source trace', 'missing observed values', 'missing source fields', 'no registered confidence'][flaw + 1] WHEN several THEN 'several facts of one slot and window' WHEN lacking IS NOT NULL THEN 'missing: ' || lacking END AS refusal FROM o)"""


@query("rtv7_evidence_selection", f"WITH {_FACT} SELECT user_id AS entity, CASE WHEN refusal IS NULL THEN taken ELSE 0 END AS selected, refusal FROM z")
def rtv7(spark, d):
    """Two slots of each user in one week. A week's last event is its fact; some users
    have two, and some facts are incomplete on purpose."""
    ev = table(spark, d, "events")
    x = ev.groupBy("user_id", "event_type", F.date_trunc("week", "ts").cast("date").alias("window")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    ids = F.when((F.col("user_id") % 7 == 3) & (F.col("lo") != F.col("hi")), F.array("hi", "lo")).otherwise(F.array("hi"))
    u = F.col("user_id")
    facts = x.select(u.alias("entity"), F.col("event_type").alias("slot"), "window", F.explode(ids).alias("e")).withColumn("user_id", F.col("entity")).select(
        "entity", "slot", "window", F.when(u % 11 == 4, "").otherwise("stated").alias("statement"), F.lit("events").alias("source"),
        F.when((u % 13 == 5) & (F.col("slot") == "view"), F.array().cast("array<bigint>")).otherwise(F.array("e")).alias("values"), F.array(F.lit("value")).alias("fields"),
        F.when(u % 17 == 6, "low").otherwise("high").alias("confidence"), ((F.col("e") % 100) / 100.0).alias("score"),
    )
    expected = ev.select(u.alias("entity")).distinct().select("entity", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("slot"), F.lit(WEEK).cast("date").alias("window"))
    return V.selected_facts(facts, expected, LEAST)


#: Types of facts in messages with their patterns, in order.
FACT_RULES = [
    ("product_price", r"(?:价格|售价|定价)(?:是|为)?\s*([0-9]+(?:\.[0-9]+)?\s*(?:元|块|¥|人民币)?)", None),
    ("promo", r"(满[0-9]+减[0-9]+)", None), ("promo", r"([0-9]+件[0-9]+折)", None), ("promo", r"([0-9]+折)", None), ("promo", "(买一送一)", None), ("promo", "(第二件半价)", None),
    ("stock_status", "(现货)", "现货"), ("stock_status", "(有货)", "有货"), ("stock_status", "(缺货)", "缺货"), ("stock_status", "(无货)", "无货"), ("stock_status", "(售罄)", "售罄"), ("stock_status", "(预售)", "预售"),
    ("shipping_policy", "(次日达)", "次日达"), ("shipping_policy", "(当日达)", "当日达"), ("shipping_policy", "(包邮)", "包邮"), ("shipping_policy", "(免邮)", "免邮"), ("shipping_policy", "([0-9]+天内发货)", None), ("shipping_policy", "(48小时内发货)", "48小时内发货"),
    ("product_feature", "主打([一-龥A-Za-z0-9-]+)", None), ("product_feature", "特点是([一-龥A-Za-z0-9-]+)", None), ("product_feature", "卖点是([一-龥A-Za-z0-9-]+)", None), ("product_feature", "具有([一-龥A-Za-z0-9-]+)性", None),
]
#: Patterns of a product's name at the start of a message, in order, and
#: names that mean no certain product.
PRODUCT_RULES = [
    r"^([A-Za-z0-9一-龥_-]+)的?(?:价格|售价|定价|特点|卖点)",
    r"^([A-Za-z0-9一-龥_-]+)(?:目前)?(?:现货|有货|缺货|无货|售罄|预售)",
    r"^([A-Za-z0-9一-龥_-]+)(?:支持|可)(?:次日达|当日达|包邮|免邮)",
    r"^([A-Za-z0-9一-龥_-]+)主打",
]
GENERIC = ["这款产品", "该产品", "本产品", "这个产品"]
#: What messages begin with, and what they end with, by their number.
_STARTS = ["", "蓝杯现货 ", "这款产品主打轻便 ", "cup-7支持包邮 "]
_START = "list_extract([" + ", ".join(f"'{x}'" for x in _STARTS) + "], CAST((conv_id + turn) % 4 AS INT) + 1)"
_ENDS = ["", " 售价为 12.5 元", " 满100减20", " 3件8折", " 现货", " 预售, 包邮", " 7天内发货", " 主打轻便", " 具有防水性", " 价格面议"]
_END = "list_extract([" + ", ".join(f"'{x}'" for x in _ENDS) + "], CAST((conv_id * 7 + turn) % 10 AS INT) + 1)"
_FITS = lambda p, v: f"regexp_matches(t, '{p}')" if v else f"regexp_extract(t, '{p}', 1) <> ''"


_AT = lambda p: f"strpos(t, regexp_extract(t, '{p}', 0))"
_GENERIC = ", ".join(f"'{x}'" for x in ("", *GENERIC))
_RULED = lambda name, of: f"(CASE {' '.join(f'WHEN {_FITS(p, v)} THEN {of(p, v)}' for _, p, v in FACT_RULES)} END) AS {name}"


@query("mem2_fact_extraction", f"""WITH m AS (SELECT conv_id, turn, regexp_replace({_START} || text || {_END}, '^\\s+|\\s+$', '', 'g') AS t FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE {' '.join(f"WHEN {_FITS(p, v)} THEN '{k}'" for k, p, v in FACT_RULES)} END AS type, {_RULED('value', lambda p, v: f"'{v}'" if v else f"trim(regexp_extract(t, '{p}', 1))")},
CASE WHEN {' OR '.join(_FITS(p, v) for _, p, v in FACT_RULES)} THEN CASE {' '.join(f"WHEN regexp_extract(t, '{p}', 1) NOT IN ({_GENERIC}) THEN regexp_extract(t, '{p}', 1)" for p in PRODUCT_RULES)} END END AS product_ref,
{_RULED('"start"', lambda p, _: _AT(p))}, {_RULED('"end"', lambda p, _: f"{_AT(p)} + length(regexp_extract(t, '{p}', 0)) - 1")} FROM m""")
def mem2(spark, d):
    """Typed facts of user messages, each of which is given a start and an end that may
    hold one."""
    nth = lambda xs, n: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    start, end = nth(_STARTS, (F.col("conv_id") + F.col("turn")) % 4), nth(_ENDS, (F.col("conv_id") * 7 + F.col("turn")) % 10)
    m = table(spark, d, "conversations").where("role = 'user'").withColumn("f", V.ruled_facts(F.concat(start, "text", end), FACT_RULES, PRODUCT_RULES, GENERIC))
    return m.select("conv_id", "turn", "f.*")


# --- text reports: a store's three months as text, with one flaw in most stores' first

FIELDS = {"Amount": ("transaction_amount", "number"), "Orders": ("transaction_orders", "number"), "Conversion": ("order_conversion_rate_pct", "percent")}
SECTIONS, NOTES, PENDING = {"Top items": "top_items"}, ["Report of the month"], ["Visits"]


def _reports(spark, d):
    """(store_id, text) and the profile to read it with."""
    keys = ["store_id", "period_month"]
    items = sku_period(spark, d).where("sku_rank <= 3").withColumn("period_month", F.date_format("period_start", "yyyy-MM"))
    items = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sku_rank", "sku_name", "sales_volume"))).alias("l"))
    p = store_period(spark, d).where(F.col("period_month").isin(MONTHS)).join(items, keys)
    first = F.col("period_month") == F.min("period_month").over(Window.partitionBy("store_id"))
    p = p.withColumn("flaw", F.when(first, F.expr("cast(substring(store_id, 2) as int) % 10")).otherwise(0))
    entry = F.transform("l", lambda x: F.concat_ws(" ", x.sku_name, x.sales_volume.cast("string")))
    flaw = lambda i: F.col("flaw") == i
    text = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(c.cast("string"), F.lit("")))
    window, amount = text("Window", F.col("period_month")), text("Amount", F.round("transaction_amount", 2).cast("decimal(18,2)"))
    orders, rate = text("Orders", F.col("transaction_orders")), F.coalesce(F.concat(F.col("order_conversion_rate_pct").cast("decimal(18,2)").cast("string"), F.lit("%")), F.lit(""))
    listed = F.when(flaw(6), F.concat(entry, F.array(*(F.lit(f"P{i} 1") for i in range(4))))).otherwise(entry)
    lines = F.array(
        F.lit("Report of the month"), F.concat(F.lit("Store: "), F.when(flaw(1), "X").otherwise("A"), "store_id"), F.when(~flaw(7), window), F.when(flaw(2), window), amount,
        F.when(flaw(7), window), F.when(flaw(5), "Weather: sunny"), F.when(flaw(8), "Visits: 12"), orders, F.when(flaw(4), orders),
        text("Conversion", F.when(flaw(3), "5").otherwise(rate)), text("Top items", F.array_join(listed, "; ")), F.lit(""),
    )
    block = F.struct("period_month", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("text"))
    texts = p.groupBy("store_id").agg(F.array_sort(F.collect_list(block)).alias("b")).select("store_id", F.array_join(F.transform("b", lambda x: x.text), "\n").alias("text"))
    known = stores(spark, d).select(F.concat(F.lit("A"), "store_id").alias("alias"), F.col("store_id").alias("store"))
    return texts, V.ReportProfile(r"^Store:\s*(\S+)$", known, "Window", FIELDS, SECTIONS, NOTES, PENDING)


_M = ", ".join(f"'{m}'" for m in MONTHS)
_REP = f"""{SP}, rp AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY period_month) AS block, CASE WHEN row_number() OVER (PARTITION BY store_id ORDER BY period_month) = 1 THEN CAST(substr(store_id, 2) AS INT) % 10 ELSE 0 END AS flaw FROM sp WHERE period_month IN ({_M}))"""


@query("win9_report_blocks", f"WITH {_REP} SELECT store_id, block, CASE WHEN flaw IN (2, 4, 5, 8) THEN 7 ELSE 6 END AS n_lines FROM rp")
def win9(spark, d):
    """Blocks of store reports, each from a store's header on."""
    return V.report_lines(*_keyed(spark, d)).groupBy("store_id", "block").agg(F.count("*").alias("n_lines"))


def _keyed(spark, d):
    texts, profile = _reports(spark, d)
    return texts, "store_id", profile


_FROZEN = "CASE flaw WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 4 ELSE 0 END"
_ISSUE = "CASE flaw WHEN 1 THEN 'unregistered store' WHEN 2 THEN 'a second window' WHEN 3 THEN 'percentage without a sign' WHEN 4 THEN 'repeated field or list' WHEN 5 THEN 'unknown field or section' WHEN 6 THEN 'list format' WHEN 7 THEN 'data before a window' WHEN 8 THEN 'unit not confirmed' END"


@query("win10_freeze_rule", f"WITH {_REP} SELECT store_id, CAST(sum({_FROZEN}) AS BIGINT) AS n_frozen, max({_ISSUE}) AS issue FROM rp GROUP BY store_id")
def win10(spark, d):
    """Lines that the first issue of their block freezes, and the issue."""
    lines = V.report_lines(*_keyed(spark, d))
    return lines.groupBy("store_id").agg(F.count_if("frozen").alias("n_frozen"), F.max("issue").alias("issue"))


@query("ing6_report_rows", f"""WITH {_REP}, {SKU}, ok AS (SELECT * FROM rp WHERE store_id IN (SELECT store_id FROM rp GROUP BY store_id HAVING sum(CASE WHEN flaw BETWEEN 1 AND 8 THEN 1 ELSE 0 END) = 0)),
u AS (SELECT store_id, block, period_start, period_end, 'transaction_amount' AS field, NULL AS place, NULL AS name, CAST(CAST(round(transaction_amount, 2) AS DECIMAL(18, 2)) AS DOUBLE) AS value FROM ok
UNION ALL SELECT store_id, block, period_start, period_end, 'transaction_orders', NULL, NULL, CAST(transaction_orders AS DOUBLE) FROM ok
UNION ALL SELECT store_id, block, period_start, period_end, 'order_conversion_rate_pct', NULL, NULL, CAST(CAST(order_conversion_rate_pct AS DECIMAL(18, 2)) AS DOUBLE) FROM ok
UNION ALL SELECT ok.store_id, block, ok.period_start, ok.period_end, 'top_items', sku_rank, sku_name, CAST(sales_volume AS DOUBLE) FROM ok JOIN sku ON sku.store_id = ok.store_id AND sku.period_start = ok.period_start WHERE sku_rank <= 3)
SELECT store_id, block, store_id AS store, period_start, period_end, field, CAST(place AS INT) AS place, CAST(name AS VARCHAR) AS name, value FROM u""")
def ing6(spark, d):
    """Text reports to typed rows: windows, labels, values and top lists; a report with
    any issue gives none."""
    texts, profile = _reports(spark, d)
    return V.report_rows(V.report_lines(texts, "store_id", profile), "store_id")
