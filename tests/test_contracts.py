"""Contracts of inputs, beliefs of reviews and stores named in requests, by hand."""

import json

from pyspark.sql import functions as F

from tallyproof.functions import text as T
from tallyproof.operators import beliefs as B, contracts as C

KEYS, ZONES = ["entity", "scope_version", "timezone"], ["UTC", "Asia/Shanghai"]
GOOD = {"entity": "a", "scope_version": "1", "timezone": "UTC"}


def test_scopes_tell_all_that_they_break(spark):
    rows = [
        (None, []), (json.dumps(GOOD), []), ("{", ["not an object"]), ("[1]", ["not an object"]), ("{}", ["missing: entity, scope_version, timezone"]),
        (json.dumps({**GOOD, "x": 1, "w": 2}), ["unknown: w, x"]), (json.dumps({**GOOD, "entity": None}), ["entity: not a text"]), (json.dumps({**GOOD, "entity": " "}), ["entity: not a text"]),
        (json.dumps({**GOOD, "scope_version": 1}), ["scope_version: not a text"]), (json.dumps({"scope_version": "2", "timezone": "posix/UTC"}), ["missing: entity", "scope_version: not registered", "timezone: not registered"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", C.scope_errors("t", KEYS, "1", ZONES).alias("e")).collect()}
    assert [got[i] for i in range(len(rows))] == [e for _, e in rows]


def test_scope_digest_is_that_of_the_declaration(spark):
    import hashlib

    texts = [json.dumps(GOOD), json.dumps(dict(reversed(GOOD.items())), indent=3), json.dumps({**GOOD, "entity": "é\"店"}, ensure_ascii=False), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [t and hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() for t in texts]
    assert [r.h for r in df.orderBy("i").select(C.scope_digest("t", KEYS).alias("h")).collect()] == want and want[0] == want[1]


def test_uploads_meet_their_formats(spark):
    formats = spark.createDataFrame([("1", "m", True, False, False, None), ("2", "d", False, True, True, ["x"])], "registry_version string, mapping_version string, whole_months boolean, manual boolean, scoped boolean, datasets array<string>")
    sha, at = "0" * 64, "2024-03-01T00:00:00Z"
    kind = "upload_id int, registry_version string, mapping_version string, dataset_id string, period_start string, period_end string, document_id string, source_block_line int, aggregation_scope string, file_sha256 string, extracted_at string"
    rows = [
        ((1, "1", "m", "y", "2024-02-01", "2024-02-29", None, None, None, sha, at), [], "2024-02"),
        ((2, "1", "d", "y", "2024-02-01", "2024-02-29", None, None, None, sha, at), ["format"], "2024-02"),
        ((3, None, None, None, None, None, None, None, None, None, None), ["registry version", "digest", "window: not two days", "extracted_at"], None),
        ((4, "2", "d", "x", "2024-02-01", "2024-02-02", " ", 1, "{}", sha, "2024-03-01T00:00:00"), ["document and line needed", "extracted_at", "scope missing: entity, scope_version, timezone"], "2024-02-01..2024-02-02"),
        ((5, "2", "d", "y", "2024-02-30", "2024-03-02", "a", 0, None, sha, "2024-13-01T00:00:00Z"), ["document and line needed", "dataset", "window: not two days", "extracted_at"], None),
        ((6, "1", "m", "y", "2024-02-03", "2024-02-02", None, 4, json.dumps(GOOD), sha.upper() + "0", at), ["document and line not known to the format", "scope not known to the format", "digest", "window: ends before it starts"], None),
    ]
    got = {r.upload_id: (r.errors, r.window) for r in C.registered_uploads(spark.createDataFrame([r for r, *_ in rows], kind), formats, KEYS, "1", ZONES).collect()}
    assert got == {r[0]: (e, w) for r, e, w in rows}


def test_cases_and_a_query_that_thousands_share(spark):
    good = {"case_id": "a", "query": "q", "case_type": "positive", "expected_entity": None, "expected_slot": "s", "expected_period_terms": [], "expected_terms": ["x"]}
    odd = [
        ({**good}, []), ({**good, "case_id": " a ", "query": "q2"}, ["case_id: as case 0"]), ({}, [f"{f}: missing" for f in sorted(good)]), ({**good, "case_id": 1, "query": ["q"]}, ["case_id: not a text", "query: not a text"]),
        ({**good, "case_id": "e", "query": "r", "expected_terms": [1]}, ["expected_terms: not a list of texts"]), ({**good, "case_id": "f", "query": "s", "expected_terms": ["a", None], "expected_slot": {}}, ["expected_slot: not a text or null", "expected_terms: not a list of texts"]),
        ({**good, "case_id": "g", "query": "t", "case_type": None}, ["case_type: not registered"]),
    ]
    many = [({**good, "case_id": f"m{i}", "query": "same"}, [] if i == 0 else [f"query: as case {len(odd)}"]) for i in range(3000)]
    rows = odd + many
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(rows)] + [(len(rows), None)], "i int, raw string")
    got = {r.i: r.errors for r in C.case_errors(df, "i", "raw", ["positive"]).collect()}
    assert got == {i: e for i, (_, e) in enumerate(rows)} | {len(rows): ["not an object"]}
    assert C.case_errors(df.limit(0), "i", "raw", ["positive"]).collect() == []


def test_fields_of_requests(spark):
    registry = spark.createDataFrame([("a", "k", True), ("a", "y", False), ("a", "x", False), ("b", "k", True)], "dataset_id string, field string, is_key boolean")
    rows = [(1, "a", None, ["x", "y"], []), (2, "a", ["y", "x"], ["x", "y"], []), (3, "a", [], None, ["no fields"]), (4, "a", ["k", "x", "x"], None, ["repeated fields", "not registered or keys: k"]), (5, "b", None, [], []), (6, "c", None, None, ["dataset"]), (7, None, ["x"], None, ["dataset"]), (8, "b", ["x"], None, ["not registered or keys: x"])]
    asked = spark.createDataFrame([r[:3] for r in rows], "request_id int, dataset_id string, fields array<string>")
    assert sorted((r.request_id, r.selected, r.errors) for r in C.requested_fields(asked, registry).collect()) == [(i, s, e) for i, _, _, s, e in rows]


def test_every_expected_fact_once(spark):
    slots = {"p": {"fields": ["v"], "terms": ["Sum"], "any_of": [["x", "y"]]}, "q": {}}
    facts = spark.createDataFrame([(1, "p", "1", "the SUM x"), (1, "q", None, None), (2, "p", " ", "sum"), (2, "p", "3", "Y"), (3, "z", "1", "sum")], "e int, slot string, v string, t string")
    got = {(r.e, r.slot): (r.n, r.errors) for r in C.slot_coverage(facts, facts, "e", slots, "t").collect()}
    assert got == {(1, "p"): (1, []), (1, "q"): (1, []), (2, "p"): (2, ["repeated", "v: empty", "no Sum", "none of x, y"]), (2, "q"): (0, ["missing"]), (3, "p"): (0, ["missing"]), (3, "q"): (0, ["missing"])}


def test_stored_rates_flags_and_notes(spark):
    rows = [(1, 4, 2, 2.0, "ok", "n"), (2, 4, 2, 2.04, "ok", "n"), (3, 4, 2, 2.2, "no", " "), (4, 4, 0, None, "ok", "n"), (5, 4, 0, 1.0, None, None), (6, 4, 2, None, "ok", "n")]
    df = spark.createDataFrame(rows, "k int, a int, b int, rate double, flag string, notes string")
    got = {r.k: r.errors for r in C.rederived(df, ["k"], {"rate": F.try_divide("a", "b")}, ("flag", F.lit("ok")), "notes", 0.05).collect()}
    assert got == {1: [], 2: [], 3: ["rate: differs", "flag: differs", "notes: empty"], 4: [], 5: ["rate: unexpected", "flag: differs", "notes: empty"], 6: ["rate: missing"]}


def _checks(spark, rows):
    return spark.createDataFrame(rows, "k string, factor string, field string, status string, result string")


def test_causal_beliefs(spark):
    def store(k, amount, orders, driver, act):
        return [(k, f, n, "supported" if r else "missing", r) for f, n, r in (("a", "amount", amount), ("o", "orders", orders), ("s", "search", driver), ("promo", "cost", act))]

    up, down, same = "increased", "decreased", "unchanged"
    rows = store("with", up, up, up, same) + store("against", up, down, up, up) + store("flat", same, same, same, same) + store("open", up, None, up, None) + store("blind", up, up, None, down)
    got = {(r.k, r.hypothesis): (r.status, r.belief) for r in B.causal(_checks(spark, rows), "k", ["amount", "orders"], "search", "promo").collect()}
    want = {"with": ("strong", "plausible", "weak", "active"), "against": ("strong", "rejected", "plausible", "active"), "flat": ("strong", "rejected", "weak", "active"), "open": ("unsupported", "unsupported", "unsupported", "tentative"), "blind": ("strong", "unsupported", "plausible", "tentative")}
    assert got == {(k, f"H{i + 1}"): (w[i], w[3]) for k, w in want.items() for i in range(3)}


def test_comparisons_documents_and_findings(spark):
    ok, no = "supported", "missing"
    group = lambda k, period, amount, rep: [(k, "period", "p", period, None), (k, "amount", "amount", amount, None), (k, "windows", "w", rep, None)]
    c = _checks(spark, group("a", ok, ok, ok) + group("b", ok, ok, no) + group("c", no, ok, ok) + group("d", ok, no, ok))
    h1 = lambda df: {r.k: (r.status, r.belief) for r in df.where("hypothesis = 'H1'").collect()}
    assert h1(B.comparison(c, "k", "period", ["amount"], "windows")) == {"a": ("strong", "active"), "b": ("strong", "tentative"), "c": ("unsupported", "tentative"), "d": ("unsupported", "tentative")}
    assert h1(B.documents(c, "k")) == {"a": ("strong", "active"), **{k: ("unsupported", "tentative") for k in "bcd"}}
    checks = _checks(spark, [("1", "f", "amount", ok, "decreased"), ("1", "f", "x", "invalid", None), ("2", "f", "amount", ok, "decreased"), ("3", "f", "amount", ok, "increased")])
    asked = spark.createDataFrame([("1", "causal_diagnostic", "Why the GROWTH?"), ("2", "comparability_judgment", "Did it increase?"), ("3", "causal_diagnostic", "Why did it increase?"), ("4", "other", "increased?")], "k string, kind string, question string")
    got = sorted(tuple(r) for r in B.findings(checks, asked, "k", ["amount"]).collect())
    assert got == [("1", 0, "premise", "high", "pass_with_warnings"), ("1", 1, "x", "high", "pass_with_warnings"), ("1", 2, "other explanations", "high", "pass_with_warnings"), ("2", 2, "comparability", "medium", "pass"), ("3", 2, "other explanations", "high", "pass"), ("4", 2, "measured outcomes", "medium", "pass")]


NAMED = {
    "stores B, C and D": "bcd", "store b-d": "bcd", "stores D to b": "bcd", "store b1-d": ["b1"], "store b—c & store e": "bce", "store b and store c to e": "bcde", "stores 1, 2, and 13": ["1", "2", "13"],
    "restore b": [], "store bc": [], "store b_": [], "Store_B1_x, store_b1_x": ["b1_x"], "a2店、门店 9 店铺b": ["a2", "9", "b"], "StoreA xStoreB Storec": "a", "panel B - F": "bcdef", "ab-f": [], "b-f-g": [], "": [], "stores f, b店 store_z": "zfb",
}


def test_stores_named_in_requests(spark):
    df = spark.createDataFrame([*((q,) for q in NAMED), (None,)], "q string")
    got = {r.q: r.s for r in df.select("q", T.entity_mentions("q").alias("s")).collect()}
    assert got == {q: [f"store_{x}" for x in s] for q, s in NAMED.items()} | {None: []}
