"""Keyword index and refusal rules against plain versions."""

import random
import re

from pyspark.sql import functions as F

from tallyproof.operators import rules as R


def plain_tokens(text):
    return [t for t in re.findall(r"[一-鿿]|[^\W_一-鿿]+", (text or "").lower())]


def plain_places(text, term):
    a, b = plain_tokens(text), plain_tokens(term)
    return [i for i in range(len(a) - len(b) + 1) if b and a[i : i + len(b)] == b]


VOCABULARY = ["store", "all", "stores", "Rank", "search", "曝光", "搜索", "because", "of", "why", "Zoë", "48", "the"]


def messages(spark, n=150):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", ", ", "-"]).join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "..."), (903, "全部曝光搜索"), (904, "storefront because-of")]
    return rows, spark.createDataFrame(rows, "id long, body string")


def test_slots_come_in_order_of_first_mention(spark):
    rows, df = messages(spark)
    keywords = [("visibility", "search"), ("visibility", "曝光"), ("visibility", "rank"), ("causal", "because of"), ("scope", "all stores"), ("scope", "48 stores"), ("scope", "曝光搜索"), ("name", "ZOË"), ("empty", "...")]
    got = {r.id: list(r.slots) for r in R.slots(df, "id", "body", spark.createDataFrame(keywords, "slot string, term string")).collect()}
    for i, text in rows:
        first = {}
        for slot, term in keywords:
            for at in plain_places(text, term)[:1]:
                first[slot] = min(first.get(slot, at), at)
        assert got[i] == sorted(first, key=lambda s: (first[s], s))
    assert got[904] == ["causal"] and got[903] == ["scope", "visibility"] or got[903] == ["visibility", "scope"]


def test_thousands_of_terms_are_one_join(spark):
    """The plan of 5,000 terms is as long as that of five."""
    rng = random.Random(3)
    terms = [("s%d" % (i % 7), " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 3)))) for i in range(5000)]
    df = spark.createDataFrame([(i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(60))) for i in range(100)], "id long, body string")
    frame = lambda n: spark.createDataFrame(terms[:n], "slot string, term string")
    lines = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().splitlines())
    many = R.mentions(df, "id", "body", frame(5000))
    assert lines(many) == lines(R.mentions(df, "id", "body", frame(5)))
    want = sorted((r.id, t, at) for r in df.collect() for t in {t for _, t in terms} for at in plain_places(r.body, t))
    assert sorted((r.id, r.term, r["at"]) for r in many.collect()) == want and len(want) > 1000


def test_rules_as_data_equal_a_plain_version(spark):
    rng = random.Random(5)
    rows, df = messages(spark)
    facts = [(i, rng.choice(["@other_period", "@other_entity"])) for i, _ in rows if rng.random() < 0.4]
    terms = [v.lower() for v in VOCABULARY] + ["because of", "all stores", "@other_period", "@other_entity"]
    rules = [(f"r{k:02}", rng.randint(0, 6), f"reason {k}") for k in range(20)]
    parts = [(r, kind, t) for r, _, _ in rules[:17] for kind, n in (("all", rng.choice([0, 1, 2])), ("any", rng.choice([0, 2])), ("none", rng.choice([0, 1, 2]))) for t in rng.sample(terms, n)]
    parts += [("r17", "none", "the"), ("r17", "none", "of"), ("r18", "all", "@other_period"), ("r18", "none", "why"), parts[0]]
    got = {r.id: (r.rule, r.reason) for r in R.refused(df, "id", "body", spark.createDataFrame(rules, "rule string, priority int, reason string"), spark.createDataFrame(parts, "rule string, kind string, term string"), spark.createDataFrame(facts, "id long, term string")).collect()}
    has = lambda i, text, t: (i, t) in facts if t.startswith("@") else bool(plain_places(text, t))
    for i, text in rows:
        met = []
        for rule, priority, reason in rules:
            own = {k: {t for r, kind, t in parts if r == rule and kind == k} for k in ("all", "any", "none")}
            if all(has(i, text, t) for t in own["all"]) and (not own["any"] or any(has(i, text, t) for t in own["any"])) and not any(has(i, text, t) for t in own["none"]):
                met.append((priority, rule, reason))
        assert got[i] == (min(met)[1:] if met else (None, None))
    assert len({r for r, _ in got.values()}) > 2


def test_no_rules_refuse_nothing(spark):
    _, df = messages(spark, 3)
    none = R.refused(df, "id", "body", spark.createDataFrame([], "rule string, priority int, reason string"), spark.createDataFrame([], "rule string, kind string, term string"))
    assert none.where(F.col("rule").isNotNull()).count() == 0 and none.count() == df.count()
