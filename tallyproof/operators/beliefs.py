"""Hypotheses, beliefs and findings of a review, computed again from its checks.

checks: (key, factor, field, status, result): status is supported, missing or invalid;
result is increased, decreased, unchanged or null. Every review is one aggregation by
its key, with a fixed number of conditions and no lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ok() -> Column:
    return F.coalesce(F.col("status") == "supported", F.lit(False))


def _rows(review: DataFrame, key: str, hypotheses: dict, belief: Column) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(h).alias("hypothesis"), s.alias("status")) for h, s in hypotheses.items()))
    return review.select(key, F.inline(rows), belief.alias("belief"))


def causal(checks: DataFrame, key: str, outcomes: list[str], driver: str, alternative: str) -> DataFrame:
    """(key, hypothesis, status, belief) of a question for causes. H1: the outcomes were
    observed. H2: the driver moved, and they with it. H3: the factor alternative changed,
    and so remains another explanation."""
    ok, changed = _ok(), F.col("result").isin("increased", "decreased")
    outcome, drives, other = F.col("field").isin(outcomes), F.col("field") == driver, F.col("factor") == alternative
    result = lambda f: F.max(F.when((F.col("field") == f) & ok, F.col("result")))
    g = checks.groupBy(key).agg(
        F.count_distinct(F.when(outcome & ok, F.col("field"))).alias("n_outcomes"), F.max(drives & ok).alias("driven"), F.count_if(other & ~ok).alias("n_open"), F.count_if(other & changed).alias("n_changed"),
        F.count_if(~ok).alias("n_unresolved"), result(driver).alias("way"), *(result(f).alias(f"way_{i}") for i, f in enumerate(outcomes)),
    )
    complete = F.col("n_outcomes") == len(outcomes)
    together = F.col("way").isin("increased", "decreased")
    for i in range(len(outcomes)):
        together &= F.col(f"way_{i}") == F.col("way")
    both = complete & F.col("driven")
    h = {
        "H1": F.when(complete, "strong").otherwise("unsupported"),
        "H2": F.when(both & together, "plausible").when(both, "rejected").otherwise("unsupported"),
        "H3": F.when(F.col("n_open") > 0, "unsupported").when(F.col("n_changed") > 0, "plausible").otherwise("weak"),
    }
    return _rows(g, key, h, F.when(complete & (F.col("n_unresolved") == 0), "active").otherwise("tentative"))


def comparison(checks: DataFrame, key: str, period: str, needed: list[str], repeated: str) -> DataFrame:
    """(key, hypothesis, status, belief) of a question whether entities compare. H1: all
    share the reporting period and have the needed records, and nothing else but the
    repeated windows is open. H2, that this makes them comparable, is never supported."""
    ok, factor = _ok(), F.col("factor")
    g = checks.groupBy(key).agg(
        F.count_if(factor == period).alias("n_period"), F.count_if((factor == period) & ~ok).alias("n_apart"), F.count_if(~ok & (factor != repeated)).alias("n_open"), F.count_if(~ok).alias("n_unresolved"),
        F.count_distinct(F.when(F.col("field").isin(needed) & ok, F.col("field"))).alias("n_recorded"),
    )
    ready = (F.col("n_period") > 0) & (F.col("n_apart") == 0) & (F.col("n_recorded") == len(needed)) & (F.col("n_open") == 0)
    h = {"H1": F.when(ready, "strong").otherwise("unsupported"), "H2": F.lit("unsupported")}
    return _rows(g, key, h, F.when(ready & (F.col("n_unresolved") == 0), "active").otherwise("tentative"))


def documents(checks: DataFrame, key: str) -> DataFrame:
    """(key, hypothesis, status, belief) of a question that documents answer. H1: they
    cover all that was asked for. H2, that they establish an action, is never supported."""
    g = checks.groupBy(key).agg(F.count_if(~_ok()).alias("n_open"))
    whole = F.col("n_open") == 0
    h = {"H1": F.when(whole, "strong").otherwise("unsupported"), "H2": F.lit("unsupported")}
    return _rows(g, key, h, F.when(whole, "active").otherwise("tentative"))


def findings(checks: DataFrame, questions: DataFrame, key: str, outcomes: list[str], causal_kind: str = "causal_diagnostic") -> DataFrame:
    """(key, place, issue, severity, fact_check): what a critic has to say of each question
    (key, kind, question), the worst first. Place 0: the question takes for granted that
    the outcomes increased, and a supported one didn't. 1: a check is open (a row of its
    own for each, by field; high if invalid). 2: what its kind of question never
    settles. fact_check is pass, or pass_with_warnings if there is any of the first two."""
    ok = _ok()
    against = F.col("field").isin(outcomes) & ok & (F.col("result") != "increased")
    g = checks.groupBy(key).agg(F.max(F.coalesce(against, F.lit(False))).alias("against"), F.count_if(~ok).alias("n_open"))
    presumes = F.col("question").rlike(r"(?i)\bincrease[sd]?\b|\bgrowth\b") & (F.col("kind") == causal_kind)
    q = questions.join(g, key, "left").withColumn("rejected", F.coalesce(presumes & F.col("against"), F.lit(False)))
    q = q.withColumn("fact_check", F.when(F.col("rejected") | (F.coalesce("n_open", F.lit(0)) > 0), "pass_with_warnings").otherwise("pass"))
    row = lambda place, issue, severity: F.struct(F.lit(place).alias("place"), issue.alias("issue"), severity.alias("severity"))
    last = F.when(F.col("kind") == causal_kind, "other explanations").when(F.col("kind") == "comparability_judgment", "comparability").otherwise("measured outcomes")
    premise = F.when(F.col("rejected"), row(0, F.lit("premise"), F.lit("high")))
    always = row(2, last, F.when(F.col("kind") == causal_kind, "high").otherwise("medium"))
    fixed = q.select(key, "fact_check", F.inline(F.filter(F.array(premise, always), lambda x: x.isNotNull())))
    unresolved = checks.where(~ok).join(q.select(key, "fact_check"), key)
    open_ = unresolved.select(key, "fact_check", F.lit(1).alias("place"), F.col("field").alias("issue"), F.when(F.col("status") == "invalid", "high").otherwise("medium").alias("severity"))
    return fixed.unionByName(open_).select(key, "place", "issue", "severity", "fact_check")
