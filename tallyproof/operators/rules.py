"""Keyword indexes and rule tables: terms are rows, so that thousands of them cost a join
and no expression grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A token: a Han character, or a run of other letters and digits.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def mentions(messages: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term, at) of each place (token number from 0) where a term's tokens stand
    one after another. terms: term. An inverted index of the terms' first tokens meets
    the tokens of the messages, each with as many after it as the longest term has."""
    index = terms.select("term").distinct().withColumn("_parts", tokens(F.col("term"))).where(F.size("_parts") > 0)
    longest = index.agg(F.max(F.size("_parts"))).first()[0] or 1
    index = index.withColumn("_first", F.col("_parts")[0])
    words = messages.select(F.col(key), tokens(F.col(text)).alias("_words"))
    spans = F.transform("_words", lambda _, i: F.slice("_words", i + 1, longest))
    places = words.select(key, F.posexplode(spans).alias("at", "_next")).withColumn("_first", F.col("_next")[0])
    return places.join(index, "_first").where(F.slice("_next", F.lit(1), F.size("_parts")) == F.col("_parts")).select(key, "term", "at")


def slots(messages: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """(key, slots) of every message: the slots whose terms it has, in order of first
    mention (of the same place: by name). keywords: slot, term."""
    found = mentions(messages, key, text, keywords).join(keywords.select("slot", "term").distinct(), "term").groupBy(key, "slot").agg(F.min("at").alias("at"))
    named = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "slot"))), lambda x: x["slot"]).alias("slots"))
    return messages.select(key).distinct().join(named, key, "left").withColumn("slots", F.coalesce("slots", F.array().cast("array<string>")))


def refused(messages: DataFrame, key: str, text: str, rules: DataFrame, parts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(key, rule, reason) of every message: the rule of least priority (then name) that it
    meets, null if none. rules: rule, priority, reason; parts: rule, kind, term. A rule is
    met if the message has every term of kind `all`, one at least of kind `any` if there
    are such, and none of kind `none`. facts: (key, term) of what else is so of a message,
    as conditions of entity or period; such terms begin with @ and aren't looked up in
    the text. A rule of `none`
    terms alone is met by messages that have none of them; one without terms by all."""
    always = "@message"
    parts = parts.select("rule", "kind", "term").distinct()
    positive = parts.where("kind in ('all', 'any')").select("rule").distinct()
    bare = rules.select("rule").join(positive, "rule", "left_anti").select("rule", F.lit("all").alias("kind"), F.lit(always).alias("term"))
    parts = parts.unionByName(bare)
    worded = parts.where(~F.startswith("term", F.lit("@")))
    hits = mentions(messages, key, text, worded).select(key, "term").unionByName(messages.select(key, F.lit(always).alias("term")))
    if facts is not None:
        hits = hits.unionByName(facts.select(key, "term"))
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}")
    needs = parts.groupBy("rule").agg(of("all"), of("any"))
    had = hits.distinct().join(parts, "term").groupBy(key, "rule").agg(*(F.count_if(F.col("kind") == k).alias(f"has_{k}") for k in ("all", "any", "none")))
    met = had.join(needs, "rule").where("has_all = n_all and (n_any = 0 or has_any > 0) and has_none = 0").join(rules, "rule")
    first = met.groupBy(key).agg(F.min_by(F.struct("rule", "reason"), F.struct("priority", "rule")).alias("first"))
    return messages.select(key).distinct().join(first, key, "left").select(key, "first.rule", "first.reason")
