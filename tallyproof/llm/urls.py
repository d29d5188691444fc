"""Operator 1: URL filter by rules and, where no rule fits, by words in the url.

A rule (verdict, host, path) fits its host and all subdomains if the url's path
starts with the rule's; the longest rule wins (block, between equals). Other urls
are judged by their words. Names such as "newsdaily" are split by a unigram model:
counts of the words in all pages' visible text give each split a probability, and
Viterbi finds the best one. A multinomial naive Bayes over the words of host and
path is trained on every url that a rule decides, and tells which side a url is
closer to. With no url on one side, urls without a rule are allowed.

Each distinct letter token is split once; the words that it might hold are found by
a join of its substrings with the word counts: whole ones up to STEM letters, and longer
words by their first STEM letters. What isn't a word may be of any length. Scores are
whole millionths, so that sums don't depend on their order. A token that very many urls
have is a skewed key of the last join, which Spark splits at run time.

Edge cases. A null url or one without "://" has an empty host and path, no rule and
no words, and gets the verdict of the classes' sizes alone. Tokens without letters
count by their length. A score of 0, a tie, allows. Repeated rows are judged one by one, a
null page_id too. A very long url is split in one task, in time and memory that grow with
its length. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
STEM, UNIT = 20, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    cut = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(cut(1), UPPER, LOWER), cut(2)


def rule_of(host: Column, path: Column, rules: list) -> Column:
    """struct(length, verdict, rule) of the rule that wins, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in rules]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull())) if fits else F.lit(None).cast("struct<length:int,verdict:string,rule:string>")


def tokens(host: Column, path: Column) -> Column:
    """The letter runs of host and path, marked by where they stand; digit runs by
    their length. (Host and path words are told apart.)"""
    runs = lambda c, mark: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z]+|[0-9]+)"), F.lit(1)), lambda t: F.concat(F.lit(mark), F.when(t.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t)))
    return F.concat(runs(host, "h:"), runs(path, "p:"))


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of the words of a-z in the pages' visible text."""
    text = F.lower(F.regexp_replace(F.col(html).cast("string"), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\b([a-z]+)\b"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, spans: list, total: int) -> list[str]:
    """The most probable split of name. spans: (start, length, count) of the words
    in it; what isn't a word costs ten times more for each character."""
    score, back = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    known: dict = {}
    for start, length, n in spans:
        known.setdefault(start + length, []).append((start, math.log(n / total)))
    each, once = math.log(10), math.log(total) + 3 - math.log(10)
    # the best start of what isn't a word: its cost grows by the same for each character
    odd, odd_at = -math.inf, 0
    for end in range(1, len(name) + 1):
        if score[end - 1] + (end - 1) * each > odd:
            odd, odd_at = score[end - 1] + (end - 1) * each, end - 1
        score[end], back[end] = odd - end * each - once, odd_at
        for start, cost in known.get(end, []):
            if score[start] + cost >= score[end]:
                score[end], back[end] = score[start] + cost, start
    out, end = [], len(name)
    while end:
        out.append(name[back[end] : end])
        end = back[end]
    return out[::-1]


def _split(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("name", "spans", "total")), strict=True)
        words = [best_split(name, [(s["start"], s["length"], s["n"]) for s in spans or []], max(total or 1, 2)) for name, spans, total in rows]
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], ["name", "words"])


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of distinct names of letters a-z."""
    length, rest = F.length("name"), lambda s: F.length("name") - s + 1
    starts = F.sequence(F.lit(1), length)
    at = lambda s, n: F.struct((s - 1).alias("start"), n.alias("length"), F.substring("name", s, n).alias("word"))
    spans = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(STEM), rest(s))), lambda n: at(s, n))))
    short = names.select("name", F.inline(spans)).join(counts, "word").select("name", "start", "length", "n")
    stems = names.where(length > STEM).select("name", F.inline(F.filter(F.transform(starts, lambda s: at(s, F.lit(STEM))), lambda x: x.start + STEM < length)))
    big = counts.where(F.length("word") > STEM).select(F.col("word").alias("whole"), F.substring("word", 1, STEM).alias("word"), "n")
    long = stems.join(big, "word").where(F.substring(F.col("name"), F.col("start") + 1, F.length("whole")) == F.col("whole"))
    held = short.unionByName(long.select("name", "start", F.length("whole").alias("length"), "n")).groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("spans"))
    total = counts.agg(F.sum("n").alias("total"))
    return names.join(held, "name", "left").crossJoin(F.broadcast(total)).mapInArrow(_split, "name string, words array<string>")


def scored(judged: DataFrame, counts: DataFrame) -> tuple[DataFrame, float]:
    """(token, score) in millionths of log odds for allow, and those of the classes.
    judged: rows with tokens and the rule's verdict."""
    by = lambda v: F.count_if(F.col("verdict") == v)
    n = judged.agg(by("allow").alias("a"), by("block").alias("b")).first()
    if not n.a or not n.b:
        return None, 0
    raw = common.stored(judged.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(by("allow").alias("a"), by("block").alias("b")), "tokens")
    name = F.substring("token", F.lit(3), F.length("token"))
    is_name = F.substring("token", 3, 1) != "#"
    split = segmented(raw.where(is_name).select(name.alias("name")).distinct(), counts)
    words = raw.withColumn("name", name).join(split, "name", "left").select("token", "a", "b", F.explode(F.coalesce("words", F.array("name"))).alias("w")).withColumn("word", F.concat(F.substring("token", 1, 2), "w"))
    words = common.stored(words, "words")
    seen = words.groupBy("word").agg(F.sum("a").alias("wa"), F.sum("b").alias("wb")).where("wa + wb > 0")
    sums = seen.agg(F.sum("wa").alias("ta"), F.sum("wb").alias("tb"), F.count("*").alias("v"))
    odds = F.log((F.col("wa") + 1) / (F.col("ta") + F.col("v"))) - F.log((F.col("wb") + 1) / (F.col("tb") + F.col("v")))
    weights = seen.crossJoin(F.broadcast(sums)).select("word", F.round(odds * UNIT).cast("long").alias("weight"))
    scores = words.join(weights, "word").groupBy("token").agg(F.sum("weight").alias("score"))
    return scores, round(math.log(n.a / n.b) * UNIT)


def judge(pages: DataFrame, rules: list = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row; score: log odds for
    allow, null where a rule decides."""
    host, path = parts(F.col("url").cast("string"))
    cut = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    judged = cut.withColumn("won", rule_of(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    judged = common.stored(judged.select("row", "page_id", "host", "path", "won.rule", "won.verdict", "tokens"), "urls")
    counts = common.stored(word_counts(pages), "words")
    scores, prior = scored(judged, counts)
    if scores is None:
        total = judged.withColumn("score", F.lit(None).cast("double"))
    else:
        open_ = judged.where("verdict is null").select("row", F.explode("tokens").alias("token"))
        sums = open_.join(common.stored(scores, "scores"), "token").groupBy("row").agg(F.sum("score").alias("sum"))
        total = judged.join(sums, "row", "left").withColumn("score", F.when(F.col("verdict").isNull(), (F.coalesce("sum", F.lit(0)) + prior) / UNIT))
    verdict = F.coalesce("verdict", F.when(F.col("score") < 0, "block").otherwise("allow"))
    return total.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages"))
