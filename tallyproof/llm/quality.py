"""Operator 4: quality rules with risk-controlled thresholds.

Fixed base rules reject broken documents. Further signals get cutoffs for each
stratum (language) from labelled documents. The cutoffs of all signals form one
sequence from mild to strict; a step adds its cutoff to those before, and is certified
while the exact binomial (Clopper-Pearson) upper bound of the share of good documents
that all of them together reject stays within the risk. The sequence stops at the
first failure, so neither risk nor error is divided among the signals; between strata
the error is divided (Bonferroni). Which steps a stratum takes depends on its
documents labelled bad alone (a step that rejects no more of them is left out), never
on the good ones that certify it. Of the certified steps the one that rejects most of
the bad documents is taken; none if it rejects bad documents no more often than good
ones.

A stratum with too few good labels to certify even a step that rejects none of them
joins a pooled stratum; while that is too small too, the next larger one joins it. As few
join as leave strata that can all certify at their share of the error, which is divided
by the number of strata there are after pooling. Only the sizes decide, so the bound
holds. certified tells whether a document's stratum has a step at all. The
driver sees counts by stratum and step of the labelled documents only; cutoffs are a
table that documents are joined with, so there may be any number of strata.

Edge cases. A null or empty text has no words and fails the base rules. Null
languages form a stratum of their own, apart from a language of whatever name. A
language without any label gets no cutoffs. A document labelled twice counts as good
only if every label says so. A value equal to a cutoff is kept. Repeated rows are
judged one by one; labels of unknown documents and an empty label table certify
nothing. A very long text is measured in one task's memory. Extra columns, of any
name, are ignored or kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import common, textvec

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
RISK, ERROR = 0.01, 0.05
#: Each signal rejects above its cutoff; cutoffs run from mild to strict.
GRID = {
    "long_words": [40.0, 30.0, 24.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0],
    "short_words": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0, -4.5, -5.0],
    "symbols": [1.0, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03, 0.02],
    "dup_lines": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.2, 0.17, 0.14, 0.11, 0.08, 0.05, 0.03, 0.02],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def _repeated(hashes: np.ndarray, width: int) -> int:
    """Words inside windows that the text holds twice or more."""
    if len(hashes) <= width:
        return 0
    keys = textvec.wide(hashes, width)
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    flags = np.zeros(len(keys), bool)
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return int(textvec.covered(flags, width, len(hashes)).sum())


def _lines(texts: list) -> tuple[list, list]:
    lines, dups = [], []
    for t in texts:
        own = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    return lines, dups


def _measure(batches):
    marks = np.zeros(256, bool)
    marks[list(SYMBOLS[1:-1].encode())] = True
    for batch in batches:
        for low, high in textvec.slices(batch.column("text"), 1 << 20):
            part = batch.slice(low, high - low)
            text = part.column("text")
            data, offsets = textvec.buffers(text)
            starts, ends, first = textvec.word_bounds(data, offsets)
            hashes = textvec.word_hashes(data, starts)
            kept = (~textvec.SEPARATOR[data]) & ((data & 0xC0) != 0x80)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
            lines, dups = _lines(text.to_pylist())
            repeats = [_repeated(hashes[i:j], WINDOW) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c != "text"), *(pa.array(x, pa.int64()) for x in (np.diff(first), total(kept), total(marks[data]), dups, lines, repeats))],
                [*(c for c in part.schema.names if c != "text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"],
            )


def measures(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row for each document: its counts, the base verdict and the signals.
    carry: with the whole input row in the column row."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), *([F.struct(*common.columns(docs)).alias("row")] if carry else []))
    fields = [f for f in plain.schema.fields if f.name != "text"] + [StructField(c, LongType()) for c in BASE]
    counts = plain.mapInArrow(_measure, StructType(fields))
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return counts.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / words).alias("long_words"),
        (-F.col("word_chars") / words).alias("short_words"),
        (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
    )


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial."""
    if k >= n:
        return 0.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(0.0, top + math.log(sum(math.exp(x - top) for x in terms)))


def certified(rejected: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound, at that error, of the rejection rate is
    within risk: P(Binomial(n, risk) <= rejected) <= error."""
    return n > 0 and rejected <= risk * n and log_binomial_cdf(rejected, n, risk) <= math.log(error)


def sequence(grid: dict) -> list[tuple]:
    """(signal, number of its cutoff) of all cutoffs, from mild to strict."""
    every = [(s, i) for s, cutoffs in grid.items() for i in range(len(cutoffs))]
    return sorted(every, key=lambda x: (x[1] + 1) / len(grid[x[0]]))


def choose(counts: dict, grid: dict, risk: float, error: float) -> dict:
    """counts: {(signal, i): (good rejected, good, bad rejected, bad)} by that step and
    those before it; steps without counts are left out."""
    out, best, cuts = dict.fromkeys(grid), 0.0, dict.fromkeys(grid)
    for signal, i in sequence(grid):
        if (signal, i) not in counts:
            continue
        k, n, hit, bad = counts[signal, i]
        if not certified(k, n, risk, error):
            break
        cuts[signal] = grid[signal][i]
        rate = hit / bad if bad else 0.0
        if rate > max(best, k / n):
            best, out = rate, dict(cuts)
    return out


def pooled(sizes: dict, risk: float, error: float) -> set:
    """The strata that share the pooled one (None is always in it). sizes: good labels
    by stratum; error: that of one stratum."""
    out, n = {None}, sizes.get(None, 0)
    for size, name in sorted((size, name) for name, size in sizes.items() if name is not None):
        if certified(0, size, risk, error) and (certified(0, n, risk, error) or not n):
            break
        out.add(name)
        n += size
    return out


def strata(sizes: dict, risk: float, error: float) -> tuple[set, float]:
    """(those that share the pooled stratum, the error of each stratum there is then):
    the fewest merges after which error / strata is enough for each."""
    best = (set(sizes), error)
    for n in range(len(sizes), 0, -1):
        shared = pooled(sizes, risk, error / n) & set(sizes)
        left = len(sizes) - len(shared) + bool(shared)
        if left <= n:
            best = (shared, error / left)
        if left >= n:
            break
    return best


def _key() -> Column:
    """A stratum's name, in which a null is no language's."""
    return F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("lang")))


def _hits(grid: dict) -> Column:
    """The numbers of the steps that reject a document."""
    return F.array_compact(F.array(*(F.when(F.col(s) > grid[s][i], F.lit(t)) for t, (s, i) in enumerate(sequence(grid)))))


def thresholds(measured: DataFrame, labels: DataFrame, grid: dict = GRID, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(key, pooled, a cutoff or null for each signal) of each stratum with labels.
    Every labelled document counts."""
    spark = measured.sparkSession
    schema = StructType([StructField("key", StringType())]).add("pooled", "boolean")
    for s in grid:
        schema = schema.add(s, "double")
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    held = measured.where("not base_failed").join(good, "doc_id").select(_key().alias("key"), "good", _hits(grid).alias("hits"))
    held = common.stored(held, "labelled")
    sizes = {r["key"]: r["n"] for r in held.groupBy("key").agg(F.count_if(F.col("good") == 1).alias("n")).collect()}  # by labelled stratum
    if not sizes:
        return spark.createDataFrame([], schema)
    shared, error = strata(sizes, risk, error)
    names = spark.createDataFrame([(k, None if k in shared else k) for k in sizes], "key string, stratum string")
    held = held.join(names, "key").select("stratum", "good", "hits")
    every = sequence(grid)
    taken = defaultdict(set)
    first = F.array_min("hits")
    for r in held.where("good = 0").groupBy("stratum", first.alias("step")).count().where("step is not null").collect():
        taken[r["stratum"]].add(r["step"])
    if not taken:
        return spark.createDataFrame([], schema)
    own = spark.createDataFrame([(name, sorted(steps)) for name, steps in taken.items()], "stratum string, own array<int>")
    seen = defaultdict(Counter)
    step = F.array_min(F.array_intersect("hits", "own"))
    with_own = held.join(own, held["stratum"].eqNullSafe(own["stratum"])).select(held["stratum"], "good", step.alias("step"))
    for r in with_own.groupBy("stratum", "good", "step").count().collect():
        seen[r["stratum"], r["good"]][r["step"]] += r["count"]
    cuts = {}
    for name, steps in taken.items():
        (good_at, n), (bad_at, bad) = ((seen[name, g], seen[name, g].total()) for g in (1, 0))
        k = hit = 0
        counts = {}
        for t in sorted(steps):
            k, hit = k + good_at[t], hit + bad_at[t]
            counts[every[t]] = (k, n, hit, bad)
        cuts[name] = choose(counts, grid, risk, error)
    none = dict.fromkeys(grid)
    rows = [(k, k in shared, *cuts.get(None if k in shared else k, none).values()) for k in sorted(sizes)]
    return spark.createDataFrame(rows, schema)


def verdicts(measured: DataFrame, cuts: DataFrame, grid: dict) -> DataFrame:
    """measured with pooled (null: its stratum has no labels), certified (false: its
    stratum has no certified step, only base rules reject there), rejected_by and kept."""
    cuts = cuts.withColumn("certified", F.coalesce(*(F.col(s) for s in grid)).isNotNull())
    wide = measured.withColumn("key", _key()).join(cuts.select("key", "pooled", "certified", *(F.col(s).alias(f"{s}_cut") for s in grid)), "key", "left")
    hits = [F.when(F.col(s) > F.col(f"{s}_cut"), F.lit(s)) for s in grid]
    wide = wide.withColumn("certified", F.coalesce("certified", F.lit(False)))
    out = wide.withColumn("rejected_by", F.concat_ws(",", *hits)).drop("key", *(f"{s}_cut" for s in grid))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))


def judge(docs: DataFrame, labels: DataFrame, grid: dict = GRID, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The measures of each document with base_failed, rejected_by (the signals
    above their cutoffs) and kept."""
    measured = common.stored(measures(docs), "quality")
    return verdicts(measured, thresholds(measured, labels, grid, risk, error), grid)


def kept(docs: DataFrame, labels: DataFrame, grid: dict = GRID, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The rows of docs that judge keeps. Documents are measured twice rather than
    shuffled."""
    cuts = common.stored(thresholds(common.stored(measures(docs), "quality"), labels, grid, risk, error), "cuts")
    return verdicts(measures(docs, carry=True), cuts, grid).where("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "pooled", "certified", "rejected_by")
