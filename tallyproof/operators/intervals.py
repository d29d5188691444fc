"""Windows of days: coverage, gaps, overlaps, and conservative range totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import days

REASONS = ("ranked_records_only", "aggregation_scope_unreviewed", "ambiguous_source_scope_or_window", "no_contained_source_records", "reported_value", "missing_reported_value", "aggregation_not_registered", "missing_dates", "aggregation_requires_daily_source_records", "duplicate_daily_records", "missing_metric_values", "complete_daily_source_values")


def coverage(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, requested_days, covered_days, missing): days of [first, last] that the
    windows [period_start, period_end] cover; missing lists the gaps as from..to.
    Windows are sorted and swept, never exploded into days."""
    w = Window.partitionBy(*keys).orderBy("cs", "ce")
    clipped = windows.withColumns({"cs": F.greatest("period_start", "first"), "ce": F.least("period_end", "last")}).where("cs <= ce")
    swept = clipped.withColumn("reach", F.coalesce(F.max("ce").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.date_sub("first", 1)))
    fresh = F.greatest(F.lit(0), F.datediff("ce", F.greatest("cs", F.date_add("reach", 1))) + 1)
    gap = F.when(F.datediff("cs", "reach") > 1, F.concat(F.date_add("reach", 1).cast("string"), F.lit(".."), F.date_sub("cs", 1).cast("string")))
    g = swept.withColumns({"fresh": fresh, "gap": gap}).groupBy(*keys).agg(F.first("first").alias("first"), F.first("last").alias("last"), F.sum("fresh").alias("covered_days"), F.array_sort(F.collect_list("gap")).alias("gaps"), F.max("ce").alias("end"))
    tail = F.when(F.col("end") < F.col("last"), F.concat(F.date_add("end", 1).cast("string"), F.lit(".."), F.col("last").cast("string")))
    return g.select(*keys, days("first", "last").alias("requested_days"), "covered_days", F.concat_ws(",", "gaps", tail).alias("missing"))


def overlaps(windows: DataFrame, key: str, by: str) -> DataFrame:
    """Pairs of a key's windows that share days, with the days that they share. Each
    window also stands under every month that it touches, so that the join has an
    equal key of bounded size; a pair is told in the first month that both touch."""
    months = F.explode(F.sequence(F.trunc("period_start", "MM"), F.trunc("period_end", "MM"), F.expr("interval 1 month"))).alias("month")
    w = windows.select(key, by, "period_start", "period_end", months)
    a, b = w.alias("a"), w.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.month") == F.col("b.month")) & (F.struct("a.period_start", f"a.{by}") < F.struct("b.period_start", f"b.{by}")) & (F.col("b.period_start") <= F.col("a.period_end"))
    start, end = F.greatest("a.period_start", "b.period_start"), F.least("a.period_end", "b.period_end")
    return a.join(b, on).where(F.col("a.month") == F.trunc(start, "MM")).select(F.col(f"a.{key}").alias(key), F.col(f"a.{by}").alias("left"), F.col(f"b.{by}").alias("right"), start.alias("start"), end.alias("end"))


#: Days are counted from BEFORE days before 1970; a cell of level l has BASE**l of them.
BASE, LEVELS, BEFORE = 32, 4, 4_000_000


def _day(c):
    return F.datediff(c, F.lit("1970-01-01").cast("date")) + BEFORE


def _cell(level, x):
    return F.struct(F.lit(level).alias("level"), x.cast("int").alias("x"))


def _above(day, tag: int):
    """The cells of every level that hold a day."""
    return F.array(*(_cell(tag + k, F.floor(day / BASE**k)) for k in range(LEVELS)))


def _parts(first, last, tag: int):
    """The fewest cells that make up the days from first to last; none if last < first."""
    def run(level, low, high):
        return F.when(low < high, F.transform(F.sequence(low.cast("int"), (high - 1).cast("int")), lambda x: _cell(tag + level, x))).otherwise(F.array().cast("array<struct<level:int,x:int>>"))

    out = []
    for k in range(LEVELS):
        low, high = F.ceil(first / BASE**k), F.floor((last + 1) / BASE**k)
        up_low, up_high = F.ceil(first / BASE ** (k + 1)), F.floor((last + 1) / BASE ** (k + 1))
        inner = (up_low < up_high) & F.lit(k + 1 < LEVELS)
        out += [run(k, low, F.when(inner, up_low * BASE).otherwise(high)), run(k, F.when(inner, up_high * BASE).otherwise(high), high)]
    return F.concat(*out)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_days: tuple[str, str], right_days: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose days [from, to] meet, each once, with the
    columns of both. Either the right one starts within the left one, or the left one
    starts within the right one after its first day. Each is a day within an interval:
    the day stands under the LEVELS cells that hold it, the interval under the few cells
    that make it up, and they meet in exactly one. So all rows that the join compares are
    pairs of the result, and a key with very many windows is spread over its cells. Rows
    with a null day, or that end before they start, meet nothing."""
    (a, b), (c, d) = ([_day(F.col(x)) for x in days_] for days_ in (left_days, right_days))
    cells = [F.concat(_parts(a, b, 0), _above(a, LEVELS)), F.concat(_above(c, 0), _parts(c + 1, d, LEVELS))]
    dealt = [df.where(F.col(x) <= F.col(y)).withColumn("_cell", F.explode(cell)) for df, (x, y), cell in zip((left, right), (left_days, right_days), cells, strict=True)]
    return dealt[0].join(dealt[1], [*keys, "_cell"]).drop("_cell")


def range_values(records: DataFrame, requests: DataFrame, additive: list[str], plain: list[str]) -> DataFrame:
    """(store_id, first, last, field, value, basis, reason) of each request and field.

    records: store_id, period_start, period_end, batch, scope (null: unreviewed),
    grain and the fields; requests: store_id, first, last. A value is given only if
    one reported window is the request, or if days without overlap fill it; the
    first reason that applies is told. A store without records still has a row."""
    fields = [*additive, *plain]
    met = overlapping(requests, records, ["store_id"], ("first", "last"), ("period_start", "period_end"))
    asked = requests.join(met.select("store_id", "first", "last").distinct(), ["store_id", "first", "last"], "left_anti")
    met = met.unionByName(asked, allowMissingColumns=True)
    long = met.select("store_id", "first", "last", "period_start", "period_end", "batch", "scope", "grain", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("decimal(38,4)").alias("v"), F.lit(f in additive).alias("adds")) for f in fields))))
    real = F.col("period_start").isNotNull()
    inside = real & (F.col("period_start") >= F.col("first")) & (F.col("period_end") <= F.col("last"))
    key = ["store_id", "first", "last", "field"]
    w = Window.partitionBy(*key).orderBy("period_start", "period_end", "batch")
    reach = F.max("period_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    long = long.withColumns({"inside": inside, "clash": real & (F.col("period_start") <= reach), "n_days": days("period_start", "period_end"), "next": F.lead("period_start").over(w)})
    g = long.groupBy(*key, "adds").agg(
        F.count_if(real).alias("n"), F.count_if("inside").alias("n_in"), F.count_if(real & ~F.col("inside")).alias("crossing"), F.count_if("clash").alias("clashes"),
        F.count_if(real & (F.col("grain") != "store_period")).alias("ranked"), F.countDistinct(F.when(real, F.coalesce("scope", F.lit("\\N")))).alias("scopes"),
        F.count_if(real & F.col("scope").isNull()).alias("unreviewed"), F.count_if(F.col("inside") & (F.col("n_days") > 1)).alias("long_"),
        F.count_if(F.col("inside") & F.col("v").isNull()).alias("empty"), F.sum(F.when(F.col("inside"), F.col("v"))).alias("total"),
        F.max(F.when(F.col("inside") & (F.col("period_start") == F.col("first")) & (F.col("period_end") == F.col("last")), 1)).alias("exact"),
        F.countDistinct(F.when(F.col("inside"), F.col("period_start"))).alias("starts"), F.sum(F.when(F.col("inside") & ~F.coalesce("clash", F.lit(False)), F.col("n_days"))).alias("covered"),
    )
    ambiguous = (F.col("clashes") > 0) | (F.col("crossing") > 0) | (F.col("scopes") > 1)
    span = days("first", "last")
    reason = (
        F.when(F.col("ranked") > 0, REASONS[0])
        .when(ambiguous & F.col("adds") & (F.col("unreviewed") > 0), REASONS[1]).when(ambiguous, REASONS[2])
        .when(F.col("n_in") == 0, REASONS[3])
        .when((F.col("n_in") == 1) & (F.col("exact") == 1), F.when(F.col("empty") == 0, REASONS[4]).otherwise(REASONS[5]))
        .when(~F.col("adds"), REASONS[6]).when(F.col("unreviewed") > 0, REASONS[1])
        .when(F.coalesce("covered", F.lit(0)) < span, REASONS[7]).when(F.col("long_") > 0, REASONS[8])
        .when((F.col("n_in") != span) | (F.col("starts") != F.col("n_in")), REASONS[9]).when(F.col("empty") > 0, REASONS[10]).otherwise(REASONS[11])
    )
    basis = F.when(F.col("reason").isin(REASONS[4], REASONS[5]), "reported_window").when(F.col("reason") == REASONS[11], "sum_non_overlapping_days").otherwise("source_records")
    value = F.when(F.col("reason").isin(REASONS[4], REASONS[11]), F.col("total"))
    return g.withColumn("reason", reason).select(*key, value.alias("value"), basis.alias("basis"), "reason")


def scopes(records: DataFrame, windows: DataFrame) -> DataFrame:
    """(store_id, role, signature) of the windows (store_id, role, first, last) with
    records inside: the signature that all of them have, or null if one has none or
    they differ."""
    inside = windows.join(records.select("store_id", "period_start", "period_end", "signature"), "store_id")
    inside = inside.where("period_start >= first and period_end <= last")
    one = (F.count("*") == F.count("signature")) & (F.min("signature") == F.max("signature"))
    return inside.groupBy("store_id", "role").agg(F.when(one, F.min("signature")).alias("signature"))


def scope_reason(left: str, right: str):
    """Why two windows' scopes don't allow a comparison; null if they do."""
    unknown = F.col(left).isNull() | F.col(right).isNull()
    return F.when(unknown, "comparison_scope_unreviewed").when(F.col(left) != F.col(right), "different_comparison_scopes")


def compared(values: DataFrame, fields: list[str], primary: list[str], signatures: DataFrame) -> DataFrame:
    """Baseline and current values of each store and field: difference, direction and
    the reasons that stand against it, in a fixed order. fields: those with direction
    rules; primary: those whose bases may differ; signatures: as of scopes."""
    cols = lambda r: [F.col(c).alias(f"{r}_{c}") for c in ("value", "basis", "reason")]
    side = lambda r: values.where(F.col("role") == r).select("store_id", "field", *cols(r), days("first", "last").alias(f"days_{r}"))
    both = side("baseline").join(side("current"), ["store_id", "field"])
    for r in ("baseline", "current"):
        both = both.join(signatures.where(F.col("role") == r).select("store_id", F.col("signature").alias(f"{r}_scope")), "store_id", "left")
        known = F.col(f"{r}_value").isNotNull() & F.col(f"{r}_basis").isin("reported_window", "sum_non_overlapping_days")
        both = both.withColumn(f"supported_{r}", known)
    against = F.concat_ws(
        "; ", F.when(~F.col("field").isin(fields), "source_values_only"),
        F.when(~F.col("supported_baseline"), F.concat(F.lit("baseline: "), "baseline_reason")),
        F.when(~F.col("supported_current"), F.concat(F.lit("current: "), "current_reason")), scope_reason("baseline_scope", "current_scope"),
        F.when((F.col("baseline_basis") != F.col("current_basis")) & ~F.col("field").isin(primary), "different_summary_bases"),
    )
    out, settled = both.withColumn("against", against), F.col("against") == ""
    difference = F.col("current_value") - F.col("baseline_value")
    return out.select(
        "store_id", "field", "against", F.when(settled, "compared").otherwise("unresolved").alias("status"),
        F.when(settled, difference.cast("double")).alias("difference"), F.when(settled, F.signum(difference).cast("int")).alias("direction"),
        "supported_baseline", "supported_current", "days_baseline", "days_current",
    )


def directions(review: DataFrame, fields: list[str]) -> DataFrame:
    """The three rival statements about each comparison: lower, equal, higher."""
    h = review.where(F.col("field").isin(fields)).withColumn("hypothesis", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    verdict = F.when(F.col("status") == "unresolved", "unresolved").when(F.col("direction") == F.col("hypothesis"), "supported").otherwise("rejected")
    return h.select("store_id", "field", "hypothesis", verdict.alias("verdict"))


def alignments(review: DataFrame, groups: list[tuple]) -> DataFrame:
    """(store_id, hypothesis, verdict): whether all fields of a group moved the same
    way. A store without every field of a group gets no row for it."""
    if not groups:
        return review.select("store_id", F.lit("").alias("hypothesis"), F.lit("").alias("verdict")).where(F.lit(False))
    named = F.array(*(F.when(F.col("field").isin(f), F.struct(F.lit(n).alias("hypothesis"), F.lit(len(f)).alias("size"))) for n, f in groups))
    rows = review.withColumn("g", F.explode(F.filter(named, lambda x: x.isNotNull()))).select("store_id", "g.hypothesis", "g.size", "status", "direction")
    g = rows.groupBy("store_id", "hypothesis", "size").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "compared").alias("open"), F.min("direction").alias("low"), F.max("direction").alias("high")
    )
    verdict = F.when(F.col("open") > 0, "unresolved").when((F.col("low") == F.col("high")) & (F.col("high") != 0), "supported").otherwise("rejected")
    return g.where("n = size").select("store_id", "hypothesis", verdict.alias("verdict"))


def findings(review: DataFrame, fields: list[str], groups: list[tuple], causal: list[str], stores: int = 1) -> DataFrame:
    """(store_id, belief, evidence, findings, n_accepted, n_rejected, n_unresolved) of a
    review of two windows. Checks are both windows' values of every field and the
    comparisons of fields with direction rules. The statements that all values are
    complete, and that some are not, are rivals like any others. stores: how many are
    reviewed together."""
    told = F.col("field").isin(fields)
    checks = review.groupBy("store_id").agg(
        (2 * F.count("*") + F.count_if(told)).alias("n"),
        (F.count_if("supported_baseline") + F.count_if("supported_current") + F.count_if(told & (F.col("status") == "compared"))).alias("good"),
        F.max(F.col("days_baseline") != F.col("days_current")).alias("uneven"),
    )
    rivals = directions(review, fields).select("store_id", F.lit(None).cast("string").alias("hypothesis"), "verdict").unionByName(alignments(review, groups))
    count = lambda v, more=0: (F.count_if(F.col("verdict") == v) + more)
    judged = rivals.groupBy("store_id").agg(
        count("supported", 1).alias("n_accepted"), count("rejected", 1).alias("n_rejected"), count("unresolved").alias("n_unresolved"),
        F.bool_or(F.coalesce(F.col("hypothesis").isin(causal), F.lit(False))).alias("causal"),
    )
    open_ = F.col("n") - F.col("good")
    codes = F.concat_ws(
        ",", F.when(open_ > 0, F.concat(F.lit("unresolved_evidence:"), open_.cast("string"))), F.when(F.col("uneven"), "different_window_lengths"),
        F.when(F.lit(stores > 1), "cross_store_context_unresolved"), F.when(F.col("causal"), "causal_effects_unresolved"),
    )
    evidence = F.when(open_ == 0, "supported").when(F.col("good") > 0, "partially_supported").otherwise("missing")
    return checks.join(judged, "store_id").select(
        "store_id", F.when(open_ == 0, "active").otherwise("tentative").alias("belief"), evidence.alias("evidence"), codes.alias("findings"),
        "n_accepted", "n_rejected", "n_unresolved",
    )
