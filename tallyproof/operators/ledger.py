"""Batches, revisions, published snapshots and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numbers import close
from ..sources import publication
from . import panels as P


def judged(batches: DataFrame, scope: list[str]) -> DataFrame:
    """The verdict on each batch (scope columns, batch_id, upload_id, bytes, supersedes,
    extracted_at, valid), in order of extraction: a repeat of a retry key returns the
    first row, other bytes under an upload id are held, and a revision must name the
    batch before it in its scope."""
    retry = Window.partitionBy(*scope, "upload_id", "bytes").orderBy("extracted_at", "batch_id")
    upload = Window.partitionBy("upload_id").orderBy("extracted_at", "batch_id")
    df = batches.withColumns({"nth": F.row_number().over(retry), "other": F.first("bytes").over(upload) != F.col("bytes")})
    chain = Window.partitionBy(*scope, (F.col("nth") == 1) & F.col("valid") & ~F.col("other")).orderBy("extracted_at", "batch_id")
    df = df.withColumns({"before": F.lag("batch_id").over(chain), "before_at": F.lag("extracted_at").over(chain)})
    verdict = (
        F.when(F.col("nth") > 1, "repeat").when(F.col("other"), "held: other bytes").when(~F.col("valid"), "held: invalid rows")
        .when(F.col("before").isNotNull() & F.col("supersedes").isNull(), "held: no predecessor given")
        .when(~F.col("supersedes").eqNullSafe(F.col("before")), "held: wrong predecessor").when(F.col("before_at") > F.col("extracted_at"), "held: backwards in time").otherwise("validated")
    )
    return df.withColumn("verdict", verdict).drop("nth", "other", "before", "before_at")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks and the other way round, each as often."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float | dict) -> DataFrame:
    """(keys, field, in_left, in_right, agrees) for each field of both sides. A null
    agrees with a null only. tolerance: one for all fields, or one for each."""
    long = lambda d, n: d.unpivot(keys, fields, "field", n)
    cast = lambda d: d.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields))
    both = long(cast(left), "l").withColumn("in_left", F.lit(True)).join(long(cast(right), "r").withColumn("in_right", F.lit(True)), [*keys, "field"], "full_outer")
    limit = F.lit(tolerance) if not isinstance(tolerance, dict) else F.create_map(*(F.lit(x) for kv in tolerance.items() for x in kv))[F.col("field")]
    agrees = close("l", "r", limit)
    return both.select(*keys, "field", F.coalesce("in_left", F.lit(False)).alias("in_left"), F.coalesce("in_right", F.lit(False)).alias("in_right"), agrees.alias("agrees"))


def reverified(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome) of rows that a stored result and the one computed again don't
    share: missing (from the stored one), unexpected, or changed in another column."""
    values = [c for c in again.columns if c not in keys]
    pack = lambda d, n: d.select(*keys, F.struct(*values).alias(n), F.lit(True).alias(f"has_{n}"))
    both = pack(stored, "was").join(pack(again, "now"), keys, "full_outer")
    outcome = F.when(F.col("has_was").isNull(), "missing").when(F.col("has_now").isNull(), "unexpected").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(*keys, outcome.alias("outcome")).where("outcome is not null")


def set_digest(rows: DataFrame, key: str, h: str) -> DataFrame:
    """(key, n, digest): a digest of each key's row hashes (hexadecimal) that doesn't
    depend on their order: exact sums of four of their parts, so that partial sums
    meet in the shuffle and no list is built."""
    part = lambda i: F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    g = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(part(i)).alias(f"s{i}") for i in range(4)))
    return g.select(key, "n", F.sha2(F.concat_ws("-", "n", *(f"s{i}" for i in range(4))), 256).alias("digest"))


def digest_sql(h: str) -> str:
    """The same digest in DuckDB."""
    parts = ", ".join(f"CAST(sum(CAST(CAST('0x' || substr({h}, {1 + 15 * i}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4))
    return f"sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {parts}))"


def published(rows: DataFrame, path: str, key: str, h: str, unique: list[str]) -> DataFrame:
    """Publishes each key's rows under the id that follows from them and reads back what
    the manifest lists: (key, snapshot_id, n, n_repeated), n_repeated being rows whose
    unique columns came before. A publication that is already there is not written again;
    one whose writer was lost isn't there."""
    named = rows.join(set_digest(rows, key, h).select(key, F.col("digest").alias("snapshot_id")), key)
    publication.publish(named, path, "snapshot_id")
    out = publication.read(rows.sparkSession, path, named.schema).groupBy(key, "snapshot_id", *unique).agg(F.count("*").alias("m"))
    return out.groupBy(key, "snapshot_id").agg(F.sum("m").alias("n"), F.sum(F.col("m") - 1).alias("n_repeated"))


def islands(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, ranges) of distinct numbers: runs one after another as from..to, in order."""
    run = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    g = rows.select(key, number).distinct().withColumn("_run", run).groupBy(key, "_run").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    return g.groupBy(key).agg(_listed("a", "b").alias("ranges"))


def _listed(a: str, b: str):
    each = F.array_sort(F.collect_list(F.when(F.col(a) <= F.col(b), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))))
    return F.array_join(F.transform(each, lambda x: F.concat_ws("..", x["a"].cast("string"), x["b"].cast("string"))), ",")


def accounted(lines: DataFrame, expected: DataFrame, key: str, number: str, total: str) -> DataFrame:
    """(key, n_expected, n_found, missing, repeated, unexpected, complete): the lines of
    each key against the numbers 1 to its total in expected (key, total). What is missing,
    there more than once, or of no expected number is told as ranges from..to; expected
    numbers are never listed one by one. A line without a number counts as found and
    leaves its key incomplete; a key that isn't expected has all its lines unexpected."""
    counts = lines.groupBy(key, number).agg(F.count("*").alias("_m"))
    found = counts.groupBy(key).agg(F.sum("_m").alias("n_found"), F.count_if(F.col(number).isNull()).alias("_none"))
    held = counts.where(F.col(number).isNotNull()).join(expected.select(key, F.col(total).alias("_total")), key, "left")
    good = (F.col(number) >= 1) & (F.col(number) <= F.col("_total"))
    inside, outside = held.where(good), held.where(~F.coalesce(good, F.lit(False)))
    # the gap before each number, and the one after the last
    w = Window.partitionBy(key).orderBy(number)
    gaps = inside.select(key, (F.coalesce(F.lag(number).over(w), F.lit(0)) + 1).alias("a"), (F.col(number) - 1).alias("b"))
    last = expected.select(key, F.col(total).alias("b")).join(inside.groupBy(key).agg(F.max(number).alias("_last")), key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).alias("a"), "b")
    missing = gaps.unionByName(last).groupBy(key).agg(_listed("a", "b").alias("missing"))
    out = expected.select(key, F.col(total).alias("n_expected")).join(found, key, "full_outer").join(missing, key, "left")
    out = out.join(islands(inside.where("_m > 1"), key, number).withColumnRenamed("ranges", "repeated"), key, "left").join(islands(outside, key, number).withColumnRenamed("ranges", "unexpected"), key, "left")
    text = ["missing", "repeated", "unexpected"]
    out = out.withColumns({c: F.coalesce(c, F.lit("")) for c in text} | {"n_found": F.coalesce("n_found", F.lit(0)), "_none": F.coalesce("_none", F.lit(0))})
    complete = F.col("n_expected").isNotNull() & (F.concat(*text) == "") & (F.col("_none") == 0)
    return out.select(key, "n_expected", "n_found", *text, complete.alias("complete"))


def plan_refusals(plans: DataFrame, registered: DataFrame, bindings: DataFrame) -> DataFrame:
    """(plan, dataset, refusals): why a plan's dataset can't be registered. plans: plan,
    dataset, format, binding; registered: dataset; bindings: those in use."""
    mark = lambda d, c, n: d.select(c).distinct().withColumn(n, F.lit(True))
    formats = plans.groupBy("plan").agg((F.min("format") != F.max("format")).alias("several"))
    out = plans.join(formats, "plan").join(mark(registered, "dataset", "old"), "dataset", "left").join(mark(bindings, "binding", "known"), "binding", "left")
    refusals = F.concat_ws("; ", F.when(F.col("old"), "already_registered"), F.when(F.col("several"), "several_formats"), F.when(F.col("known").isNull(), "unknown_binding"))
    return out.select("plan", "dataset", refusals.alias("refusals"))


def formulas_checked(result: DataFrame, formulas: dict, tolerance: float) -> DataFrame:
    """(field, n_agree, n_both_missing, n_differ) of each field of a result against its
    formula over the result's own columns, in one pass."""
    one = lambda n, e: F.struct(F.lit(n).alias("field"), F.col(n).cast("double").alias("was"), F.expr(e).cast("double").alias("now"))
    rows = result.select(F.inline(F.array(*(one(n, e) for n, e in formulas.items()))))
    none = F.col("was").isNull() & F.col("now").isNull()
    same = close("was", "now", tolerance)
    return rows.groupBy("field").agg(F.count_if(same & ~none).alias("n_agree"), F.count_if(none).alias("n_both_missing"), F.count_if(~same).alias("n_differ"))


def parity(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], limits: dict) -> DataFrame:
    """Counts by field of values that agree, that differ, that one side alone lacks, and
    of rows that one side alone lacks."""
    long = lambda d, n: d.select(*keys, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(keys, fields, "field", n).withColumn(f"in_{n}", F.lit(True))
    both = long(left, "l").join(long(right, "r"), [*keys, "field"], "full_outer")
    limit = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv))[F.col("field")]
    agrees, no_l, no_r = close("l", "r", limit), F.col("l").isNull(), F.col("r").isNull()
    return both.groupBy("field").agg(
        F.count_if(agrees).alias("n_agree"), F.count_if(~agrees & ~no_l & ~no_r).alias("n_differ"), F.count_if(F.col("in_l") & no_l & ~no_r).alias("n_missing_left"),
        F.count_if(F.col("in_r") & no_r & ~no_l).alias("n_missing_right"), F.count_if(F.col("in_l").isNull()).alias("n_left_absent"), F.count_if(F.col("in_r").isNull()).alias("n_right_absent"),
    )


def facts_checked(facts: DataFrame, panel: DataFrame, skus: DataFrame, slots: dict, listing: str, tolerance: float, top: int = 3, parts: int | None = None) -> DataFrame:
    """(store_id, period_month, slot, field, outcome) of each observed value of facts
    (store_id, period_month, slot, observed_values as JSON) against the panel's, and of
    the listing slot's items against the top list: agrees, differs, both missing. parts:
    tasks among which the store-months are dealt."""
    keys = ["store_id", "period_month"]
    every = sorted({f for fs in slots.values() for f in fs})
    read = P.dealt(facts, parts, *keys).withColumn("seen", F.from_json("observed_values", ", ".join(f"{f} double" for f in every) + ", top_items array<string>"))
    item = F.concat_ws(" ", "sku_name", F.col("sales_volume").cast("string"))
    named = skus.where(F.col("sku_rank") <= top).select("store_id", F.date_format("period_start", "yyyy-MM").alias("period_month"), "sku_name", "sales_volume")
    lists = P.dealt(named, parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("own_items"))
    values = P.dealt(panel.select(*keys, *(F.col(f).cast("double").alias(f) for f in every)), parts, *keys)
    met = read.join(values, keys).join(lists, keys, "left")
    told = lambda f, a, b, same: F.struct(F.lit(f).alias("field"), F.when(a.isNull() & b.isNull(), "both missing").when(F.coalesce(same, F.lit(False)), "agrees").otherwise("differs").alias("outcome"))
    cell = lambda f: told(f, F.col("seen")[f], F.col(f), F.abs(F.col("seen")[f] - F.col(f)) <= tolerance)
    seen, own = F.array_sort(F.col("seen.top_items")), F.coalesce("own_items", F.array().cast("array<string>"))
    rows = F.array().cast("array<struct<field:string,outcome:string>>")
    for slot, fs in slots.items():
        cells = [*map(cell, fs), *([told("top_items", seen, own, seen == own)] if slot == listing else [])]
        rows = F.when(F.col("slot") == slot, F.array(*cells)).otherwise(rows)
    return met.select(*keys, "slot", F.inline(rows))


def metadata_errors(statuses: list[str], semantics: str):
    """What a batch's metadata (file_digest, extracted_at, received_at, coverage_start,
    coverage_end, status, semantics) breaks, in order; semantics: those registered."""
    bad = lambda ok, name: F.when(~F.coalesce(ok, F.lit(False)), name)
    rules = (
        bad(F.col("file_digest").rlike("^[0-9a-f]{64}$"), "digest"), bad(F.col("received_at") >= F.col("extracted_at"), "received before extracted"),
        bad(F.col("coverage_start") <= F.col("coverage_end"), "coverage order"), bad(F.col("coverage_end") <= F.col("extracted_at"), "coverage after extraction"),
        bad(F.col("status").isin(statuses), "status"), bad(F.col("semantics") == semantics, "semantics"),
    )
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def identities(panel: DataFrame, formulas: dict, tolerance: float) -> DataFrame:
    """(metric, n_checked, n_off, n_one_missing) of metrics against their formulas."""
    one = lambda n, e: F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("actual"), F.expr(e).cast("double").alias("expected"))
    rows = panel.select(F.inline(F.array(*(one(n, e) for n, e in formulas.items()))))
    apart = F.abs(F.col("actual") - F.col("expected"))
    missing = F.col("actual").isNull() != F.col("expected").isNull()
    return rows.groupBy("metric").agg(F.count(apart).alias("n_checked"), F.count_if(apart > tolerance).alias("n_off"), F.count_if(missing).alias("n_one_missing"))


def documented(fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(field, documented): whether a line of the dictionary, - `name`: ..., defines it."""
    name = F.regexp_extract("line", r"^\s*[-*]\s*`([A-Za-z0-9_]+)`\s*:", 1)
    known = dictionary.select(name.alias("field")).where("field <> ''").distinct().withColumn("known", F.lit(True))
    return fields.distinct().join(known, "field", "left").select("field", F.col("known").isNotNull().alias("documented"))


def contract_errors(registries: DataFrame, grains: list[str]) -> DataFrame:
    """(registry, dataset_id, errors) of registries (registry, datasets: array of dataset_id,
    grain, key_fields, fields): grains of the list, ids that are not used twice, keys that
    are there and among the fields, fields named once."""
    rows = registries.select("registry", F.inline("datasets"))
    many = F.count("*").over(Window.partitionBy("registry", "dataset_id")) > 1
    keys, fields = F.coalesce("key_fields", F.array().cast("array<string>")), F.coalesce("fields", F.array().cast("array<string>"))
    errors = F.concat_ws(
        "; ", F.when(F.coalesce("dataset_id", F.lit("")) == "", "dataset_id"), F.when(many, "repeated dataset"), F.when(~F.coalesce(F.col("grain").isin(grains), F.lit(False)), "grain"),
        F.when(F.size(keys) == 0, "no keys"), F.when(F.size(F.array_except(keys, fields)) > 0, "key is no field"), F.when(F.size(F.array_distinct(fields)) < F.size(fields), "repeated field"),
    )
    return rows.select("registry", "dataset_id", errors.alias("errors"))
