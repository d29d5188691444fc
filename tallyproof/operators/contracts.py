"""Contracts of what comes in, as data: uploads, scopes, retrieval cases, requested
fields, names and facts, each with all that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import col
from ..functions.values import errors


def _wrong(ok: Column, message: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))


def _kind(variant: Column, field: str) -> Column:
    """The type of a field of a parsed object: STRING, BIGINT, VOID for null, and so on;
    null if the field isn't there."""
    return F.schema_of_variant(F.try_variant_get(variant, f"$.{field}", "variant"))


def _text(variant: Column, field: str) -> Column:
    """A field's text without blanks at its ends, if it is a text that has others."""
    t = F.trim(F.try_variant_get(variant, f"$.{field}", "string"))
    return F.when((_kind(variant, field) == "STRING") & (t != ""), t)


def scope_errors(text, keys: list[str], version: str, zones: list[str]) -> Column:
    """What a declared scope (JSON text) breaks, in order: an object with exactly these
    keys (among them scope_version and timezone), each a text that isn't blank, of the
    registered version, in one of the zones. A null scope declares nothing and breaks
    nothing."""
    t = col(text)
    v, own = F.try_parse_json(t), F.json_object_keys(t)
    named = F.array(*map(F.lit, sorted(keys)))
    apart = lambda a, b, m: F.when(F.size(F.array_except(a, b)) > 0, F.concat(F.lit(m), F.array_join(F.array_sort(F.array_except(a, b)), ", ")))
    rules = [apart(named, own, "missing: "), apart(own, named, "unknown: ")]
    rules += [F.when(F.array_contains(own, k) & _text(v, k).isNull(), F.lit(f"{k}: not a text")) for k in sorted(keys)]
    rules += [F.when(_text(v, "scope_version") != version, F.lit("scope_version: not registered")), F.when(~_text(v, "timezone").isin(zones), F.lit("timezone: not registered"))]
    return F.when(t.isNull(), F.array().cast("array<string>")).when(own.isNull(), F.array(F.lit("not an object"))).otherwise(errors(*rules))


def scope_digest(text, keys: list[str]) -> Column:
    """SHA-256 of the declaration with its keys in order, so that neither their order nor
    spaces between them matter."""
    v = F.try_parse_json(col(text))
    fields = (F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in sorted(keys))
    return F.when(col(text).isNotNull(), F.sha2(F.to_json(F.struct(*fields)), 256))


def registered_uploads(uploads: DataFrame, formats: DataFrame, keys: list[str], scope_version: str, zones: list[str]) -> DataFrame:
    """The uploads with the array errors and the label of their window.

    formats: (registry_version, mapping_version, whole_months, manual, scoped, datasets):
    the formats that each version of the registry knows; whether a window must be one
    whole month or may be any whole days; whether rows were entered by hand, which asks
    for a document and a line; whether a scope may be declared; the datasets it may
    carry (null: all). uploads: upload_id, registry_version, mapping_version, dataset_id,
    period_start, period_end, document_id, source_block_line, aggregation_scope,
    file_sha256, extracted_at (all text but source_block_line). Of a format unknown to
    its version only that is told, next to what needs no format."""
    versions = formats.select("registry_version").distinct().withColumn("known", F.lit(True))
    df = uploads.join(versions, "registry_version", "left").join(formats.withColumn("found", F.lit(True)), ["registry_version", "mapping_version"], "left")
    day = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).try_cast("date"))
    start, end, manual = day("period_start"), day("period_end"), F.col("manual")
    month = (F.dayofmonth(start) == 1) & (end == F.last_day(start))
    window = F.when(start.isNull() | end.isNull(), "window: not two days").when(start > end, "window: ends before it starts").when(F.col("whole_months") & ~month, "window: not a month")
    placed = (F.trim("document_id") != "") & (F.col("source_block_line") >= 1)
    told = F.col("document_id").isNotNull() | F.col("source_block_line").isNotNull()
    scope = F.col("aggregation_scope")
    moment = F.col("extracted_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})$") & F.col("extracted_at").try_cast("timestamp").isNotNull()
    rules = errors(
        F.when(F.col("known").isNull(), "registry version").when(F.col("found").isNull(), "format"),
        F.when(manual & ~F.coalesce(placed, F.lit(False)), "document and line needed"), F.when(~manual & told, "document and line not known to the format"),
        F.when(F.col("datasets").isNotNull() & ~F.array_contains("datasets", F.col("dataset_id")), "dataset"), F.when(~F.col("scoped") & scope.isNotNull(), "scope not known to the format"),
        _wrong(F.col("file_sha256").rlike("^[0-9a-f]{64}$"), "digest"), window, _wrong(moment, "extracted_at"),
    )
    inner = F.transform(scope_errors("aggregation_scope", keys, scope_version, zones), lambda x: F.concat(F.lit("scope "), x))
    label = F.when(month, F.date_format(start, "yyyy-MM")).when(start <= end, F.concat_ws("..", "period_start", "period_end"))
    return df.select(*(uploads[c] for c in uploads.columns), F.concat(rules, F.when(F.col("scoped"), inner).otherwise(F.array().cast("array<string>"))).alias("errors"), label.alias("window"))


def case_errors(cases: DataFrame, place: str, raw: str, types: list[str]) -> DataFrame:
    """(place, case_id, query, errors) of retrieval cases (JSON text, one a row): an object
    with case_id and query (texts that aren't blank and that no earlier case has),
    case_type (one of types), expected_entity and expected_slot (texts or null) and the
    lists of texts expected_period_terms and expected_terms. A repeated one is told with
    the place of the first. Places meet by a join of counted values, so that a value
    that very many cases share is no group held by one task."""
    texts, options, lists = ["case_id", "query"], ["expected_entity", "expected_slot"], ["expected_period_terms", "expected_terms"]
    v, own = F.try_parse_json(F.col(raw)), F.json_object_keys(raw)
    there = lambda f: F.array_contains(own, f)
    rules = [F.when(~there(f), F.lit(f"{f}: missing")) for f in sorted([*texts, "case_type", *options, *lists])]
    rules += [F.when(there(f) & _text(v, f).isNull(), F.lit(f"{f}: not a text")) for f in texts]
    kind = F.try_variant_get(v, "$.case_type", "string")
    rules.append(F.when(there("case_type") & ~((_kind(v, "case_type") == "STRING") & kind.isin(types)), F.lit("case_type: not registered")))
    rules += [F.when(~_kind(v, f).isin("STRING", "VOID"), F.lit(f"{f}: not a text or null")) for f in options]
    blank = lambda f: F.exists(F.try_variant_get(v, f"$.{f}", "array<string>"), lambda x: x.isNull() | (F.trim(x) == ""))
    rules += [F.when(there(f) & (~_kind(v, f).isin("ARRAY<STRING>", "ARRAY<VOID>") | blank(f)), F.lit(f"{f}: not a list of texts")) for f in lists]
    own_errors = F.when(own.isNull(), F.array(F.lit("not an object"))).otherwise(errors(*rules))
    df = cases.select(F.col(place), _text(v, "case_id").alias("case_id"), _text(v, "query").alias("query"), own_errors.alias("errors"))
    for f in texts:
        first = df.where(F.col(f).isNotNull()).groupBy(f).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        told = F.when(F.col(place) > F.col("first"), F.array(F.concat(F.lit(f"{f}: as case "), F.col("first").cast("string"))))
        df = df.join(first, f, "left").withColumn("errors", F.concat("errors", F.coalesce(told, F.array().cast("array<string>")))).drop("first")
    return df.select(place, "case_id", "query", "errors")


def requested_fields(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """(request_id, dataset_id, selected, errors): the fields that each request (request_id,
    dataset_id, fields) reads, sorted. registry: (dataset_id, field, is_key). Null fields
    stand for all of the dataset that aren't keys; else they must be distinct, registered
    and no keys. A dataset's fields are one row, so requests meet them in one join."""
    allowed = registry.where("not is_key").groupBy("dataset_id").agg(F.array_sort(F.collect_set("field")).alias("allowed"))
    known = registry.select("dataset_id").distinct().join(allowed, "dataset_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>"))).withColumn("known", F.lit(True))
    df = requests.join(known, "dataset_id", "left")
    asked, other = F.col("fields"), F.array_sort(F.array_except("fields", "allowed"))
    told = errors(
        F.when(F.col("known").isNull(), F.lit("dataset")), F.when(F.size(asked) == 0, F.lit("no fields")), F.when(F.size(F.array_distinct(asked)) < F.size(asked), F.lit("repeated fields")),
        F.when(F.exists(asked, lambda x: x.isNull()), F.lit("null field")), F.when(F.size(other) > 0, F.concat(F.lit("not registered or keys: "), F.array_join(other, ", "))),
    )
    chosen = F.when(F.size(told) == 0, F.coalesce(F.array_sort(asked), F.col("allowed")))
    return df.select("request_id", "dataset_id", chosen.alias("selected"), told.alias("errors"))


def forbidden_names(texts: DataFrame, names: DataFrame, aliases: list[str]) -> DataFrame:
    """(kind, place, alias, n): how many texts (place, text) of a place hold an alias that
    may not be used any more, and how many of its names (place, name) are one."""
    listed = F.array(*map(F.lit, aliases))
    held = texts.select(F.lit("text").alias("kind"), "place", F.explode(F.filter(listed, lambda a: F.contains(F.col("text"), a))).alias("alias"))
    named = names.where(F.col("name").isin(aliases)).select(F.lit("name").alias("kind"), "place", F.col("name").alias("alias"))
    return held.unionByName(named).groupBy("kind", "place", "alias").agg(F.count("*").alias("n"))


def slot_coverage(entities: DataFrame, facts: DataFrame, entity: str, slots: dict, text: str) -> DataFrame:
    """(entity, slot, n, errors) of every expected contract, which must be there once.

    slots: for each slot its fields (columns of facts that must not be null or blank),
    terms (each in the fact's text, in either case) and any_of (lists of which one must
    be). What any of its facts breaks is told once, in the order of the rules."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = lambda t: F.contains(low, F.lit(t.lower()))
    either = lambda ts: F.greatest(F.lit(False), F.lit(False), *map(held, ts))
    rules = {}
    for slot, r in slots.items():
        broken = [(f"{c}: empty", F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in r.get("fields", [])]
        broken += [(f"no {t}", ~held(t)) for t in r.get("terms", [])] + [(f"none of {', '.join(ts)}", ~either(ts)) for ts in r.get("any_of", [])]
        rules[slot] = broken
    most = max((len(x) for x in rules.values()), default=0)
    at = lambda i: F.coalesce(*(F.when(F.col("slot") == s, x[i][1]) for s, x in rules.items() if i < len(x)), F.lit(False))
    seen = facts.where(F.col("slot").isin(list(slots))).groupBy(entity, "slot").agg(F.count("*").alias("n"), *(F.max(at(i)).alias(f"broken_{i}") for i in range(most)))
    grid = entities.select(entity).distinct().select(entity, F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    df = grid.join(seen, [entity, "slot"], "left")
    n = F.coalesce("n", F.lit(0))
    named = lambda i: F.coalesce(*(F.when(F.col("slot") == s, F.lit(x[i][0])) for s, x in rules.items() if i < len(x)))
    told = errors(F.when(n == 0, F.lit("missing")).when(n > 1, F.lit("repeated")), *(F.when(F.col(f"broken_{i}"), named(i)) for i in range(most)))
    return df.select(entity, "slot", n.alias("n"), told.alias("errors"))


def rederived(output: DataFrame, keys: list[str], rates: dict, flag: tuple[str, Column], notes: str, tolerance: float) -> DataFrame:
    """(keys, errors) of a stored output: each rate against what it is made of, its flag
    against the one that is found again, and whether notes are there. A rate that can't
    be made of its parts must be null."""
    close = lambda a, e: F.abs(a - e) <= tolerance
    told = []
    for name, again in rates.items():
        a = F.col(name)
        told.append(F.when(again.isNull() & a.isNotNull(), F.lit(f"{name}: unexpected")).when(again.isNotNull() & a.isNull(), F.lit(f"{name}: missing")).when(~close(a, again), F.lit(f"{name}: differs")))
    name, found = flag
    told += [F.when(~F.col(name).eqNullSafe(found), F.lit(f"{name}: differs")), F.when(F.coalesce(F.trim(notes), F.lit("")) == "", F.lit(f"{notes}: empty"))]
    return output.select(*keys, errors(*told).alias("errors"))
