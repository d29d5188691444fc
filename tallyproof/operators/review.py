"""Evidence review over tables of rules: question types, routes, snippets, text reports
and typed facts. Rule tables are parameters: lists for ordered rules, which become one
expression, and DataFrames for dimensions that are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def any_of(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def classified(text: Column, rules: list[tuple], default: str) -> Column:
    """The label of the first rule (label, terms) with a term in the lower-case text."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(default)
    for label, terms in reversed(rules):
        out = F.when(any_of(low, terms), label).otherwise(out)
    return out


def weighted(items: DataFrame, factors: list[tuple], buckets: dict) -> DataFrame:
    """Each item's factors with their fixed weights. items have kind; factors: (kind,
    factor, bucket)."""
    spark = items.sparkSession
    rows = [(k, f, float(buckets[b])) for k, f, b in factors]
    return items.join(spark.createDataFrame(rows, "kind string, factor string, weight double"), "kind")


def routed(items: DataFrame, routes: list[tuple]) -> DataFrame:
    """Each item's factor with its sources and roles: those of (kind, factor), else those
    of (null, factor); an item without a route has one row with null source."""
    spark = items.sparkSession
    table = lambda rows, name: spark.createDataFrame(rows, f"{name}_source string, {name}_role string, factor string" + (", kind string" if name == "own" else ""))
    own = table([(s, r, f, k) for k, f, s, r in routes if k], "own")
    general = table([(s, r, f) for k, f, s, r in routes if not k], "any")
    met = items.join(own, ["kind", "factor"], "left")
    special = met.where("own_source is not null").withColumnsRenamed({"own_source": "source", "own_role": "role"})
    rest = met.where("own_source is null").drop("own_source", "own_role").join(general, "factor", "left")
    return special.unionByName(rest.withColumnsRenamed({"any_source": "source", "any_role": "role"}))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def snippets(texts: DataFrame, key: str, most: int = 3, context: int = 1, fallback: int = 8) -> DataFrame:
    """(key, snippet_no, line_start, line_end, matched_terms, status, text) of texts (key,
    text, keywords). The first lines with a keyword, with the lines around them; a line
    shown with an earlier hit is no hit of its own. Without a hit the first lines that
    aren't blank are given, and a text without any has one row without lines."""
    w = Window.partitionBy(key).orderBy("n")
    low = F.lower("line")
    lines = texts.select(key, "keywords", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    lines = lines.withColumn("terms", F.filter(F.coalesce("keywords", F.array()), lambda k: F.contains(low, F.lower(k))))
    around = [F.lag("line", i).over(w) for i in range(context, 0, -1)] + [F.col("line")] + [F.lead("line", i).over(w) for i in range(1, context + 1)]
    last = F.max("n").over(Window.partitionBy(key))
    shown = lines.withColumns({"shown": trimmed(F.concat_ws("\n", *around)), "last": last}).where(F.size("terms") > 0)
    # of a run of hits within reach of one another every (context + 1)-th counts
    run = shown.withColumn("run", F.col("n") - F.row_number().over(w))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy("n")) - 1
    hits = run.withColumn("place", place).where(F.col("place") % (context + 1) == 0)
    hits = hits.withColumn("snippet_no", F.row_number().over(w)).where(F.col("snippet_no") <= most)
    found = hits.select(
        key, "snippet_no", (F.greatest(F.lit(0), F.col("n") - context) + 1).alias("line_start"), (F.least("last", F.col("n") + context) + 1).alias("line_end"),
        F.concat_ws(",", "terms").alias("matched_terms"), F.lit("keyword_matched").alias("status"), F.col("shown").alias("text"),
    )
    bare = texts.join(found.select(key).distinct(), key, "left_anti")
    kept = F.filter(F.split("text", "\n", -1), lambda x: trimmed(x) != "")
    some = F.size(kept) > 0
    status = F.when(F.col("text").isNull(), "source_missing").when(some, "source_found_no_keyword_match").otherwise("source_empty")
    first = bare.select(
        key, F.when(some, 1).alias("snippet_no"), F.when(some, 1).alias("line_start"), F.when(some, F.least(F.lit(fallback), F.size(kept))).alias("line_end"),
        F.lit("").alias("matched_terms"), status.alias("status"), F.when(some, trimmed(F.array_join(F.slice(kept, 1, fallback), "\n"))).alias("text"),
    )
    return found.unionByName(first)


STATUS_SCORES = {"record_matched": 5, "keyword_matched": 4, "boundary_matched": 3, "source_found_no_keyword_match": 1}


def status_score(status: Column) -> Column:
    out = F.lit(0)
    for name, score in STATUS_SCORES.items():
        out = F.when(status == name, score).otherwise(out)
    return out


def coverage_score(packets: DataFrame, key: str) -> DataFrame:
    """(key, counts by status, score) of packets (key, status): 0.45 of the share with a
    record or keyword, 0.25 of that with a boundary too, 0.15 each if no source is missing
    and none fell back; no packets of a key give nothing."""
    count = lambda s: F.count_if(F.col("status") == s)
    g = packets.groupBy(key).agg(
        F.count("*").alias("total"), count("record_matched").alias("records"), count("keyword_matched").alias("keywords"), count("boundary_matched").alias("boundaries"),
        count("source_found_no_keyword_match").alias("fallbacks"), count("source_missing").alias("missing"),
    )
    direct = F.col("records") + F.col("keywords")
    score = 0.45 * direct / F.col("total") + 0.25 * (direct + F.col("boundaries")) / F.col("total") + 0.15 * (F.col("missing") == 0).cast("int") + 0.15 * (F.col("fallbacks") == 0).cast("int")
    return g.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4))


def grounded_records(expected: DataFrame, records: DataFrame, keys: list[str], by: str, fields: list[str]) -> DataFrame:
    """(by, n_expected, n_found, n_repeated, missing, gaps, status) of the expected keys:
    those without a record, with several, and the fields that are missing in one."""
    other = next(k for k in keys if k != by)
    gaps = F.filter(F.array(*(F.when(F.col(f).isNull(), F.concat_ws(":", other, F.lit(f))) for f in fields)), lambda x: x.isNotNull())
    per = records.groupBy(*keys).agg(F.count("*").alias("m"), F.array_distinct(F.flatten(F.collect_list(gaps))).alias("g"))
    met = expected.join(per, keys, "left")
    g = met.groupBy(by).agg(
        F.count("*").alias("n_expected"), F.count("m").alias("n_found"), F.count_if(F.col("m") > 1).alias("n_repeated"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("m").isNull(), F.col(other)))), ",").alias("missing"),
        F.array_join(F.array_sort(F.flatten(F.collect_list("g"))), ",").alias("gaps"),
    )
    status = F.when(F.col("n_repeated") > 0, "ambiguous_records").when(F.col("n_found") == 0, "records_missing").when(F.col("missing") != "", "partial_records")
    return g.withColumn("status", status.when(F.col("gaps") != "", "missing_fields").otherwise("record_matched"))


def ruled_facts(text: Column, rules: list[tuple], names: list[str] = (), generic: list[str] = ()) -> Column:
    """struct(type, value, product_ref, start, end) of the first rule (type, pattern, value
    or null) that a text has; without a value of its own the pattern's first group. start
    and end: the first and last character, from 1, of the pattern's leftmost match in the
    trimmed text. product_ref: the first group of the first of names (patterns) that fits,
    unless that is one of the generic names. Null if no rule fits."""

    def of(t):
        refs = [trimmed(F.regexp_extract(t, p, 1)) for p in names]
        ref = F.coalesce(*(F.when((r != "") & ~r.isin(*generic), r) for r in refs)) if names else F.lit(None).cast("string")
        out = F.lit(None).cast("struct<type:string,value:string,product_ref:string,start:int,end:int>")
        for kind, pattern, value in reversed(rules):
            got = F.lit(value) if value else trimmed(F.regexp_extract(t, pattern, 1))
            fits = t.rlike(pattern) if value else F.regexp_extract(t, pattern, 1) != ""
            whole = F.regexp_extract(t, pattern, 0)  # where these characters stand first, the pattern matches first
            start = F.instr(t, whole)
            out = F.when(fits, F.struct(F.lit(kind).alias("type"), got.alias("value"), ref.alias("product_ref"), start.alias("start"), (start + F.char_length(whole) - 1).alias("end"))).otherwise(out)
        return out

    # in a list of one, so that the text is trimmed once and the rules aren't one huge method
    return F.get(F.transform(F.array(trimmed(F.coalesce(text, F.lit("")))), of), 0)


def selected_facts(facts: DataFrame, expected: DataFrame, least_score: float) -> DataFrame:
    """(entity, selected, refusal) of each entity of expected (entity, slot, window):
    facts (entity, slot, window, statement, source, values, fields, confidence, score) of
    the expected window and slots. The first reason that applies refuses all of them: an
    incomplete trace, no values, no fields, an unregistered confidence, two facts of one
    slot; a fact below the score isn't taken, and a slot left without one is missing."""
    met = expected.join(facts, ["entity", "slot", "window"], "left")
    here = F.col("statement").isNotNull() | F.col("source").isNotNull() | F.col("score").isNotNull()
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    order = {
        "missing its statement or source trace": blank("statement") | blank("source"), "missing observed values": F.coalesce(F.size("values") <= 0, F.lit(True)),
        "missing source fields": F.coalesce(F.size("fields") <= 0, F.lit(True)), "no registered confidence": ~F.coalesce(F.col("confidence").isin("high", "medium"), F.lit(False)),
    }
    flaws = F.lit(None).cast("int")
    for i, bad in reversed(list(enumerate(order.values()))):
        flaws = F.when(here & bad, i).otherwise(flaws)
    slots = met.withColumn("flaw", flaws).groupBy("entity", "slot").agg(
        F.min("flaw").alias("flaw"), F.count_if(here).alias("n"), F.count_if(here & (F.col("score") >= least_score)).alias("n_taken")
    )
    names = F.array(*map(F.lit, order))
    g = slots.groupBy("entity").agg(
        F.min("flaw").alias("flaw"), F.bool_or(F.col("n") > 1).alias("several"), F.sum(F.least("n_taken", F.lit(1))).alias("taken"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_taken") == 0, F.col("slot")))), ",").alias("lacking"),
    )
    refusal = F.when(F.col("flaw").isNotNull(), F.get(names, F.col("flaw"))).when(F.col("several"), "several facts of one slot and window").when(F.col("lacking") != "", F.concat(F.lit("missing: "), "lacking"))
    return g.select("entity", F.when(refusal.isNull(), F.col("taken")).otherwise(0).alias("selected"), refusal.alias("refusal"))


class ReportProfile:
    """How a text report is read. header: a pattern whose group is the store's alias;
    stores: a table (alias, store); window: the label of the window's line; fields: label to (field,
    format), format number or percent; sections: label to field of a list 'name value'
    with at most `top` entries; notes: lines without meaning; pending: labels whose unit
    isn't known."""

    def __init__(self, header: str, stores: DataFrame, window: str, fields: dict, sections: dict, notes: list, pending: list, top: int = 3):
        self.header, self.stores, self.window, self.fields = header, stores, window, fields
        self.sections, self.notes, self.pending, self.top = sections, notes, pending, top


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def window_of(text: Column) -> Column:
    """struct(start, end) of 'yyyy-mm' (the whole month) or 'yyyy-mm-dd to yyyy-mm-dd';
    null where the format isn't one of these, a date doesn't exist or the end is before
    the start."""
    whole, days = r"^([0-9]{4}-[0-9]{2})$", r"^([0-9]{4}-[0-9]{2}-[0-9]{2}) to ([0-9]{4}-[0-9]{2}-[0-9]{2})$"
    day = lambda s: F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date")
    month = day(F.concat(F.regexp_extract(text, whole, 1), F.lit("-01")))
    start, end = day(F.regexp_extract(text, days, 1)), day(F.regexp_extract(text, days, 2))
    out = F.when(text.rlike(whole) & month.isNotNull(), F.struct(month.alias("start"), F.last_day(month).alias("end")))
    return out.when(text.rlike(days) & (start <= end), F.struct(start.alias("start"), end.alias("end")))


def report_lines(texts: DataFrame, key: str, profile: ReportProfile) -> DataFrame:
    """(key, n, line, block, kind, field, value, store, issue, frozen) of the lines of text
    reports that aren't blank or notes. A header starts a block; the first issue in a
    block freezes the lines after it, which are kept without being read. Kinds: header,
    window, list, pending, value, unknown."""
    line, tail = F.trim("line"), lambda label: F.trim(F.regexp_replace(F.substring(F.trim("line"), len(label) + 1, 1 << 20), r"^\s*:\s*", ""))
    lines = texts.select(key, F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).select(key, (F.col("n") + 1).alias("n"), line.alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").isin(profile.notes))
    starts = lambda label: F.col("line").rlike(rf"^{label}\s*:")
    kind, field, value = F.lit("unknown"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for label in profile.pending:
        kind = F.when(starts(label), "pending").otherwise(kind)
    for label, (name, _) in profile.fields.items():
        kind, field, value = F.when(starts(label), "value").otherwise(kind), F.when(starts(label), name).otherwise(field), F.when(starts(label), tail(label)).otherwise(value)
    for label, name in profile.sections.items():
        kind, field, value = F.when(starts(label), "list").otherwise(kind), F.when(starts(label), name).otherwise(field), F.when(starts(label), tail(label)).otherwise(value)
    kind, value = F.when(starts(profile.window), "window").otherwise(kind), F.when(starts(profile.window), tail(profile.window)).otherwise(value)
    alias = F.regexp_extract("line", profile.header, 1)
    kind, value = F.when(alias != "", "header").otherwise(kind), F.when(alias != "", alias).otherwise(value)
    w = Window.partitionBy(key).orderBy("n")
    read = lines.withColumns({"kind": kind, "field": field, "value": value})
    named = (F.col("kind") == "header") & (F.col("value") == F.col("alias"))
    read = read.join(profile.stores.select("alias", "store"), named, "left").drop("alias")
    read = read.withColumn("block", F.sum((F.col("kind") == "header").cast("int")).over(w))
    past = Window.partitionBy(key, "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    windows, seen = F.count_if(F.col("kind") == "window").over(past), F.collect_set("field").over(past)
    formats = {name: form for name, form in profile.fields.values()}
    number, percent = r"^-?[0-9]+(\.[0-9]+)?$", r"^-?[0-9]+(\.[0-9]+)?%$"
    form = _map(formats)[F.col("field")]
    items = F.split("value", r"\s*;\s*")
    issue = (
        F.when(F.col("block") == 0, "content without a store header")
        .when((F.col("kind") == "header") & F.col("store").isNull(), "unregistered store")
        .when(F.col("kind") == "header", None)
        .when((F.col("kind") == "window") & (windows > 0), "a second window")
        .when((F.col("kind") == "window") & window_of(F.col("value")).isNull(), "window format")
        .when(F.col("kind") == "window", None)
        .when(windows == 0, "data before a window")
        .when(F.col("kind") == "unknown", "unknown field or section")
        .when(F.col("kind") == "pending", "unit not confirmed")
        .when(F.array_contains(seen, F.col("field")), "repeated field or list")
        .when((F.col("kind") == "value") & (F.col("value") != "") & (form == "percent") & ~F.col("value").rlike(percent), "percentage without a sign")
        .when((F.col("kind") == "value") & (F.col("value") != "") & (form == "number") & ~F.col("value").rlike(number), "not a number")
        .when((F.col("kind") == "list") & ((F.size(items) > profile.top) | F.exists(items, lambda x: ~x.rlike(r"^\S+ [0-9]+(\.[0-9]+)?$"))), "list format")
    )
    told = read.withColumn("issue", issue)
    # a unit that isn't confirmed is an issue, but freezes nothing
    stops = F.col("issue").isNotNull() & (F.col("kind") != "pending")
    frozen = (F.col("block") > 0) & (F.coalesce(F.max(stops.cast("int")).over(past), F.lit(0)) == 1)
    told = told.withColumn("frozen", frozen)
    return told.withColumn("issue", F.when(~F.col("frozen"), F.col("issue")))


def report_rows(lines: DataFrame, key: str) -> DataFrame:
    """(key, block, store, period_start, period_end, field, place, name, value) of reports
    without any issue, which hold whole: one row for each metric and for each list entry."""
    clean = lines.groupBy(key).agg(F.count("issue").alias("issues"), F.max("block").alias("blocks")).where("issues = 0 and blocks > 0").select(key)
    heads = lines.where("kind = 'header'").select(key, "block", "store")
    windows = lines.where("kind = 'window'").select(key, "block", window_of(F.col("value")).alias("w"))
    own = heads.join(windows, [key, "block"], "left").join(clean, key, "left_semi")
    without = own.where("w is null").select(key).distinct()  # a block without a window holds the report
    own = own.join(without, key, "left_anti")
    cells = lines.where("kind = 'value'").select(key, "block", "field", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("name"), F.expr("nullif(rtrim('%', value), '')").alias("value"))
    listed = lines.where("kind = 'list'").select(key, "block", "field", F.posexplode(F.split("value", r"\s*;\s*")).alias("place", "item"))
    listed = listed.select(key, "block", "field", (F.col("place") + 1).alias("place"), F.substring_index("item", " ", 1).alias("name"), F.substring_index("item", " ", -1).alias("value"))
    both = own.join(cells.unionByName(listed), [key, "block"])
    return both.select(key, "block", "store", F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"), "field", "place", "name", F.col("value").cast("double").alias("value"))


def gated_reports(rows: DataFrame, key: str, sections: list[str], forbidden: list[str], anchors: dict) -> DataFrame:
    """(key, problems) of reports (key, section, body): sections that are missing or
    repeated, forbidden claims, empty rows and sections without their anchor."""
    body, section = F.coalesce("body", F.lit("")), F.col("section")
    told = [F.when(F.contains(F.lower(body), F.lit(t)), F.lit(f"forbidden claim: {t}")) for t in forbidden]
    told += [F.when(F.trim(body) == "", F.concat(F.lit("empty row: "), section))]
    told += [F.when((section == n) & ~body.rlike(p), F.lit(f"missing anchor: {n}")) for n, p in anchors.items()]
    told = F.filter(F.array(*told), lambda x: x.isNotNull())
    g = rows.groupBy(key).agg(F.collect_list("section").alias("have"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(told)))).alias("told"))
    count = lambda n: F.size(F.filter("have", lambda x: x == n))
    shape = [F.when(count(n) == 0, F.lit(f"missing section: {n}")).when(count(n) > 1, F.lit(f"repeated section: {n}")) for n in sections]
    return g.select(key, F.concat_ws("; ", *shape, "told").alias("problems"))


def fact_errors(slots: dict, declared: list[str]) -> Column:
    """What a fact (store_id, period_month, slot, confidence, source_fields, observed_values)
    breaks of its contract: required keys, known slots with their own confidence, a
    month, and fields that the source declares."""
    required = ["store_id", "period_month", "slot", "confidence", "source_fields", "observed_values"]
    empty = [F.when(F.coalesce(F.trim(c) == "", F.lit(True)), F.lit(f"empty: {c}")) for c in required]
    wanted = _map(slots)[F.col("slot")]
    unknown = F.array_except(F.filter(F.split("source_fields", ","), lambda x: x != ""), F.array(*map(F.lit, declared)))
    return F.concat_ws(
        "; ", *empty, F.when(~F.col("slot").isin(list(slots)), "slot"), F.when(~F.coalesce(wanted == F.col("confidence"), F.lit(False)), "confidence of slot"),
        F.when(~F.col("period_month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), "period"), F.when(F.size(unknown) > 0, F.concat(F.lit("undeclared field: "), F.array_join(unknown, ","))),
    )
