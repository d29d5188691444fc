"""String, date and digest expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from .numbers import col

SPACE = r"[\s\p{Z}]+"


def blank_to_null(c) -> Column:
    """Strips every Unicode space at both ends; blank is null."""
    t = F.regexp_replace(col(c), rf"^{SPACE}|{SPACE}$", "")
    return F.when(t != "", t)


def squeeze(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def contains_all(c, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.contains(F.lower(col(c)), F.lit(t.lower()))
    return out


def contains_any(c, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(F.lower(col(c)), F.lit(t.lower()))
    return out


def has_word(c, term: str) -> Column:
    """Whether the term stands alone, between characters other than a-z and 0-9."""
    return F.lower(col(c)).rlike(rf"(?<![a-z0-9]){term.lower()}(?![a-z0-9])")


def after_label(c, label: str) -> Column:
    """What follows a label that a space or colon ends; null if it isn't there."""
    return blank_to_null(F.regexp_extract(col(c), rf"^{label}[\s:]+(.*)$", 1))


def outside_parentheses(c) -> Column:
    """Splits at commas that stand outside one level of parentheses."""
    return F.split(col(c), r"[，,](?![^（(]*[）)])")


def span(c, needle) -> Column:
    """struct(start, end) of the first place of needle, from 1, end exclusive."""
    at = F.locate(needle, col(c)) if isinstance(needle, str) else F.instr(col(c), needle)
    length = len(needle) if isinstance(needle, str) else F.char_length(needle)
    return F.when(at > 0, F.struct(at.alias("start"), (at + length).alias("end")))


def snippet(c, terms: list[str], width: int = 320, before: int = 96) -> Column:
    """At most width characters with the first of the terms, and dots where the text
    goes on; without a term, its beginning."""
    t, inner = squeeze(c), width - 6
    size = F.char_length(t)
    at = F.array_min(F.filter(F.array(*(F.locate(x.lower(), F.lower(t)) for x in terms)), lambda x: x > 0)) - 1
    first = F.greatest(F.lit(0), at - min(before, inner // 3))
    end = F.least(size, first + inner)
    start = F.greatest(F.lit(0), F.least(first, end - inner))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.trim(F.substring(t, start + 1, end - start)), F.when(end < size, "...").otherwise(""))
    return F.when(size <= width, t).when(at.isNull(), F.concat(F.rtrim(F.substring(t, F.lit(1), F.lit(width - 3))), F.lit("..."))).otherwise(cut)


#: Ids of stores, what joins the ends of a range, and what joins a list.
STORE_ID, RANGE_JOINS, LIST_JOINS = r"(?:[a-z]\d*|\d+)", r"\s*(?:-|–|—|to\s+|through\s+)", r"\s*(?:,\s*(?:and\s+)?|and\s+|&\s*)(?:store\s+)?"


def entity_mentions(c) -> Column:
    """Distinct ids of the stores that a text names: first full ids ('store_b1'), then
    lists and ranges ('stores B-D, F and 12', 'store b through d'), then ids beside 店,
    门店 or 店铺, then 'StoreB1', then a lone 'b-f'; each kind in its order in the text."""
    text = F.coalesce(col(c), F.lit(""))
    low, end = F.lower(text), r"(?![a-z0-9_])"
    every = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(1))
    span = rf"[a-z]{end}{RANGE_JOINS}[a-z]{end}"
    # a lookahead holds the list, so that a store named inside it can head its own range
    lists = every(low, rf"(?<![a-z0-9_])stores?\s+(?=((?:{span}|{STORE_ID}{end})(?:{LIST_JOINS}{STORE_ID}{end})*))")
    last = lambda x: F.regexp_extract(x, rf"^[a-z]{RANGE_JOINS}([a-z]){end}", 1)
    code = lambda x: F.ascii(F.substring(x, 1, 1))
    letters = lambda x: F.transform(F.sequence(F.least(code(x), F.ascii(last(x))), F.greatest(code(x), F.ascii(last(x)))), lambda i: F.char(i))
    head = lambda x: F.when(last(x) != "", letters(x)).otherwise(F.array(F.regexp_extract(x, f"^{STORE_ID}", 0)))
    listed = F.flatten(F.transform(lists, lambda x: F.concat(head(x), every(x, rf"{LIST_JOINS}({STORE_ID}){end}"))))
    camel = F.transform(every(text, r"(?<![A-Za-z0-9_])Store([A-Z]\d*|\d+)(?![A-Za-z0-9_])"), lambda x: F.lower(x))
    lone = F.when(low.rlike(r"(?<![a-z0-9_-])b\s*-\s*f(?![a-z0-9_-])"), F.array(*map(F.lit, "bcdef"))).otherwise(F.array().cast("array<string>"))
    found = F.concat(every(low, r"(?<![a-z0-9_])store_([a-z0-9][a-z0-9_]*)"), listed, every(low, rf"(?<![a-z0-9_])({STORE_ID})店"), every(low, rf"(?:门店|店铺)\s*({STORE_ID}){end}"), camel, lone)
    return F.transform(F.array_distinct(found), lambda x: F.concat(F.lit("store_"), x))


MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
CJK_MONTHS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二"]
#: What may stand between the ends of a window, and between two months next
#: to each other.
BETWEEN, BESIDE = r"\s*(?:to|through|_to_|[-–—~～至到])\s*", r"\s*(?:and|与|和|、|,)\s*"
_RELATIVE = r"\b(?:daily|weekly|latest|yesterday|today|tomorrow)\b|\b(?:last|this|next)\s+(?:day|week|month|year|quarter)\b|上月|本月|下月|去年|今年|明年|昨天|今天|明天|最近"


def _month_name(i: int) -> str:
    name = MONTH_NAMES[i - 1]
    return rf"{name[:3]}(?:{name[3:]}{'|t' if i == 9 else ''})?(?![a-z])\.?"


def request_window(c) -> Column:
    """struct(start, end, error) of the window that a request names: two ISO days joined
    by one of BETWEEN, or one or two months (2024-03, 2024年3月, 2024年三月, March 2024,
    Mar. 2024; of two the first may leave its year to the second). Months next to each
    other may be joined by one of BESIDE. A request without a time has neither; relative times, open ends, single days and more
    than one window are errors."""
    q = F.lower(F.coalesce(col(c), F.lit("")))
    iso = F.regexp_extract_all(q, F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])"), F.lit(1))
    rest = F.regexp_replace(q, r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", " ")
    # every way to write a month becomes yyyy-mm
    for i in range(12, 0, -1):
        rest = F.regexp_replace(rest, rf"([0-9]{{4}})\s*年\s*(?:{CJK_MONTHS[i - 1]}|0?{i})\s*月", f"$1-{i:02d}")
        rest = F.regexp_replace(rest, rf"\b{_month_name(i)}\s+([0-9]{{4}})", f"$1-{i:02d}")
    for i in range(12, 0, -1):  # takes the year of the month that it goes on to
        rest = F.regexp_replace(rest, rf"\b{_month_name(i)}(?=(?:{BETWEEN}|{BESIDE})([0-9]{{4}})-[0-9]{{2}})", f"$1-{i:02d}")
    rest = F.regexp_replace(rest, r"([0-9]{4}-[0-9]{2})-(?=[0-9]{4}-[0-9]{2})", "$1 to ")
    # so that each is made once
    read = F.struct(q.alias("q"), iso.alias("iso"), rest.alias("rest"), F.regexp_extract_all(rest, F.lit(r"([0-9]{4}-[0-9]{2})(?![0-9-])"), F.lit(1)).alias("months"))
    return F.element_at(F.transform(F.array(read), lambda x: _window(x.q, x.iso, x.rest, x.months)), 1)


def _window(q: Column, iso: Column, rest: Column, months: Column) -> Column:
    day = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")
    month = lambda x: day(F.concat(x, F.lit("-01")))
    joined_days = q.rlike(rf"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{BETWEEN}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}")
    beside = rest.rlike(rf"[0-9]{{4}}-[0-9]{{2}}{BESIDE}[0-9]{{4}}-[0-9]{{2}}") & (F.months_between(month(F.get(months, 1)), month(F.get(months, 0))) == 1)
    joined_months = rest.rlike(rf"[0-9]{{4}}-[0-9]{{2}}{BETWEEN}[0-9]{{4}}-[0-9]{{2}}") | beside
    n_iso, n_months = F.size(iso), F.size(F.array_distinct(months))
    start = F.when(n_iso == 2, day(F.get(iso, 0))).when(n_months > 0, month(F.get(months, 0)))
    end = F.when(n_iso == 2, day(F.get(iso, 1))).when(n_months > 0, F.last_day(month(F.get(months, F.size(months) - 1))))
    opened = r"\b(?:after|before|since|until)\s+\S*[0-9]"
    error = (
        F.when(q.rlike(_RELATIVE), "relative time").when((n_iso > 0) & (n_months > 0), "several windows").when(n_iso == 1, "sub-month date").when(n_iso > 2, "several windows")
        .when((n_iso == 2) & ~joined_days, "not one window").when(q.rlike(opened) | rest.rlike(opened), "open window")
        .when(n_months > 2, "several windows").when((n_months == 2) & ~joined_months, "not one window")
        .when(((n_iso > 0) | (n_months > 0)) & (start.isNull() | end.isNull()), "no such date").when(start > end, "ends before it starts")
    )
    return F.struct(F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), end).alias("end"), error.alias("error"))


def month_bounds(c) -> tuple[Column, Column]:
    """(first, last) day of a yyyy-MM label; null if it isn't one."""
    first = F.when(col(c).rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), F.to_date(F.concat(col(c), F.lit("-01"))))
    return first, F.last_day(first)


def month_label(start, end) -> Column:
    """yyyy-MM if the window is a whole month, else null."""
    s, e = col(start), col(end)
    return F.when((F.dayofmonth(s) == 1) & (e == F.last_day(s)), F.date_format(s, "yyyy-MM"))


def days(start, end) -> Column:
    """Days of a window, both ends included."""
    return F.datediff(col(end), col(start)) + 1


def fresh(ts, as_of: str, limit) -> Column:
    """Whether ts is at most limit days before as_of; without a time it is."""
    return F.coalesce(col(ts) >= F.to_timestamp(F.lit(as_of)) - F.make_interval(days=limit if isinstance(limit, Column) else F.lit(limit)), F.lit(True))


def digest(*columns) -> Column:
    """SHA-256 of the columns as text, one after another; nulls are told apart."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(col(c).cast("string"), F.lit("\\N")) for c in columns)), 256)


def paragraphs(texts, key: str, text: str):
    """(key, chunk_no, chunk) of the parts between blank lines."""
    return texts.select(key, F.posexplode(F.split(col(text), r"\n\s*\n", -1)).alias("chunk_no", "chunk"))


def occurrences(texts, key: str, text: str, literal: str):
    """(key, literal, line_no, ordinal, column_start, column_end) of every occurrence of
    each text's literal, from left to right without overlap; ordinal: which one of its
    line. All count from 1, columns in characters."""
    lines = texts.select(key, literal, F.posexplode(F.split(col(text), "\n", -1)).alias("_line", "_text")).where(F.length(col(literal)) > 0)
    parts = F.split("_text", F.concat(F.lit(r"\Q"), F.replace(col(literal), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    found = lines.withColumn("_parts", parts).where(F.size("_parts") > 1).select(key, literal, "_line", F.posexplode("_parts").alias("ordinal", "_part"))
    size = F.char_length(col(literal))
    before = F.sum(F.char_length("_part")).over(Window.partitionBy(key, literal, "_line").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    each = found.withColumn("_before", before + (F.col("ordinal") - 1) * size).where("ordinal > 0")
    return each.select(key, literal, (F.col("_line") + 1).alias("line_no"), "ordinal", (F.col("_before") + 1).cast("int").alias("column_start"), (F.col("_before") + size).cast("int").alias("column_end"))


def located(uses, found, key: str, literal: str, by: str):
    """uses (key, line_no, literal, by) with the place of each: the n-th use of a literal
    on a line, in the order of by, is its n-th occurrence there; without one, nulls."""
    nth = F.row_number().over(Window.partitionBy(key, "line_no", literal).orderBy(by))
    return uses.withColumn("ordinal", nth).join(found, [key, "line_no", literal, "ordinal"], "left")


def table_rows(texts, key: str, text: str, is_row=None):
    """(key, line_no, heading, header, chunk): each row of the tables in a text, with the
    heading that it stands under and its table's header. A table is lines one after
    another that are rows (by default those that begin with |); its first is the header,
    lines of dashes alone are no rows."""
    is_row = is_row or (lambda line: F.startswith(F.ltrim(line), F.lit("|")))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = texts.select(key, F.posexplode(F.split(col(text), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    lines = lines.withColumns({"row": is_row(F.col("line")), "mark": F.when(F.col("line").rlike(r"^#{1,6}\s"), F.trim(F.regexp_replace("line", r"^#+", "")))})
    start = F.col("row") & ~F.coalesce(F.lag("row").over(w), F.lit(False))
    lines = lines.withColumns({"heading": F.last("mark", ignorenulls=True).over(w), "top": F.when(start, F.col("line"))})
    lines = lines.withColumn("header", F.last("top", ignorenulls=True).over(w))
    dashes = F.col("line").rlike(r"^[\s|:-]+$")
    return lines.where(F.col("row") & F.col("top").isNull() & ~dashes).select(key, "line_no", "heading", F.trim("header").alias("header"), F.trim("line").alias("chunk"))


def fact_text() -> Column:
    """A fact (store_id, period_month, slot, confidence, source_fields, observed_values)
    as text to retrieve it by."""
    named = (("store", "store_id"), ("month", "period_month"), ("slot", "slot"), ("confidence", "confidence"), ("fields", "source_fields"))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), c) for n, c in named), "observed_values")
