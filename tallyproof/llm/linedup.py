"""Operator 6: near-duplicate lines by a segment-partition edit join.

Two lines are linked if so many single-character edits turn one into the other as the
shorter one's length allows: CLASSES gives the threshold by length (lines under its
first bound are linked with exact copies only). A line is cut into threshold + 1
segments; whatever the edits, one segment stays, so a line within reach holds it, at
one of a few places that the two lengths allow. Each line is indexed under (its length,
segment number, segment), and probes the keys of its own and of slightly shorter
lengths. Lines meet under equal keys and are verified with an edit distance whose band
of 2 * threshold + 1 diagonals is one machine word for all error counts at once.
Connected lines form a class; all but its first line, by (doc_id, line number), are
duplicates.

Exact copies are one line from the start. A key that more than PAIRS lines share
isn't expanded into pairs: what is left of those lines without the shared segment
must itself be within the threshold, so it is cut into segments again, and the key
gets longer. This ends when at most a threshold of characters is left: such lines are
all within reach of each other, and a link to the first is enough.

DataFrame functions only. Edge cases. A null or empty text has one empty line at
most; lines without a word (white space only) are neither linked nor removed. Rows with
a null doc_id are returned with nothing removed. Repeated rows, and rows of one doc_id
with different texts, are judged line by line as (doc_id, line number, line); the same
line at the same place is one. A very long text is split into lines in one row's memory.
Columns of any name are kept by removed and ignored by judge. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

#: (threshold, least code points) of lines, from short ones to long ones.
CLASSES, PAIRS = ((1, 24),), 32
WORD = r"[^\x20\x09-\x0D]"


def _segment(length: Column, i: int, threshold: int) -> tuple[Column, Column]:
    """(start from 0, characters) of segment i; the last ones are the longer."""
    parts = threshold + 1
    base, rest = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    short = F.lit(parts) - rest
    return (i * base + F.greatest(F.lit(0), F.lit(i) - short)).cast("int"), (base + (F.lit(i) >= short).cast("int")).cast("int")


def _shape(length: Column, classes: tuple) -> list[tuple]:
    """(name, valid, role, start, n, other length, segment, threshold) of each key of a
    line: role 0 for its own segments, 1 for probes."""
    out = []
    for (threshold, least), (_, beyond) in zip(classes, [*classes[1:], (0, 1 << 30)], strict=True):
        for shorter in range(threshold + 1):
            other = (length - shorter).cast("int")
            for i in range(threshold + 1):
                start, n = _segment(other, i, threshold)
                for o in range(max(-i, shorter - (threshold - i)), min(i, shorter + threshold - i) + 1):
                    at = (start + o).cast("int")
                    valid = (other >= least) & (other < beyond) & (at >= 0) & (at + n <= length)
                    out.append((f"k{len(out)}", valid, int(shorter > 0 or o != 0), at, n, other, i, threshold))
    return out


def _keys(text: str, length: str, under: Column, classes: tuple) -> list[Column]:
    """The keys k0, k1, ... of a line (null where there is none). under: the key
    that the lines already share."""
    return [F.when(valid, F.xxhash64(under, other, F.lit(i), F.substring(F.col(text), at + 1, n))).alias(name) for name, valid, _, at, n, other, i, _ in _shape(F.col(length), classes)]


def _entries(rows: DataFrame, classes: tuple, *keep: str) -> DataFrame:
    """A row (key, role, start, n, t) for each key of rows with length, k0, k1, ..."""
    one = lambda name, role, at, n, t: F.struct(F.col(name).alias("key"), F.lit(role).alias("role"), at.alias("start"), n.alias("n"), F.lit(t).alias("t"))
    every = F.array(*(one(name, role, at, n, t) for name, _, role, at, n, _, _, t in _shape(F.col("length"), classes)))
    return rows.select(*keep, F.inline(every)).where("key is not null")


def _linked(a: Column, b: Column, classes: tuple) -> Column:
    """Whether lines are within the shorter one's threshold."""
    size, out = F.least(F.char_length(a), F.char_length(b)), F.lit(False)
    for threshold, least in classes:
        near = (F.abs(F.char_length(a) - F.char_length(b)) <= threshold) & within(a, b, threshold)
        out = F.when(size >= least, near).otherwise(out)
    return out


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether a and b are within threshold edits: bit d * band + k + threshold of
    the state tells whether diagonal k is reached with d errors."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)(.)"), F.lit(1))
    both = F.array(F.struct(chars(a).alias("x"), chars(b).alias("y")))  # so that each is made once
    return F.element_at(F.transform(both, lambda p: _within(p.x, p.y, threshold)), 1)


def _within(x: Column, y: Column, threshold: int) -> Column:
    band = 2 * threshold + 1
    full = (1 << band) - 1
    shift = F.size(y) - F.size(x)
    start = sum(1 << (d * band + k + threshold) for d in range(threshold + 1) for k in range(d + 1))

    def step(state: Column, at: Column) -> Column:
        char = F.get(x, at)
        match = F.lit(0).cast("long")
        for k in range(-threshold, threshold + 1):
            match = match.bitwiseOR(F.when(char == F.get(y, at + k), F.lit(1 << (k + threshold)).cast("long")).otherwise(F.lit(0).cast("long")))
        out, before_new, before_old = F.lit(0).cast("long"), None, None
        for d in range(threshold + 1):
            old = F.shiftright(state, d * band).bitwiseAND(F.lit(full))
            new = old.bitwiseAND(match)
            if d:
                new = new.bitwiseOR(before_old).bitwiseOR(F.shiftright(before_old, 1)).bitwiseOR(F.shiftleft(before_new, 1)).bitwiseAND(F.lit(full))
            out = out.bitwiseOR(F.shiftleft(new, d * band))
            before_new, before_old = new, old
        return out

    end = F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), F.lit(start).cast("long"), step)
    hit = F.lit(False)
    for k in range(-threshold, threshold + 1):
        reached = sum(1 << (d * band + k + threshold) for d in range(threshold + 1))
        hit = F.when(shift == k, end.bitwiseAND(F.lit(reached).cast("long")) != 0).otherwise(hit)
    return hit


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs of ids under one key, at least one of which is there by its own segment."""
    x, y = rows.select("key", F.col("id").alias("p"), F.col("role").alias("rp")), rows.select("key", F.col("id").alias("q"), F.col("role").alias("rq"))
    met = x.where("rp = 0").join(y, "key").where("p <> q and (rq = 1 or p < q)")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def _sized(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.count_if(F.col("role") == 0).alias("own")).where("size > 1 and own > 0")
    return common.stored(rows.join(common.stored(sizes, "sizes"), "key"), "met")


def _crowded(big: DataFrame, texts: DataFrame, t: int, pairs: int) -> list[DataFrame]:
    """Pairs of ids of lines of which many share a key: by longer and longer keys."""
    without = lambda c: F.concat(F.substring(c, F.lit(1), F.col("start")), F.substring(c, F.col("start") + F.col("n") + 1, F.char_length(c)))
    rest = common.stored(big.join(texts, "id").select("key", "id", without("line").alias("rest")), "rest")
    classes, found = ((t, t + 1),), []
    while True:
        measured = rest.withColumn("length", F.char_length("rest"))
        again = _entries(measured.select("id", "rest", "length", *_keys("rest", "length", F.col("key"), classes)), classes, "id", "rest")
        # rests too short to be cut: equal lengths are all within reach
        left = F.char_length("rest")
        at = F.transform(F.sequence(F.lit(0), F.lit(t)), lambda d: F.struct(F.xxhash64("key", F.lit("short"), left - d).alias("key"), (d > 0).cast("int").alias("role"), (left - d).alias("left")))
        short = rest.select("id", F.explode(F.filter(at, lambda x: (x.left >= 0) & (x.left <= t))).alias("e")).select("id", "e.key", "e.role")
        short = common.stored(short, "short")
        first = common.stored(short.where("role = 0").groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")), "hubs")
        found.append(short.where("role = 0").join(first.where("n > 1"), "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
        found.append(_across(short, first))
        again = _sized(common.stored(again, "again"))
        found.append(_pairs(again.where(F.col("size") <= pairs)))
        big = again.where(F.col("size") > pairs)
        if not big.limit(1).count():
            return found
        rest = common.stored(big.select("key", "id", without("rest").alias("rest")), "rest")


def links(lines: DataFrame, fetch, classes: tuple = CLASSES, pairs: int = PAIRS) -> DataFrame:
    """(a, b) of ids of lines within the threshold. lines: distinct, with id,
    length and keys; fetch(ids): (id, line) of those ids."""
    rows = _sized(common.stored(_entries(lines, classes, "id"), "keys"))
    texts = common.stored(fetch(rows.select("id").distinct()), "texts")
    found = [_pairs(rows.where(F.col("size") <= pairs))]
    big = rows.where(F.col("size") > pairs)
    for t in sorted(r["t"] for r in big.select("t").distinct().collect()):  # of the classes' thresholds
        found += _crowded(big.where(F.col("t") == t), texts, t, pairs)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = common.stored(every.distinct(), "candidates")
    both = every.join(texts.toDF("a", "line_a"), "a").join(texts.toDF("b", "line_b"), "b")
    return both.where(_linked(F.col("line_a"), F.col("line_b"), classes)).select("a", "b")


def _across(short: DataFrame, first: DataFrame) -> DataFrame:
    """The probes that met own rests, against the first of these."""
    probes = short.where("role = 1").select("key", F.col("id").alias("q"))
    return probes.join(first.select("key", "hub"), "key").where("hub <> q").select(F.least("hub", "q").alias("a"), F.greatest("hub", "q").alias("b"))


def duplicates(docs: DataFrame, classes: tuple = CLASSES, pairs: int = PAIRS) -> DataFrame:
    """(doc_id, line_no, id, near) of each line that isn't the first of its class; id: a
    digest of the line; near: whether its class holds different lines. line_no counts
    from 0."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    every = plain.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(WORD))
    named = every.select("doc_id", "line_no", F.unhex(F.md5("line")).alias("id"), "line", F.char_length("line").alias("length"))
    at = common.stored(named.select("doc_id", "line_no", "id"), "lines")
    seen = at.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    seen = common.stored(seen, "seen")
    keyed = named.where(F.col("length") >= classes[0][1]).select("id", "length", *_keys("line", "length", F.lit(0), classes))
    entries = keyed.groupBy("id").agg(*(F.first(c).alias(c) for c in keyed.columns if c != "id"))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = seen.join(ids, "id").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("id", F.col("first.line_no").alias("line_no"))).alias("wanted"))
        cut = plain.join(wanted, "doc_id").withColumn("all", F.split("text", "\n", -1))
        got = cut.select(F.explode(F.transform("wanted", lambda w: F.struct(w.id.alias("id"), F.get("all", w.line_no).alias("line")))).alias("e")).select("e.id", "e.line")
        return got.where(F.unhex(F.md5("line")) == F.col("id")).dropDuplicates(["id"])

    linked = common.components(common.stored(links(entries, fetch, classes, pairs), "links"))
    grouped = seen.join(linked.withColumnRenamed("component", "class"), "id", "left").where("class is not null or n > 1")
    grouped = common.stored(grouped.select("id", F.coalesce("class", "id").alias("class"), F.col("class").isNotNull().alias("near"), "first"), "grouped")
    heads = grouped.groupBy("class").agg(F.min_by(F.struct("first", "id"), F.struct("first", "id")).alias("head"))
    ids = common.stored(grouped.join(common.stored(heads, "heads"), "class").select("id", "near", "head"), "ids")
    kept = (F.struct("doc_id", "line_no") == F.col("head.first")) & (F.col("id") == F.col("head.id"))
    return at.join(ids, "id").where(~kept).select("doc_id", "line_no", "id", "near").distinct()


def _matched(docs: DataFrame, options: dict) -> DataFrame:
    """(row, doc_id, lines, gone): each row with its lines and those that go, found by
    number and line, so that rows of one doc_id don't lose one another's lines."""
    every = duplicates(docs, **options).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "id", "near")).alias("every"))
    text = F.col("row").getField("text").cast("string")
    rows = docs.select(F.struct(*common.columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(every, "doc_id", "left")
    rows = rows.withColumn("lines", F.split(text, "\n", -1))
    here = F.filter("every", lambda x: F.unhex(F.md5(F.get(F.col("lines"), x.line_no))) == x.id)
    return rows.select("row", "doc_id", "lines", F.coalesce(here, F.array()).alias("gone"))


def judge(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed_lines) of each row of docs."""
    rows, size = _matched(docs, options), lambda c: F.size(c).cast("long")
    numbers = F.array_sort(F.transform("gone", lambda x: x.line_no))
    return rows.select(
        "doc_id", F.when(F.col("lines").isNull(), 0).otherwise(size("lines")).alias("n_lines"), size("gone").alias("n_removed"),
        size(F.filter("gone", lambda x: x.near)).alias("n_near"), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("removed_lines"),
    )


def removed(docs: DataFrame, **options) -> DataFrame:
    """docs without the duplicate lines, with the same columns."""
    rows = _matched(docs, options)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda x: x.line_no))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.size("gone") == 0, F.col("row").getField("text").cast("string")).otherwise(kept)
    return rows.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
k AS (SELECT line, length(line) AS n, left(line, 12) AS h, right(line, 12) AS t, min((doc_id, line_no)) AS f FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
c AS (SELECT x.line AS a, y.line AS b FROM k x JOIN k y ON x.h = y.h AND x.line <> y.line WHERE x.n >= 24 AND y.n BETWEEN x.n AND x.n + 1 AND levenshtein(x.line, y.line) <= 1
      UNION SELECT x.line, y.line FROM k x JOIN k y ON x.t = y.t AND x.line <> y.line WHERE x.n >= 24 AND y.n BETWEEN x.n AND x.n + 1 AND levenshtein(x.line, y.line) <= 1),
p AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
r AS (SELECT a AS line, b AS other FROM p UNION SELECT r.line, p.b FROM r JOIN p ON p.a = r.other),
d AS (SELECT k.line, least(k.f, coalesce(min(o.f), k.f)) AS head, count(r.other) > 0 AS near FROM k LEFT JOIN r ON r.line = k.line LEFT JOIN k o ON o.line = r.other GROUP BY k.line, k.f),
g AS (SELECT l.doc_id, count(*) AS n, count(*) FILTER (near) AS n_near, string_agg(CAST(l.line_no AS VARCHAR), ',' ORDER BY l.line_no) AS ls FROM l JOIN d ON d.line = l.line WHERE (l.doc_id, l.line_no) <> d.head GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(g.n, 0) AS n_removed, coalesce(g.n_near, 0) AS n_near, coalesce(g.ls, '') AS removed_lines
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
