"""Operator 11: phrases whose words belong together, counted by direct-address tiling.

A task cuts its documents into slices; each is stored once as numbers of its own words,
with breaks where pieces end. Spark counts the words of all slices by language, and
ranks those that may be in a candidate (LEAST occurrences) by frequency: their place in
that order is their id, and every slice learns the ids of its words. Nothing else of a
text moves.

Pairs of neighbours are counted in tiles of SIDE by SIDE ids. As ids are in order of
frequency, most occurrences fall into few tiles: those with enough of them are counted
by one dense bincount, all others as sorted coordinates. Each slice sends its counts to
the buckets of their stripes (ROWS by SIDE ids, so that even the most frequent words'
tile is spread), packed, one row a bucket. A bucket adds them up the same way, gives its
frequent pairs new ids by frequency, and tells each slice which of its pairs these are.
Then a pair and the word after it are a pair again, and so on up to the longest phrases:
a phrase can only be frequent if both its ends are.

Scores, dropped phrases and ranks are plain DataFrame operations on the frequent phrases
alone, in decimals of 38 digits, which are exact up to 10**15 occurrences.

Edge cases. A null or empty text has no words; a null lang is `und`. Words that no other
word joins count for n alone. Repeated rows count as often as they occur. Equal scores go
to the larger count, then to the smaller phrase in UTF-8 byte order. Within a slice,
words are told apart by 64-bit hashes that no pattern breaks; across slices by their
characters. A very long text is a slice of its own and costs its task about 60 bytes a
byte. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import panels
from . import common, textvec

LEAST, LONGEST, FIRST, COVERED = 10, 3, 2000, 50
SIDE, ROWS, DENSE, SLICE = 256, 16, 4, 4 << 20
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[list(b".,;:!?\n\v\f\r")] = 10
_MAP[[9]] = 32

SLICES = "slice long, place int, lang string, word string, n long, codes binary"
ENCODED = "slice long, codes binary, names binary, seq binary, seq_names binary"
SENT = "bucket int, slice long, i binary, j binary, n binary"
FOUND = "slice long, i binary, j binary, id binary, n binary"


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs; of rising ones the steps."""
    x = np.diff(x, prepend=x[:1] * 0) if rising else x
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(x) or int(x.max()) < 1 << 8 * k)
    return bytes([size]) + x.astype(f"u{size}").tobytes()


def _unpack(data: bytes, rising: bool = False) -> np.ndarray:
    x = np.frombuffer(data, f"u{data[0]}", offset=1).astype(np.int64)
    return np.cumsum(x) if rising else x


def _table(schema: str, rows: list) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.Table.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    values = data[textvec.ragged(starts, sizes)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _slice(batches):
    for batch in batches:
        for low, high in textvec.slices(batch.column("text"), SLICE):
            part = batch.slice(low, high - low)
            data, offsets = textvec.buffers(part.column("text"))
            data = _MAP[data]
            starts, ends, first = textvec.word_bounds(data, offsets)
            if not len(starts):
                continue
            langs = part.column("lang").dictionary_encode()
            doc = np.repeat(np.arange(len(part)), np.diff(first))
            lang = langs.indices.to_numpy()[doc]
            keys = textvec.mix(textvec.word_hashes(data, starts) + textvec.odd(lang))
            _, at, codes = np.unique(keys, return_index=True, return_inverse=True)
            ends_before = np.cumsum(data == 10, dtype=np.int32)[starts]
            broken = np.concatenate([[0], (np.diff(ends_before) > 0) | (np.diff(doc) > 0)])
            seq = np.zeros(len(starts) + int(broken.sum()), np.int32)
            seq[np.arange(len(starts)) + np.cumsum(broken)] = codes + 1
            counts, own = np.bincount(codes), int.from_bytes(os.urandom(7), "little")
            for a in range(0, len(at), 1 << 16):
                w = at[a : a + (1 << 16)]
                n = len(w)
                columns = [pa.array(np.full(n, own)), pa.array(np.arange(a + 1, a + n + 1, dtype=np.int32)), langs.dictionary.take(pa.array(lang[w])), _strings(data, starts[w], ends[w] - starts[w]), pa.array(counts[w - w + np.arange(a, a + n)]), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SLICES.split(", ")])
            yield from _table(SLICES, [(own, None, None, None, None, seq.tobytes())]).to_batches()


def _encode(key, left, right):
    """A slice with its words' ids: codes become places in names, the ids in order; 0
    is a break, or a word too rare."""
    place, ids = (np.asarray(right.column(c).to_numpy(), np.int64) for c in ("place", "id"))
    order = np.argsort(ids)
    rows = []
    for codes in left.column("codes").to_pylist():
        codes = np.frombuffer(codes, np.int32)
        new = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
        new[place[order]] = np.arange(1, len(order) + 1)
        rows.append((key[0].as_py(), new[codes].tobytes(), _pack(ids[order], True), None, None))
    return _table(ENCODED, rows)


def tiled(i: np.ndarray, j: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, n): how often each pair of small numbers occurs (n: as so many), in no
    order. Tiles with many occurrences are counted densely, the others sorted."""
    if not len(i):
        return i, j, np.zeros(0, np.int64)
    width = int(j.max()) // SIDE + 1
    tile = (i // SIDE).astype(np.int64) * width + j // SIDE
    if (int(i.max()) // SIDE + 1) * width > 4 * len(i) + 1024:
        tile = np.unique(tile, return_inverse=True)[1]
    dense = np.bincount(tile) >= SIDE * SIDE // DENSE
    out, hit = [], dense[tile]
    if hit.any():
        number, where = np.cumsum(dense) - 1, np.zeros((int(dense.sum()), 2), np.int64)
        x, y, t = i[hit], j[hit], number[tile[hit]]
        where[t, 0], where[t, 1] = x // SIDE * SIDE, y // SIDE * SIDE
        total = np.bincount((t * SIDE + x % SIDE) * SIDE + y % SIDE, None if n is None else n[hit], len(where) * SIDE * SIDE)
        cell = np.flatnonzero(total)
        t, x, y = cell // (SIDE * SIDE), cell // SIDE % SIDE, cell % SIDE
        out.append((where[t, 0] + x, where[t, 1] + y, total[cell].astype(np.int64)))
    if not hit.all():
        base = int(j.max()) + 1
        code = i[~hit].astype(np.int64) * base + j[~hit]
        if n is None:
            s = np.sort(code)
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.diff(np.append(head, len(s)))
        else:
            order = np.argsort(code, kind="stable")
            s = code[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.add.reduceat(n[~hit][order], head)
        out.append((s[head] // base, s[head] % base, total))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


#: Columns of rising numbers; the buckets' rows have their pairs in order.
_RISING = {"names", "seq_names", "i"}


def _arrays(row, *names):
    return [np.frombuffer(row[name], np.int32) if name in ("codes", "seq") else _unpack(row[name], name in _RISING) for name in names]


def _rows(batch):
    """One row at a time, as they are large."""
    for k in range(len(batch)):
        yield batch.slice(k, 1).to_pylist()[0]


def _sequence(row, length: int):
    """(words, their ids, phrases, their ids); at first the phrases are the words."""
    words, names = _arrays(row, "codes", "names")
    return (words, names, words, names) if length == 1 else (words, names, *_arrays(row, "seq", "seq_names"))


def _send(buckets: int, length: int):
    """The counts of each slice's phrases of so many words with the word after them."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                words, names, seq, seq_names = _sequence(row, length)
                i, j = seq[: max(0, len(words) - length)], words[length:]
                both = (i > 0) & (j > 0)
                if length > 1:
                    both &= seq[1 : len(i) + 1] > 0  # the phrase's other end is frequent too
                i, j, n = tiled(i[both] - 1, j[both] - 1)
                if not len(n):
                    continue
                i, j = seq_names[i], names[j]
                bucket = (textvec.mix((i // ROWS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (j // SIDE).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((j, i, bucket))
                i, j, n, bucket = i[order], j[order], n[order], bucket[order]
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = [(int(bucket[a]), row["slice"], _pack(i[a:b], True), _pack(j[a:b]), _pack(n[a:b])) for a, b in zip(at, np.append(at[1:], len(n)), strict=True)]
                yield from _table(SENT, rows).to_batches()

    return run


def _small(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names = np.unique(x)
    return names, np.searchsorted(names, x)


def _add(buckets: int, least: int, tell: bool):
    """The frequent pairs of a bucket with ids (slice null), and each slice's own ones."""

    def run(key, table):
        bucket, rows = key[0].as_py(), table.to_pylist()
        parts = [_arrays(r, "i", "j", "n") for r in rows]
        i, j, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        (us, i), (vs, j) = _small(i), _small(j)
        x, y, total = tiled(i, j, n)
        x, y, total = x[total >= least], y[total >= least], total[total >= least]
        order = np.lexsort((y, x))
        x, y, total = x[order], y[order], total[order]
        ids = np.empty(len(total), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + bucket + 1
        out = [(None, _pack(us[x], True), _pack(vs[y]), _pack(ids), _pack(total))] if len(total) else []
        if tell and len(total):
            code = x * len(vs) + y
            own = i * len(vs) + j
            at = np.minimum(np.searchsorted(code, own), len(code) - 1)
            hit = code[at] == own
            low = 0
            for r, (ri, rj, _) in zip(rows, parts, strict=True):
                m = hit[low : low + len(ri)]
                if m.any():
                    out.append((r["slice"], _pack(ri[m], True), _pack(rj[m]), _pack(ids[at[low : low + len(ri)][m]]), None))
                low += len(ri)
        return _table(FOUND, out)

    return run


def _renamed(length: int):
    """A slice whose phrases are one word longer, as told by the buckets."""

    def run(key, left, right):
        told = [_arrays(r, "i", "j", "id") for r in right.to_pylist()]
        ti, tj, ids = (np.concatenate(x) for x in zip(*told, strict=True)) if told else [np.zeros(0, np.int64)] * 3
        out = []
        for row in left.to_pylist():
            words, names, seq, seq_names = _sequence(row, length)
            i, j = seq[: max(0, len(words) - length)].astype(np.int64), words[length:]
            base = len(names) + 1
            code = (np.searchsorted(seq_names, ti) + 1) * base + np.searchsorted(names, tj) + 1
            order = np.argsort(code)
            new_names = np.sort(ids)
            small = np.searchsorted(new_names, ids[order]) + 1
            new = np.zeros(len(seq), np.int32)
            if len(code):
                own = i * base + j
                at = np.minimum(np.searchsorted(code[order], own), len(code) - 1)
                new[: len(i)] = np.where(code[order][at] == own, small[at], 0)
            out.append((row["slice"], row["codes"], row["names"], new.tobytes(), _pack(new_names, True)))
        return _table(ENCODED, out)

    return run


def _unpacked(batches):
    for batch in batches:
        for row in _rows(batch):
            i, j, ids, n = _arrays(row, "i", "j", "id", "n")
            for a in range(0, len(n), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (i, j, ids, n)], ["i", "j", "id", "n"])


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, n) of all word occurrences; (lang, words, n, text of single words) of every
    phrase of 1 to longest words that occurs at least so often). words: ids."""
    spark = docs.sparkSession
    buckets = common.shuffle_partitions(spark)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    plain = docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    slices = common.stored(plain.mapInArrow(_slice, SLICES), "slices")
    named = slices.where("place is not null").drop("codes")
    totals = common.stored(named.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    often = panels.placed(totals.where(F.col("n") >= least).withColumn("rarity", -F.col("n")), ["lang", "rarity", "word"], "id")
    often = common.stored(often.select("id", "lang", "word", "n"), "often")
    replies = named.select("slice", "place", "lang", "word").join(often.select("id", "lang", "word"), ["lang", "word"]).select(F.col("slice").alias("of"), "place", "id")
    coded = slices.where("place is null").select("slice", "codes")
    encoded = common.stored(coded.groupBy("slice").cogroup(replies.groupBy("of")).applyInArrow(_encode, ENCODED), "encoded")
    every = [often.select("lang", F.array("id").alias("words"), "n", F.col("word").alias("text"))]
    known = often.select("id", "lang", F.array("id").alias("words"))
    for length in range(1, longest):
        sent = encoded.mapInArrow(_send(buckets, length), SENT)
        found = common.stored(sent.groupBy("bucket").applyInArrow(_add(buckets, least, length + 1 < longest), FOUND), "found")
        pairs = found.where("slice is null").mapInArrow(_unpacked, "i long, j long, id long, n long")
        longer = pairs.join(known.withColumnRenamed("id", "i"), "i").select("id", "lang", F.concat("words", F.array("j")).alias("words"), "n")
        longer = common.stored(longer, "phrases")
        every.append(longer.select("lang", "words", "n", F.lit(None).cast("string").alias("text")))
        known = longer.select("id", "lang", "words")
        if length + 1 < longest:
            told = found.where("slice is not null").select(F.col("slice").alias("of"), "i", "j", "id")
            encoded = encoded.groupBy("slice").cogroup(told.groupBy("of")).applyInArrow(_renamed(length), ENCODED)
            if length + 2 < longest:
                encoded = common.stored(encoded, "encoded")
    return totals.groupBy("lang").agg(F.sum("n").alias("n")), reduce(DataFrame.unionByName, every)


def scored(every: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, score) of every phrase of two words and more."""
    cuts = every.where(F.size("words") > 1).select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("words", F.lit(1), F.col("k")), "right": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    count = lambda side, name: every.select(F.col("words").alias(side), F.col("n").alias(name))
    cuts = cuts.join(count("left", "l"), "left").join(count("right", "r"), "right")
    long = lambda c: F.col(c).cast("decimal(15,0)").cast("decimal(19,0)")
    score = F.expr("div(cast(1000000 as decimal(7,0)) * wide_a * wide_a, wide_l * wide_r)")
    cuts = cuts.withColumns({f"wide_{c}": long(c) for c in "alr"}).withColumn("score", score)
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k"))
    return cuts.groupBy("lang", "words", "a").agg(best.alias("b")).select("lang", "words", "a", "b.*")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, covered: int = COVERED) -> DataFrame:
    """The first phrases of each language, as op11's contract has them. covered: a phrase
    is left out if a longer one has this percentage of its occurrences."""
    totals, every = phrases(docs, longest, least)
    every = common.stored(every, "every")
    size = F.size("words")
    parts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda at: F.slice("words", at, m))))
    inside = every.where(size > 2).select(F.explode(parts).alias("words"), "n").groupBy("words").agg(F.max("n").alias("longer"))
    left = scored(every).join(inside, "words", "left").where((100 * F.coalesce("longer", F.lit(0)) < covered * F.col("a"))).drop("longer")
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    near = common.stored(left.withColumn("near", near).where(F.col("near") <= first).drop("near"), "near")
    texts = every.where("text is not null").select(F.col("words")[0].alias("id"), "text")
    named = near.select("words", F.posexplode("words").alias("at", "id")).join(texts, "id").groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = near.join(named, "words").withColumn("rank", rank.cast("long")).where(F.col("rank") <= first)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, unnest([array_to_string(ws[i:i+m-1], ' ') FOR i IN range(1, len(ws) - m + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, n AS a FROM f WHERE m > 1 AND n >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, l.n AS l, r.n AS r, CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k+1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3),
x AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, CAST(t.n AS BIGINT) AS n, score
FROM b JOIN t ON t.lang = b.lang LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE 100 * coalesce(longer, 0) < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) <= 2000
"""
