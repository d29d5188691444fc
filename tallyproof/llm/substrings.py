"""Operator 7: removal of repeated passages of WIDTH words, by recompression.

Each document's word sequence is recompressed (see recompress): rounds that name
runs of one word and then pairs of symbols, with names that are equal everywhere.
A window of WIDTH words is looked up by a symbol of the highest round that lies
inside it together with all on which its making depended; such a symbol is there
wherever the same words are. So a window can only repeat if one of its symbols is
shared. Spark finds symbols that several documents share, then compares the
windows around them by a 64-bit hash of all their words, and tells each document
which of its windows start in a document with a smaller doc_id.

Names are content hashes, so a naming round is local: no exchange is needed for
it, and the rounds of a document run in one task. Names and window hashes have 64
bits and mix at every step, so that no pattern of words makes them collide; a false
match needs a chance collision.

Edge cases. A null or empty text has no words. A document with fewer words than
WIDTH loses nothing. Rows with a null doc_id are neither judged nor compared with.
Repeated rows get equal results, as only smaller doc_ids count. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, recompress, regroup, textvec

WIDTH, ROUNDS, CAP = 50, 7, 25


def _read(part):
    data, offsets = textvec.buffers(part.column("text"))
    starts, _, first = textvec.word_bounds(data, offsets)
    hashes = textvec.word_hashes(data, starts)
    valid = ~np.asarray(part.column("doc_id").is_null())
    docs = regroup.numbers(part.column("doc_id").fill_null(0))
    return hashes, first, docs, valid


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words."""
    return textvec.wide(hashes, width)


def _symbols(part, width, rounds, cap):
    """(name, low, high) with places counted without walls, and what was read."""
    hashes, first, docs, valid = _read(part)
    names, low, high = recompress.anchors(recompress.parse(hashes, first, rounds, cap), width)
    places = first[:-1] + np.arange(len(docs))
    doc = np.searchsorted(places, low, "right") - 1
    return (names, low - doc - 1, high - doc - 1, doc), (hashes, first, docs, valid)


def _emit(buckets, width, rounds, cap):
    def run(key, table):
        held = []
        for part in regroup.slices(table):
            (names, _, _, doc), (_, _, docs, valid) = _symbols(part, width, rounds, cap)
            ok = valid[doc]
            held.append(regroup.distinct(names[ok], docs[doc][ok]))
        return regroup.send(key[0].as_py(), *regroup.merged(held), buckets, bounds=False)

    return run


def _windows(part, shared, width, rounds, cap):
    """(hash, doc) of the windows that hold a shared symbol."""
    (names, low, high, _), (hashes, first, docs, valid) = _symbols(part, width, rounds, cap)
    hit, _ = regroup.found(names, shared)
    n = len(hashes)
    marks = np.bincount(np.maximum(high[hit] - width, 0), minlength=n + 1) - np.bincount(low[hit] + 1, minlength=n + 2)[: n + 1]
    wanted = (np.cumsum(marks) > 0)[: max(0, n - width + 1)]
    doc = np.repeat(np.arange(len(docs)), np.diff(first))
    at = np.flatnonzero(wanted)
    at = at[(doc[at] == doc[at + width - 1]) & valid[doc[at]]]
    return window_hashes(hashes, width)[at], docs[doc[at]]


def _ask(buckets, width, rounds, cap):
    def run(key, left, right):
        shared, _ = regroup.gathered(right, False)
        held = [regroup.distinct(*_windows(part, shared, width, rounds, cap)) for part in (regroup.slices(left) if len(shared) else ())]
        return regroup.send(key[0].as_py(), *regroup.merged(held), buckets)

    return run


def _finish(width):
    def run(key, left, right):
        told, least = regroup.gathered(right, True)
        out = [[], [], [], [], []]
        for part in regroup.slices(left):
            hashes, first, docs, valid = _read(part)
            texts = part.column("text").to_pylist()
            keys = window_hashes(hashes, width)
            hit, at = regroup.found(keys, told)
            for i, (text, doc) in enumerate(zip(texts, part.column("doc_id").to_pylist(), strict=True)):
                a, b = int(first[i]), int(first[i + 1])
                words = (text or "").encode().split()
                gone = np.zeros(b - a, bool)
                if b - a >= width and valid[i]:
                    own = slice(a, b - width + 1)
                    flags = hit[own].copy()
                    if flags.any():
                        flags &= least[at[own]] < docs[i] if len(least) else False
                        gone = textvec.covered(flags, width, b - a)
                kept = list(compress(words, ~gone)) if gone.any() else words
                for c, x in zip(out, (doc, b - a, int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), (np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist() if gone.any() else [])), strict=True):
                    c.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return run


def judge(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS, cap: int = CAP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed); removed: begin and end
    of each removed run of words, one after another."""
    base = regroup.grouped(docs)
    buckets = common.shuffle_partitions(docs.sparkSession)
    shared = regroup.answers(base.groupBy("g").applyInArrow(_emit(buckets, width, rounds, cap), regroup.KEYS), False)
    asked = base.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_ask(buckets, width, rounds, cap), regroup.KEYS)
    told = regroup.answers(asked, True)
    return base.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_finish(width), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<int>")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("removed")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS k FROM g),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM h JOIN f USING (k) WHERE first < doc_id),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n_removed FROM a LEFT JOIN c ON c.doc_id = a.doc_id AND c.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
