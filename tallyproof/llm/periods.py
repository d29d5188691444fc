"""Operator 13: periodic runs of words, by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q, at least LEAST words
and TIMES periods long, that no neighbouring word extends. Each word of a run occurs
in it once a period, so at least TIMES times: a word that occurs less often within a
segment is in none of the segment's runs and splits it. The pieces are counted anew,
until no piece changes; only the smaller pieces are walked again, the largest keeps
its counts less theirs, so that splitting takes n log n steps however deep it goes.

Surviving segments are scanned lag by lag. A run of period q holds TIMES - 1 whole
blocks between multiples of q that are equal, so lag q looks at n / q places only.
Blocks are compared by two names of a power of two words each, which are ranks of
pairs of half as long ones: equality is exact, no hash decides. A scan ends at the
first power of two of which no stretch occurs TIMES - 1 times. Whatever it finds is
extended word by word; a place inside a run already found is that run seen at a
multiple of its period.

Edge cases. A null or empty text has no words and no runs. A null doc_id is judged as
it is (it has no number to alter its text by, see altered). Equal starts are ordered
by period. Repeated rows get equal results. A very long text costs one task its words
and their ids. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LEAST, TIMES = 6, 4
RESULT = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<long>"


def word_ids(words: list) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def segments(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(begin, end) of the stretches in which every word occurs often enough."""
    often = np.bincount(ids)[ids] >= times if len(ids) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], often, [0]])))
    todo = [(a, b, None) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]
    if not todo:
        return []
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], np.arange(ids.max() + 2)).tolist()
    order, plain, out = order.tolist(), ids.tolist(), []
    while todo:
        a, b, state = todo.pop()
        if state is None:
            count = Counter(plain[a:b])
            rare = [w for w, n in count.items() if n < times]
        else:
            count, rare = state
        if not rare:
            out.append((a, b))
            continue
        cuts = []
        for w in rare:
            lo = bisect_left(order, a, first[w], first[w + 1])
            cuts += order[lo : lo + count.pop(w)]
        cuts.sort()
        pieces = [(x + 1, y) for x, y in zip([a - 1, *cuts], [*cuts, b], strict=True)]
        big = max(pieces, key=lambda p: p[1] - p[0])
        if big[1] - big[0] < least:
            continue
        lost = set()
        for x, y in pieces:
            if (x, y) == big:
                continue
            for w in plain[x:y]:
                count[w] -= 1
                lost.add(w)
            if y - x >= least:
                todo.append((x, y, None))
        for w in [w for w in lost if not count[w]]:
            del count[w]
        todo.append((*big, (count, [w for w in lost if 0 < count.get(w, 0) < times])))
    return sorted(out)


def _reach(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around at in which words lag apart are equal."""
    n, size, right = len(ids) - lag, 64, at
    while right < n:
        part = ids[right : min(n, right + size)] != ids[right + lag : min(n, right + size) + lag]
        if part.any():
            right += int(part.argmax())
            break
        right, size = right + len(part), 2 * size
    left, size = at, 64
    while left > 0:
        low = max(0, left - size)
        part = (ids[low:left] != ids[low + lag : left + lag])[::-1]
        if part.any():
            left -= int(part.argmax())
            break
        left, size = low, 2 * size
    return left, right + lag


def scan(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n, out = len(ids), []
    known = np.zeros(n, np.int64)  # the furthest end of a run found that holds the place
    names, half = np.unique(ids, return_inverse=True)[1], 1
    while times * half <= n:
        if np.bincount(names).max() < times - 1:
            break
        for lag in range(half, min(2 * half, n // times + 1)):
            at = np.arange(0, n - lag, lag)[: n // lag - 1]
            same = (names[at] == names[at + lag]) & (names[at + lag - half] == names[at + 2 * lag - half])
            for _ in range(times - 3):
                same = same[:-1] & same[1:]
            at = at[: len(same)][same]
            at = at[known[at] < at + (times - 1) * lag]
            done = 0
            for i in at.tolist():
                if i < done:
                    continue
                low, done = _reach(ids, i, lag)
                if done - low >= max(least, times * lag):
                    out.append((low, done - low, lag))
                    np.maximum(known[low:done], done, out=known[low:done])
        pairs = names[: len(names) - half] * (names.max() + 1) + names[half:]
        names, half = np.unique(pairs, return_inverse=True)[1], 2 * half
    return out


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. times: 3 at least."""
    if len(words) < least:
        return []
    ids = word_ids(words)
    return sorted((a + s, length, q) for a, b in segments(ids, least, times) for s, length, q in scan(ids[a:b], least, times))


def altered(words: list, doc_id) -> list:
    """The words of a document whose number tells to repeat them: for a tenth of all
    documents, the words from some place on become a period of some length."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def collapsed(words: list, found: list) -> list:
    """Words without those that any run has after its first period."""
    if not found:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    return list(compress(words, np.cumsum(steps)[:-1] == 0))


def _judge(alter, least, times):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                words = alter(words, doc) if alter else words
                found = runs(words, least, times)
                best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None, None, None)
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
                milli = 1000 * best[1] // best[2] if found else None
                rows.append((doc, len(words), len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest(), [x for r in found for x in r]))
            types = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64())]
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            names = [f.split()[0] for f in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return run


def judge(docs: DataFrame, alter=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The run of largest exponent of each document, digests of all its runs and of its
    collapsed words, and runs: start, length, period of each, one after another. alter:
    a function of words and doc_id that gives the words to judge."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_judge(alter, least, times), RESULT)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), altered).drop("runs", "n_words")
