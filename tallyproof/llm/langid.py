"""Operator 12: language identification by rank-order profiles.

A text is lower-cased; its letters form words with a boundary on each side, and the
n-grams of one to three characters within each word are counted. A language's profile
is its PROFILE most frequent n-grams over all documents it is learned from, by rank. A
document's own most frequent n-grams are compared with each profile by the out-of-place
distance: how far each n-gram's rank is from its rank in the profile, PROFILE for one
that isn't there, summed. The nearest profile is the prediction.

Tasks count the n-grams of their documents by language and send each once; Spark adds
them up, and takes the first PROFILE of each language. All training documents count,
whole. Profiles are sent to all tasks: PROFILE rows for each language, and more than
LANGUAGES languages are refused, which bounds them.

The score is the share by which the nearest profile is nearer than the next (with one
language: than a text that shares no n-gram with it), from 0 for a tie to 1.

Edge cases. A text that is null or has no letter is `und` with score 0, so is any text
if nothing could be learned. Ties between n-grams go to the smaller in code point order,
ties between languages to the smaller name; a text that shares no n-gram with any profile
is such a tie. Null languages and null doc_ids aren't learned from; held_out is null for
the latter. Repeated rows count as often as they occur. A very long text costs one task
about 40 bytes a character. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common, textvec

PROFILE, LANGUAGES = 400, 4096
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
_PART, _FLUSH = 1 << 20, 1 << 20


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, alphabet): the letters of all texts as places in alphabet, with 1
    for a boundary, which each run of other characters leaves once, before and after
    each text too. first: where each text begins, its last boundary being the next
    one's first. alphabet is in code point order after 0 (nothing) and the boundary."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(f" {t}" for t in lowered).encode("utf-32-le", "surrogatepass") + " ".encode("utf-32-le"), np.uint32)
    own = letters()[points]
    edge = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    keep = own.copy()
    keep[0] = True
    keep[1:] |= own[:-1]
    keep[edge] = True
    kept = np.where(own, points, np.uint32(32))[keep]
    alphabet, codes = np.unique(kept, return_inverse=True)
    at = np.cumsum(keep) - 1
    if not len(alphabet) or alphabet[0] != 32:
        raise AssertionError("a boundary comes first")
    return codes + 1, at[edge], np.concatenate([[0], alphabet]).astype(np.uint64)


def grams(codes: np.ndarray, base: int) -> np.ndarray:
    """The n-grams of one text (or several) as numbers of three digits; shorter ones end
    in zeros."""
    one = codes[codes > 1]
    two = codes[:-1] * base + codes[1:]
    both = (codes[:-1] > 1) | (codes[1:] > 1)
    three = two[:-1] * base + codes[2:]
    return np.concatenate([one * base * base, two[both] * base, three[codes[1:-1] > 1]])


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(found)
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[head], np.diff(np.append(head, len(s)))


def ranked(found: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, ties to the smaller."""
    keys, counts = counted(found)
    if len(keys) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:n]]


def _packed(keys: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """Three digits as three code points of 21 bits each."""
    base = len(alphabet)
    a, b, c = (alphabet[x] << np.uint64(21 * k) for x, k in ((keys // (base * base), 2), (keys // base % base, 1), (keys % base, 0)))
    return a | b | c


def _unpacked(packed: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, known): the reverse for those whose letters are all in alphabet."""
    base, keys, known = len(alphabet), np.zeros(len(packed), np.int64), np.ones(len(packed), bool)
    for k in (2, 1, 0):
        point = (packed >> np.uint64(21 * k)) & np.uint64((1 << 21) - 1)
        at = np.minimum(np.searchsorted(alphabet, point), base - 1)
        known &= alphabet[at] == point
        keys = keys * base + at
    return keys, known


def _count(batches):
    held: dict = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys = np.concatenate([p[0] for p in parts])
            order = np.argsort(keys, kind="stable")
            s = keys[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            total = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], head)
            for low in range(0, len(head), 1 << 16):
                own = head[low : low + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(s[own].view(np.int64)), pa.array(total[low : low + (1 << 16)])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for low, high in textvec.slices(batch.column("text"), _PART):
            texts, langs = (batch.column(c).slice(low, high - low).to_pylist() for c in ("text", "lang"))
            for lang in set(langs):
                codes, _, alphabet = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang])
                keys, counts = counted(grams(codes, len(alphabet)))
                if len(keys):
                    held.setdefault(lang, []).append((_packed(keys, alphabet), counts))
                    size += len(keys)
            if size > _FLUSH:
                yield from flush()
                size = 0
    yield from flush()


def profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, rank, gram, n): the most frequent n-grams of each language. gram: its code
    points, 21 bits each."""
    plain = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    totals = plain.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return totals.withColumn("rank", rank).where(F.col("rank") <= size)


def distances(own: np.ndarray, union: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The out-of-place distance of a ranked list to each language. union: all n-grams
    of the profiles in order; places: by n-gram and language, its rank, or size and
    more where the profile lacks it."""
    at = np.minimum(np.searchsorted(union, own), len(union) - 1)
    rank = places[at]
    lacking = (union[at] != own)[:, None] | (rank >= size)
    return np.where(lacking, size, np.abs(rank - np.arange(len(own))[:, None])).sum(0)


def _predict(names: list, table: np.ndarray, places: np.ndarray, size: int):
    """table: n-grams of all profiles, packed, in order."""

    def judged(codes, base, union, rank):
        own = ranked(grams(codes, base), size)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        if not len(union):
            return names[0], 0.0
        far = distances(own, union, rank, size)
        best = int(far.argmin())
        next_one = int(np.delete(far, best).min()) if len(names) > 1 else len(own) * size
        return names[best], 1 - float(far[best]) / next_one if next_one else 0.0

    def run(batches):
        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), _PART):
                part = batch.slice(low, high - low)
                codes, first, alphabet = symbols(part.column("text").to_pylist())
                keys, known = _unpacked(table, alphabet)
                said = [judged(codes[i : j + 1], len(alphabet), keys[known], places[known]) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("long").cast("string")) % FOLDS


def predict(docs: DataFrame, learned: DataFrame, held_out: Column, size: int = PROFILE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document by the profiles learned."""
    n = learned.select("lang").distinct().limit(LANGUAGES + 1).count()
    if n > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: profiles that large aren't sent to all tasks")
    rows = learned.select("lang", "rank", "gram").collect()  # at most LANGUAGES * size
    names = sorted({r["lang"] for r in rows})
    of = {name: i for i, name in enumerate(names)}
    table = np.array(sorted({r["gram"] for r in rows}), np.uint64)
    where = {g: i for i, g in enumerate(table.tolist())}
    places = np.full((len(table), len(names)), size, np.int32)
    for r in rows:
        places[where[r["gram"]], of[r["lang"]]] = r["rank"] - 1
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    return plain.mapInArrow(_predict(names, table, places, size), "doc_id long, held_out boolean, lang_pred string, score double")


def op12_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    own = fold(F.col("doc_id"))
    learned = common.stored(profiles(docs.where(own != HELD_OUT)), "profiles")
    return predict(docs, learned, own == HELD_OUT)
