"""Asking questions about keys across all documents, without a row for each key.

Documents are dealt to groups by a hash, once; every step below reads that same
exchange. A group sends its distinct keys, packed into one row for each key bucket,
so that a key costs its own 8 bytes, and a key that a third of all documents hold
costs one entry for each group, not one for each document. A bucket compares what
the groups sent and answers each group about its own keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, textvec

KEYS = "bucket int, g int, keys binary, low binary, high binary"
ANSWERS = "g int, keys binary, least binary"
PART = 1 << 19


def grouped(docs: DataFrame, per_partition: int = 2, carry: bool = False) -> DataFrame:
    """(g, doc_id, text; carry: and the other columns as row) with the rows of a group in one partition. A group sends a
    row to each bucket, so groups are few for each partition; a partition's text
    must fit a task anyway, and spark.sql.shuffle.partitions grows with the input."""
    n = common.shuffle_partitions(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct(*(common.column(c) for c in docs.columns if c != "text")).alias("row")] if carry else []))
    return plain.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n * per_partition)).cast("int")).repartition(n, "g")


def slices(table: pa.Table, size: int = PART):
    """The table in parts of about so many bytes of text, at least a row each."""
    table = table.combine_chunks()
    for batch in table.to_batches():
        for low, high in textvec.slices(batch.column("text"), size):
            yield batch.slice(low, high - low)


def numbers(column, dtype=np.int64) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype)


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, with the smallest and the largest document that has it."""
    if not len(keys):
        return keys, docs, docs
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    last = np.append(head[1:], len(k)) - 1
    return k[head], d[head], d[last]


def merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What distinct gave for each part, as for all of them."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(held) == 1:
        return held[0]
    keys = np.concatenate([x[0] for x in held])
    return distinct(np.concatenate([keys, keys]), np.concatenate([*(x[1] for x in held), *(x[2] for x in held)]))


def send(g: int, keys: np.ndarray, low: np.ndarray, high: np.ndarray, buckets: int, bounds: bool = True) -> pa.Table:
    """One row for each bucket; without bounds, low only says whether several
    documents of the group have the key."""
    bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((keys, low, bucket)) if bounds else np.lexsort((keys, bucket))
    keys, low, high, bucket = keys[order], low[order], high[order], bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(keys))[: len(at)]
    more = (low != high)
    first = low if bounds else more.astype(np.uint8)
    rows = [(int(bucket[i]), g, keys[i:j].tobytes(), first[i:j].tobytes(), b"" if not bounds or not more[i:j].any() else high[i:j].tobytes()) for i, j in zip(at, ends, strict=True)]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["bucket", "g", "keys", "low", "high"])


def _answer(bounds: bool):
    """For a bucket: to each group, its keys that another document has (without
    bounds), or its keys with a document after their smallest, and that one."""

    def run(table):
        table = table.combine_chunks()
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        sizes = np.array([len(x) for x in keys])
        k = np.concatenate(keys)
        row = np.repeat(np.arange(len(keys)), sizes)
        if bounds:
            lows = [np.frombuffer(x, np.int64) for x in table.column("low").to_pylist()]
            highs = [np.frombuffer(x, np.int64) if x else y for x, y in zip(table.column("high").to_pylist(), lows, strict=True)]
            low, high = np.concatenate(lows), np.concatenate(highs)
            order = np.lexsort((low, k))
        else:
            flag = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("low").to_pylist()]).astype(bool)
            order = np.argsort(k, kind="stable")
        s = k[order]
        head = np.concatenate([[True], s[1:] != s[:-1]])
        of = np.cumsum(head) - 1
        if bounds:
            least = np.empty_like(low)
            least[order] = low[order][head][of]
            told = least < high
        else:
            at = np.flatnonzero(head)
            shared = (np.append(at[1:], len(s)) - at > 1) | np.logical_or.reduceat(flag[order], at)
            told = np.empty(len(k), bool)
            told[order] = shared[of]
        g = table.column("g").to_pylist()
        out = []
        cut = np.concatenate([[0], np.cumsum(sizes)])
        hit = np.add.reduceat(told, cut[:-1])
        for i in np.flatnonzero(hit):
            m = told[cut[i] : cut[i + 1]]
            out.append((g[i], keys[i][m].tobytes(), least[cut[i] : cut[i + 1]][m].tobytes() if bounds else b""))
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["g", "keys", "least"])

    return run


def answers(sent: DataFrame, bounds: bool) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_answer(bounds), ANSWERS)


def gathered(table: pa.Table, bounds: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a group was told: its keys in order, and their smallest documents."""
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    least = [np.frombuffer(x, np.int64) for x in table.column("least").to_pylist()] if bounds else []
    least = np.concatenate(least) if least else np.zeros(len(k), np.int64)
    order = np.argsort(k)
    return k[order], least[order]


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted ones, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at
