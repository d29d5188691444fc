"""Operator 5: removal of repeated byte strings, by merging Burrows-Wheeler
transforms of shards.

Every WIDTH-byte window of a document has a minimizer, the smallest hash of its
GRAM-byte substrings; equal windows have equal minimizers. Windows whose minimizer
occurs in one document only can't repeat. The others are sent, as fragments of
neighbouring windows with one minimizer, to the bucket of that minimizer, each
distinct fragment of a document group once. So all occurrences of a window meet in
one bucket, and no bucket needs another.

In a bucket, equal fragments are one. Fragments are dealt to shards, and each shard
gets its suffix array and Burrows-Wheeler transform. The shards are then merged
without sorting suffixes again: an interleave that is right for the first k bytes
becomes right for k + 1 by dealing its entries, in order, to the byte before them,
that is, through the shards' LF mappings. (A round here takes two bytes at once.)
Entries that were in one block and go to the same byte stay in one block; after WIDTH rounds a block is an interval of
suffixes with a common prefix of at least WIDTH bytes. Its smallest doc_id goes back
to the groups that asked, which remove what an earlier document has.

Equal fragments are merged by a 64-bit hash and their bytes; intervals come from the
bytes themselves. A group knows the runs that it is told by their fragments' hashes.

Edge cases. A null or empty text has no bytes, and its remaining bytes are the empty
string. Documents shorter than WIDTH bytes lose nothing. Rows with a null doc_id are
neither judged nor compared with. Repeated rows get equal results, as only smaller
doc_ids count; rows of one doc_id with different texts don't remove one another's
bytes. A very long text is read in one task's memory, its fragments in bounded parts.
Extra columns, of any name, are ignored or kept as they are. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common, regroup, textvec

WIDTH, GRAM, SHARD, SHARDS = 50, 20, 1 << 16, 4
LONGEST = 64  # windows in a fragment at most
FRAGMENTS = "bucket int, g int, keys binary, sizes binary, low binary, high binary, bytes binary"
TOLD = "g int, hashes binary, counts binary, starts binary, lengths binary, least binary"
_BASE = np.uint64(0xE7037ED1A0B428DB)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = textvec.mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * textvec.powers(_BASE, len(data)), out=total[1:])
    return total


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of each run of gram bytes."""
    total = _prefix(data)
    h = (total[gram:] - total[:-gram]) * textvec.powers(_BACK, max(0, len(data) - gram + 1))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


class _Spans:
    """Hashes of spans of at least gram bytes, from those of their grams: as these are
    mixed, no pattern of bytes cancels out in the sum."""

    def __init__(self, h: np.ndarray, gram: int):
        self.gram = gram
        self.total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * textvec.powers(_BASE, len(h)), out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = (end - start).astype(np.uint64)
        part = (self.total[end - self.gram + 1] - self.total[start]) * textvec.powers(_BACK, len(self.total))[start]
        return textvec.mix(part + size * np.uint64(0x9E3779B97F4A7C15))


def fragments(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, width: int, gram: int):
    """(minimizer, start, windows, hash, text) of runs of windows with one minimizer."""
    out = []
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    step = 1 << 18
    for low in range(0, max(0, len(data) - width + 1), step):
        high = min(low + step, len(data) - width + 1)
        own = data[low : high + width - 1]
        h = _grams(own, gram)
        span, wide = 1, width - gram + 1
        m = h
        while 2 * span <= wide:  # minima over 1, 2, 4, ... grams
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < wide:
            m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
        text = of[low:high]
        ok = (text == of[low + width - 1 : high + width - 1]) & valid[text]
        head = np.ones(len(m), bool)
        head[1:] = (m[1:] != m[:-1]) | (ok[1:] != ok[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(head)
        size = np.diff(np.append(at, len(m)))
        at, size = at[ok[at]], size[ok[at]]
        parts = -(-size // LONGEST)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at, left = np.repeat(at, parts) + nth * LONGEST, np.repeat(size, parts) - nth * LONGEST
            size = np.minimum(left, LONGEST)
        out.append((m[at], at + low, size, _Spans(h, gram).hash(at, at + size + width - 1), text[at]))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(np.uint64), z
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _read(part):
    data, offsets = textvec.buffers(part.column("text"))
    valid = ~np.asarray(part.column("doc_id").is_null())
    return data, offsets, regroup.numbers(part.column("doc_id").fill_null(0)), valid


def _emit(buckets: int, width: int, gram: int):
    def run(key, table):
        held = []
        for part in regroup.slices(table):
            data, offsets, docs, valid = _read(part)
            m, _, _, _, text = fragments(data, offsets, valid, width, gram)
            held.append(regroup.distinct(m, docs[text]))
        return regroup.send(key[0].as_py(), *regroup.merged(held), buckets, bounds=False)

    return run


def _ask(buckets: int, width: int, gram: int):
    """Each distinct fragment of the group with a shared minimizer."""

    def run(key, left, right):
        shared, _ = regroup.gathered(right, False)
        held = {k: [] for k in ("m", "hash", "size", "low", "high", "bytes")}
        for part in regroup.slices(left) if len(shared) else ():
            data, offsets, docs, valid = _read(part)
            m, start, windows, h, text = fragments(data, offsets, valid, width, gram)
            hit, _ = regroup.found(m, shared)
            if not hit.any():
                continue
            m, start, windows, h, doc = m[hit], start[hit], windows[hit], h[hit], docs[text[hit]]
            order = np.lexsort((doc, h))
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            one = order[first]
            size = windows[one] + width - 1
            for k, x in zip(held, (m[one], h[one], size, doc[one], doc[order][np.append(first[1:], len(h)) - 1], data[textvec.ragged(start[one], size)]), strict=True):
                held[k].append(x)
        if not held["m"]:
            return _rows([], FRAGMENT_TYPES)
        m, h, size, low, high = (np.concatenate(held[k]) for k in ("m", "hash", "size", "low", "high"))
        blob = np.concatenate(held["bytes"])
        at = np.cumsum(size) - size
        if len(held["m"]) > 1:  # equal fragments of different parts
            order = np.lexsort((low, h))
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            high = np.maximum.reduceat(high[order], first) if len(first) else high
            one = order[first]
            m, size, low, at = m[one], size[one], low[one], at[one]
        bucket = ((m >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((low, bucket))
        m, size, low, high, at, bucket = (x[order] for x in (m, size, low, high, at, bucket))
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(m) else np.zeros(1, int)
        rows = []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            s = slice(i, j)
            same = (low[s] == high[s]).all()
            rows.append((int(bucket[i]), key[0].as_py(), m[s].astype(np.uint32).tobytes(), size[s].astype(np.uint16).tobytes(), low[s].tobytes(), b"" if same else high[s].tobytes(), blob[textvec.ragged(at[s], size[s])].tobytes()))
        return _rows(rows, FRAGMENT_TYPES)

    return run


FRAGMENT_TYPES = dict(bucket=pa.int32(), g=pa.int32(), keys=pa.binary(), sizes=pa.binary(), low=pa.binary(), high=pa.binary(), bytes=pa.binary())
TOLD_TYPES = dict(g=pa.int32(), hashes=pa.binary(), counts=pa.binary(), starts=pa.binary(), lengths=pa.binary(), least=pa.binary())


def _rows(rows: list, types: dict) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types.values(), strict=True)], list(types))


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of fragments that end with a 0 each (at ends). A 0 sorts
    before every byte, and zeros by their place, so no two suffixes are equal."""
    n, span = len(text), 6
    number = np.searchsorted(ends, np.arange(n))  # of each place's fragment
    code, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(span):
        byte = np.zeros(n, np.int64)
        byte[: n - k] = text[k:]
        code = code << 8 | np.where(alive, byte, 0)
        alive &= byte != 0
    bits = int(len(ends)).bit_length()
    code = code << bits | np.where(alive, 0, number) if bits < 15 else np.unique(np.stack([code, np.where(alive, 0, number)], 1), axis=0, return_inverse=True)[1].ravel()
    while True:
        order = np.argsort(code)
        c = code[order]
        new = np.concatenate([np.zeros(1, np.int64), np.cumsum(c[1:] != c[:-1])])
        top = int(new[-1])
        if top == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        # what lies beyond a 0 doesn't matter: suffixes with one differ already
        code = rank * (top + 2)
        code[: n - span] += rank[span:] + 1
        span *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The byte before each suffix, in suffix order (0 before a fragment)."""
    return text[order - 1]  # before the first fragment stands the last 0


def lf_mapping(bwt: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix the place of the one that starts a byte earlier; a whole
    fragment goes to its own 0."""
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = order - 1
    first = np.flatnonzero(bwt == 0)
    number = np.searchsorted(begins, order[first])
    before[first] = ends[number]
    return place[before]


def merge(shards: list[tuple[np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, block): all shards' entries (numbered shard after shard) in the order
    of their first depth bytes, and which of them agree in these. shards: (bwt, lf).
    A round takes two bytes. Entries that meet a 0 there are blocks of their own."""
    base = np.cumsum([0, *(len(b) for b, _ in shards)])
    bwt = np.concatenate([b for b, _ in shards])
    lf = np.concatenate([x + o for (_, x), o in zip(shards, base, strict=False)]).astype(np.int32)
    two, lf_two = bwt[lf].astype(np.uint16) << 8 | bwt, lf[lf]
    end_two = (bwt == 0) | (bwt[lf] == 0)
    entry, block = np.arange(base[-1], dtype=np.int32), np.zeros(base[-1], np.int32)
    for byte, step, end in [(two, lf_two, end_two)] * (depth // 2) + [(bwt, lf, bwt == 0)] * (depth % 2):
        key = byte[entry]
        deal = np.argsort(key, kind="stable")
        key, block, entry = key[deal], block[deal], entry[deal]
        new = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | end[entry[1:]]
        entry = step[entry]
        block[0] = 0
        np.cumsum(new, out=block[1:])
    return entry, block


def _least(blob, at, size, low, width, shard_bytes) -> np.ndarray:
    """For each window of the given fragments, one after another, the smallest low
    of a fragment that holds the same window."""
    shards, owners, places = [], [], []
    cut = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + shard_bytes, shard_bytes)) if len(size) else []
    bounds = np.unique(np.concatenate([[0], cut, [len(size)]]).astype(np.int64))
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        s = size[i:j]
        ends = np.cumsum(s + 1) - 1
        text = np.zeros(ends[-1] + 1, np.uint8)
        begins = ends - s
        own = blob[textvec.ragged(at[i:j], s)]
        text[textvec.ragged(begins, s)] = np.where(own == 0, 255, own)  # 255 is in no UTF-8 text
        order = suffix_order(text, ends)
        bwt = transform(text, order)
        shards.append((bwt, lf_mapping(bwt, order, begins, ends)))
        number = np.searchsorted(ends, order)
        owners.append(number + i)
        places.append(order - begins[number])
    entry, block = merge(shards, width)
    owner, place = np.concatenate(owners)[entry], np.concatenate(places)[entry]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.minimum.reduceat(low[owner], head)[block]
    windows = size - width + 1
    begin = np.cumsum(windows) - windows
    ok = place < windows[owner]
    out = np.empty(windows.sum(), np.int64)
    out[begin[owner[ok]] + place[ok]] = least[ok]
    return out


def _equal(h: np.ndarray, blob: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, of): a fragment for each different one, and which each is like. Bytes decide;
    fragments of one hash with other bytes stay apart."""
    _, one, of = np.unique(h, return_index=True, return_inverse=True)
    same = size == size[one[of]]
    rows = np.flatnonzero(same & (one[of] != np.arange(len(h))))
    for low in range(0, len(rows), 1 << 14):
        r = rows[low : low + (1 << 14)]
        equal = blob[textvec.ragged(at[r], size[r])] == blob[textvec.ragged(at[one[of[r]]], size[r])]
        same[r] = np.logical_and.reduceat(equal, np.cumsum(size[r]) - size[r])
    odd = np.flatnonzero(~same)
    of[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), of


def _judge(width: int, gram: int, shard_bytes: int):
    def run(table):
        table = table.combine_chunks()
        read = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
        keys, sizes, lows, blobs = read("keys", np.uint32), read("sizes", np.uint16), read("low", np.int64), read("bytes", np.uint8)
        highs = [np.frombuffer(x, np.int64) if x else y for x, y in zip(table.column("high").to_pylist(), lows, strict=True)]
        row = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        key, size, low, high, blob = np.concatenate(keys), np.concatenate(sizes).astype(np.int64), np.concatenate(lows), np.concatenate(highs), np.concatenate(blobs)
        at = np.cumsum(size) - size
        h = np.empty(len(size), np.uint64)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 18))))
            base, end = at[i], at[j - 1] + size[j - 1]
            h[i:j] = _Spans(_grams(blob[base:end], gram), gram).hash(at[i:j] - base, at[i:j] - base + size[i:j])
            i = j
        # equal fragments are one, with the smallest document of all
        one, of = _equal(h, blob, at, size)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, of, low)
        kinds = np.unique(key[one], return_inverse=True)[1]
        many = np.flatnonzero(np.bincount(kinds)[kinds] > 1)
        many = many[np.argsort(kinds[many], kind="stable")]
        windows = size[one] - width + 1
        counts, starts, lengths, minima = np.ones(len(one), np.int64), np.zeros(len(one), np.int64), windows, least
        if len(many):
            # minimizers don't mix: merge a few shards' worth of them at a time
            total, kind = np.cumsum(size[one[many]]), kinds[many]
            last = np.flatnonzero(np.append(kind[1:] != kind[:-1], True))
            ends = last[np.unique(np.searchsorted(total[last], np.arange(SHARDS * shard_bytes, total[-1] + SHARDS * shard_bytes, SHARDS * shard_bytes)).clip(max=len(last) - 1))] + 1
            got = np.concatenate([_least(blob, at[one[m]], size[one[m]], least[m], width, shard_bytes) for m in np.split(many, ends[:-1])])
            w = windows[many]
            begin = np.cumsum(w) - w
            head = np.ones(len(got), bool)
            head[1:] = got[1:] != got[:-1]
            head[begin] = True
            where = np.flatnonzero(head)
            run_len = np.diff(np.append(where, len(got)))
            owner = np.searchsorted(begin, where, "right") - 1
            single = np.ones(len(one), bool)
            single[many] = False
            rest = np.flatnonzero(single)
            who = np.concatenate([rest, many[owner]])
            order = np.argsort(who, kind="stable")
            starts = np.concatenate([np.zeros(len(rest), np.int64), where - begin[owner]])[order]
            lengths = np.concatenate([windows[rest], run_len])[order]
            minima = np.concatenate([least[rest], got[where]])[order]
            counts = np.bincount(who, minlength=len(one))
        first = np.cumsum(counts) - counts
        # each asked fragment gets the runs that come before its last document
        asked = np.repeat(np.arange(len(h)), counts[of])
        runs = textvec.ragged(first[of], counts[of])
        ok = minima[runs] < high[asked]
        asked, runs = asked[ok], runs[ok]
        told, n = np.unique(asked, return_counts=True)
        rows, g = [], table.column("g").to_pylist()
        t_cut, r_cut = np.searchsorted(row[told], np.arange(len(g) + 1)), np.concatenate([[0], np.cumsum(n)])
        for i in range(len(g)):
            a, b = t_cut[i], t_cut[i + 1]
            if a < b:
                r = runs[r_cut[a] : r_cut[b]]
                rows.append((g[i], h[told[a:b]].tobytes(), n[a:b].astype(np.uint16).tobytes(), starts[r].astype(np.uint16).tobytes(), lengths[r].astype(np.uint16).tobytes(), minima[r].tobytes()))
        return _rows(rows, TOLD_TYPES)

    return run


def _removals(part, right, width: int, gram: int):
    """What to remove: a flag for each byte of the part's texts."""
    told, counts, first, starts, lengths, least = right
    data, offsets, docs, valid = _read(part)
    gone = np.zeros(len(data), bool)
    if len(told):
        _, start, _, h, text = fragments(data, offsets, valid, width, gram)
        hit, at = regroup.found(h, told)
        at, start, doc = at[hit], start[hit], docs[text[hit]]
        runs = textvec.ragged(first[at], counts[at])
        start, doc = np.repeat(start, counts[at]) + starts[runs], np.repeat(doc, counts[at])
        ok = least[runs] < doc
        a, b = start[ok], start[ok] + lengths[runs][ok] + width - 1
        steps = np.bincount(a, minlength=len(data) + 1) - np.bincount(b, minlength=len(data) + 1)
        gone = np.cumsum(steps)[: len(data)] > 0
    return data, offsets, gone


def _told(right):
    read = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(x, t) for x in right.column(c).to_pylist())])
    told, counts = read("hashes", np.uint64), read("counts", np.uint16).astype(np.int64)
    first = np.cumsum(counts) - counts
    order = np.argsort(told)
    return told[order], counts[order], first[order], read("starts", np.uint16).astype(np.int64), read("lengths", np.uint16).astype(np.int64), read("least", np.int64)


def _finish(width: int, gram: int):
    def run(key, left, right):
        told, out = _told(right), [[], [], [], [], [], []]
        for part in regroup.slices(left):
            data, offsets, gone = _removals(part, told, width, gram)
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                a, b = offsets[i], offsets[i + 1]
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).tolist() if own.any() else []
                kept = data[a:b][~own] if edges else data[a:b]
                for c, x in zip(out, (doc, int(b - a), int(own.sum()), len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), edges), strict=True):
                    c.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def _rewrite(width: int, gram: int):
    def run(key, left, right):
        told, parts = _told(right), []
        for part in regroup.slices(left):
            data, offsets, gone = _removals(part, told, width, gram)
            null = np.asarray(part.column("text").is_null())
            texts = [None if n else data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b, n in zip(offsets[:-1], offsets[1:], null, strict=True)]
            parts.append(pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "text"]))
        return pa.Table.from_batches(parts)

    return run


def _asked(docs: DataFrame, width: int, gram: int, shard_bytes: int, carry: bool = False):
    """The documents by group, and what each group is told."""
    base = regroup.grouped(docs, carry=carry)
    buckets = common.shuffle_partitions(docs.sparkSession)
    shared = regroup.answers(base.groupBy("g").applyInArrow(_emit(buckets, width, gram), regroup.KEYS), False)
    asked = base.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_ask(buckets, width, gram), FRAGMENTS)
    return base, asked.groupBy("bucket").applyInArrow(_judge(width, gram, shard_bytes), TOLD)


def judge(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed): removed is begin
    and end of each removed run of bytes, one after another."""
    base, told = _asked(docs, width, gram, shard_bytes)
    return base.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_finish(width, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<int>")


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD) -> DataFrame:
    """docs with the repeated bytes cut from text, and the same columns. What a cut
    leaves of a character goes too."""
    base, told = _asked(docs, width, gram, shard_bytes, carry=True)
    schema = StructType([base.schema["row"], StructField("text", StringType())])
    out = base.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_rewrite(width, gram), schema)
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("removed")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
b AS (SELECT doc_id, unnest(range(0, CAST(length(x) // 2 - 49 AS BIGINT), 200)) AS b, x FROM t WHERE length(x) >= 100),
u AS (SELECT doc_id, b, substr(x, 2 * b + 1, 498) AS u FROM b),
g AS (SELECT doc_id, b, u, unnest(range(0, length(u) // 2 - 49)) AS o FROM u),
h AS (SELECT doc_id, b + o AS i, hash(substr(u, 2 * o + 1, 100)) AS k FROM g),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
c AS (SELECT doc_id, i FROM h JOIN f USING (k) WHERE first < doc_id),
s AS (SELECT *, coalesce(i > lag(i) OVER w + 50, true) AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
q AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(b) OVER w, 0) AS was FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
p AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last FROM q GROUP BY doc_id),
j AS (SELECT k.doc_id, string_agg(substr(t.x, CAST(2 * was + 1 AS BIGINT), CAST(2 * (a - was) AS BIGINT)), '' ORDER BY a) AS kept FROM k JOIN t ON t.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN p.doc_id IS NULL THEN x ELSE j.kept || substr(x, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM t LEFT JOIN p ON p.doc_id = t.doc_id LEFT JOIN j ON j.doc_id = t.doc_id
"""
