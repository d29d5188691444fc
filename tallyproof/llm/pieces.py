"""Operator 9: sampled SentencePiece encoding, and decoding.

A text is segmented into pieces of a SentencePiece model at random: forward
filtering sums, at each place, the weights of all segmentations up to it, and
backward sampling draws one from the end, each with the probability that its
weights give it. The random numbers are hashes of the seed, the row's key, the
unit's place in the text and the step, so that a row gets the same pieces on every
run, wherever it is computed. Decoding gives the text back exactly: spaces are the
model's meta symbol, characters without a piece are byte pieces, and a meta symbol
in the text itself is bytes too.

No piece reaches over the start of a word, so a text is cut into units (a word with
its leading spaces, or a line feed); a task builds the lattice of each distinct unit
once and keeps it (up to EDGES edges, then it begins anew), and all units of a batch's
texts take their backward steps together. A draw depends on its own node alone, so a
row's pieces don't depend on what it is computed with. Piece weights come from the pieces' rank in the
model: (rank + 2) ** -smoothing, where a smaller smoothing gives flatter samples.
(The model in use is a BPE one: it has ranks, no probabilities.)

Edge cases. A null text is encoded as null; an empty one as no pieces. A null key is
a key of its own. Repeated rows get equal results. Rows with one key and different
texts draw the same numbers. A very long text is one batch in one task's memory; long
units are handled in the log domain one by one. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, textvec

SEED, SMOOTHING, PART, LONG = 9, 1.0, 1 << 21, 48
#: Slots for units that a task keeps, and edges after which it begins anew.
KEPT, EDGES = 1 << 18, 1 << 23
NONE, BEGINS = -1, -2
META = "▁"
_BASE = np.uint64(0x9E6C63D0876A9A47)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_PLACE = textvec.odd(np.arange(256))
_CHARS = textvec.mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) | np.uint64(1)


def _char(c: np.ndarray) -> np.ndarray:
    """A random odd number for each code point."""
    out = _CHARS[c & 0xFFFF]
    far = np.flatnonzero(c >> 16)
    if len(far):
        out[far] = textvec.mix(c[far].astype(np.uint64) + np.uint64(1)) | np.uint64(1)
    return out


class Model:
    def __init__(self, path: str, smoothing: float = SMOOTHING):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte = np.full(256, -1, np.int32)
        self.bytes_of: list = [b""] * n
        pieces = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = p.replace(META, " ")
                self.bytes_of[i] = text.encode()
                if " " not in text.lstrip(" ") and "\n" not in text:
                    pieces.append((i, text, sp.get_score(i)))
        pieces.sort(key=lambda x: -x[2])
        self.size = n
        self.longest = max(len(t) for _, t, _ in pieces)
        self.weight = np.zeros(n)
        self.weight[[i for i, _, _ in pieces]] = (np.arange(len(pieces)) + 2.0) ** -smoothing
        self.of = {t: i for i, t, _ in pieces}
        self.least = self.weight[self.weight > 0].min()
        joined = np.frombuffer("".join(t for _, t, _ in pieces).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(t) for _, t, _ in pieces])
        begins = np.cumsum(sizes) - sizes
        self.text, self.text_at, self.long = np.append(joined, np.zeros(self.longest, np.uint32)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        numbers = np.array([i for i, _, _ in pieces])
        self.text_at[numbers], self.long[numbers] = begins, sizes
        # a table of the hashes of all pieces and of what pieces begin with
        known, total = {}, self.prefix(joined)
        for k in range(1, self.longest + 1):
            own = np.flatnonzero(sizes >= k)
            for h, whole, i in zip(self.spans(joined, begins[own], k, total).tolist(), sizes[own] == k, numbers[own].tolist(), strict=True):
                if whole:
                    known[h] = i
                else:
                    known.setdefault(h, BEGINS)
        bits = int(2 * len(known)).bit_length()
        self.keys, self.ids, self.shift = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits)
        for h, i in known.items():
            at = h >> (64 - bits)
            while self.keys[at]:
                at = (at + 1) % (1 << bits)
            self.keys[at], self.ids[at] = h, i
        lengths = np.array([len(b) for b in self.bytes_of])
        self.flat, self.flat_len = np.frombuffer(b"".join(self.bytes_of), np.uint8), lengths
        self.flat_at = np.cumsum(lengths) - lengths

    def spans(self, c: np.ndarray, starts: np.ndarray, length, total: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the spans of that length."""
        if total is None:
            total = self.prefix(c)
        return textvec.mix((total[starts + length] - total[starts]) * textvec.powers(_BACK, len(total))[starts]) | np.uint64(1)

    def prefix(self, c: np.ndarray) -> np.ndarray:
        total = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(_char(c) * textvec.powers(_BASE, len(c)), out=total[1:])
        return total

    def spelled(self, ids: np.ndarray, c: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """Whether pieces of k characters are what starts there in c."""
        out = self.long[ids] == k
        for i in range(k):
            out &= self.text[self.text_at[ids] + i] == c[starts + i]
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with that hash, BEGINS if pieces begin with it, or NONE."""
        out = np.full(len(h), NONE, np.int32)
        at, left = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(left):
            k = self.keys[at]
            hit = k == h[left]
            out[left[hit]] = self.ids[at[hit]]
            go = ~hit & (k != 0)
            left, at = left[go], (at[go] + 1) % len(self.keys)
        return out


def units(c: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where units begin in the code points of texts that begin at bounds."""
    if not len(c):
        return np.zeros(0, np.int64)
    start = np.zeros(len(c), bool)
    start[bounds[bounds < len(c)]] = True
    alone = (c == 10) | (c == ord(META))
    start |= alone
    start[1:] |= alone[:-1] | ((c[1:] == 32) & (c[:-1] != 32))
    return np.flatnonzero(start)


class Lattice:
    """All segmentations of the units added so far, and where each unit is. Node
    start[u] + i stands before the i-th character of unit u; the edges into a node lie
    together, the longest first, with the running sum of their chances in the node."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.number = np.zeros((2, KEPT), np.uint64), np.zeros((2, KEPT), np.int32)
        self.reset()

    def reset(self) -> None:
        self.keys[:] = 0
        self.first, self.last = np.zeros(0, np.int32), np.zeros(0, np.int32)  # edges of each node
        self.src, self.piece, self.cum = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars = np.zeros(0, np.uint32)  # of unit u from start[u] - u on

    def same(self, units: np.ndarray, c: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether units are those that start there in c."""
        out = self.size[units] == size
        at = np.flatnonzero(out)
        own = size[at]
        if len(at):
            equal = self.chars[textvec.ragged(self.start[units[at]] - units[at], own)] == c[textvec.ragged(starts[at], own)]
            out[at] = np.logical_and.reduceat(equal, np.cumsum(own) - own)
        return out

    def find(self, c: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of units; new ones are added. Characters are compared, so units
        of one hash don't mix."""
        if len(self.src) > EDGES:
            self.reset()
        h = _unit_hashes(c, starts, size)
        slots = (h >> np.uint64(44)).astype(np.int64) % KEPT, ((h >> np.uint64(20)) & np.uint64(KEPT - 1)).astype(np.int64)
        a = self.keys[0][slots[0]] == h
        out = np.where(a, self.number[0][slots[0]], self.number[1][slots[1]]).astype(np.int64)
        known = a | (self.keys[1][slots[1]] == h)
        at = np.flatnonzero(known)
        known[at] = self.same(out[at], c, starts[at], size[at])
        while True:
            miss = np.flatnonzero(~known)
            if not len(miss):
                return out
            new, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at, base = miss[one], len(self.start)
            self.add(c[textvec.ragged(starts[at], size[at])], size[at])
            out[miss] = base + back
            known[miss] = self.same(out[miss], c, starts[miss], size[miss])
            numbers = base + np.arange(len(new), dtype=np.int32)
            s0, s1 = slots[0][at], slots[1][at]
            free = self.keys[0][s0] == 0
            self.keys[0][s0[free]], self.number[0][s0[free]] = new[free], numbers[free]
            self.keys[1][s1[~free]], self.number[1][s1[~free]] = new[~free], numbers[~free]

    def add(self, c: np.ndarray, size: np.ndarray) -> None:
        """Appends units whose code points lie one after another in c."""
        model, n, count = self.model, len(c), len(size)
        begin = np.cumsum(size) - size
        unit = np.repeat(np.arange(count), size)
        left = (begin + size)[unit] - np.arange(n)  # characters to the unit's end
        total = model.prefix(c)
        src, length, piece = [], [], []
        at, k = np.arange(n), 1
        while len(at):
            found = model.find(model.spans(c, at, k, total))
            hit = np.flatnonzero(found >= 0)
            hit = hit[model.spelled(found[hit], c, at[hit], k)]
            if k == 1:  # a character without a piece is its bytes: -1 - its code point
                own = (-1 - c.astype(np.int64)).astype(np.int32)
                own[hit] = found[hit]
                src.append(at), piece.append(own)
            else:
                src.append(at[hit]), piece.append(found[hit])
            length.append(np.full(len(src[-1]), k))
            at, k = at[(found != NONE) & (left[at] > k)], k + 1  # pieces begin like that
        src, length, piece = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (src, length, piece))
        start = begin + np.arange(count)  # first node of each unit
        node = src + unit[src]
        order = np.argsort(node + length, kind="stable")  # in a node the longest first, mostly the likeliest
        src, length, piece, node = src[order], length[order], piece[order], node[order]
        target = node + length
        weight = np.where(piece >= 0, model.weight[np.maximum(piece, 0)], model.least) * 64.0**length
        first = np.searchsorted(target, np.arange(n + count + 1))
        own = unit[src]
        chance = self._forward(node, target, np.where(size[own] <= LONG, src + length - begin[own], 0), weight, first, start, size)
        width = np.diff(first)
        wide = np.flatnonzero(width > 1)
        for k in range(1, int(width.max(initial=0))):
            wide = wide[width[wide] > k]
            e = first[wide] + k
            chance[e] += chance[e - 1]
        edges, nodes = len(self.src), len(self.first)
        self.start, self.size = np.concatenate([self.start, start + nodes]), np.concatenate([self.size, size])
        self.chars = np.concatenate([self.chars, c])
        add = lambda x, y: np.concatenate([x, y.astype(x.dtype)])
        self.first, self.last = add(self.first, first[:-1] + edges), add(self.last, first[1:] + (edges - 1))
        self.src, self.piece, self.cum = add(self.src, node + nodes), add(self.piece, piece), add(self.cum, chance)

    @staticmethod
    def _forward(src, target, depth, weight, first, start, size):
        """The chance of each edge among those into its node; depth: how far it
        reaches into its unit, 0 in long units."""
        alpha = np.zeros(len(first) - 1)
        alpha[start] = 1.0
        chance = np.zeros(len(weight))
        by = np.argsort(depth.astype(np.uint8), kind="stable")
        cut = np.cumsum(np.bincount(depth, minlength=LONG + 1))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            e = by[a:b]
            if not len(e):
                continue
            value, into = alpha[src[e]] * weight[e], target[e]
            head = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]]))
            sums = np.add.reduceat(value, head)
            alpha[into[head]] = sums
            chance[e] = value / np.repeat(sums, np.diff(np.append(head, len(e))))
        for u in np.flatnonzero(size > LONG):  # in logs, node by node
            log = np.full(size[u] + 1, -np.inf)
            log[0] = 0.0
            base = start[u]
            for i in range(1, size[u] + 1):
                e = slice(first[base + i], first[base + i + 1])
                value = log[src[e] - base] + np.log(weight[e])
                top = value.max()
                share = np.exp(value - top)
                log[i] = top + np.log(share.sum())
                chance[e] = share / share.sum()
        return chance

    def sample(self, which: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many) of one sampled path of each of the units; keys: 64-bit
        seeds of the units. A draw looks at its own node only."""
        floor = self.start[which]
        node = floor + self.size[which]
        live = np.arange(len(which))
        at, low, seed = node, floor, keys
        taken, count = [], np.zeros(len(which), np.int32)
        step = 0
        while len(live):
            u = (textvec.mix(seed + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, last = self.first[at], self.last[at]
            more = np.flatnonzero((u >= self.cum[edge]) & (edge < last))
            while len(more):
                edge[more] += 1
                e = edge[more]
                more = more[(u[more] >= self.cum[e]) & (e < last[more])]
            taken.append((live, self.piece[edge]))
            at = self.src[edge]
            count[live] += 1
            go = np.flatnonzero(at > low)
            live, at, low, seed = live[go], at[go], low[go], seed[go]
            step += 1
        ends = np.cumsum(count, dtype=np.int64)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for k, (who, piece) in enumerate(taken):
            out[ends[who] - 1 - k] = piece
        return out, count


def _unit_hashes(c: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of units that follow one another: their characters' numbers, each times
    a random odd number of its place."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 16))))
        low, high = starts[i], starts[j - 1] + size[j - 1]
        place = np.arange(high - low) - np.repeat(starts[i:j] - low, size[i:j])
        far = int(place.max()) + 1
        by_place = _PLACE if far <= len(_PLACE) else textvec.odd(np.arange(far))
        out[i:j] = np.add.reduceat(_char(c[low:high]) * by_place[place], starts[i:j] - low)
        i = j
    return textvec.mix(out) | np.uint64(1)


def encode(lattice: Lattice, texts: list, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(ids, begin) of all texts one after another; keys: 64 bits for each row."""
    model = lattice.model
    padded = [" " + t if t else "" for t in texts]
    c = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in padded])]).astype(np.int64)
    starts = units(c, bounds)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    size = np.diff(np.append(starts, len(c)))
    which = lattice.find(c, starts, size)
    first = np.searchsorted(starts, bounds)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    place = (np.arange(len(starts)) - first[:-1][text]).astype(np.uint64)
    seeds = textvec.mix(textvec.mix(keys + np.uint64(seed))[text] ^ (place * np.uint64(0xD6E8FEB86659FD93)))
    pieces, count = lattice.sample(which, seeds)
    odd = np.flatnonzero(pieces < 0)
    if len(odd):  # characters without a piece become their bytes
        points = -1 - pieces[odd].astype(np.int64)
        values, back = np.unique(points, return_inverse=True)
        spelled = [model.byte[list(chr(p).encode())] for p in values.tolist()]
        width = np.ones(len(pieces), np.int64)
        width[odd] = np.array([len(s) for s in spelled])[back]
        out = np.repeat(pieces, width)
        at = np.cumsum(width) - width
        out[textvec.ragged(at[odd], width[odd])] = np.concatenate([spelled[b] for b in back.tolist()])
        count = np.add.reduceat(width, np.cumsum(count, dtype=np.int64) - count)
        pieces = out
    begin = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[first]
    return pieces, begin


def decode(model: Model, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """The texts, in UTF-8."""
    data = model.flat[textvec.ragged(model.flat_at[ids], model.flat_len[ids])].tobytes() if len(ids) else b""
    at = np.concatenate([[0], np.cumsum(model.flat_len[ids])])[begin].tolist()
    return [data[a + 1 : b] for a, b in zip(at[:-1], at[1:], strict=True)]  # without the leading space


def _keys(column) -> np.ndarray:
    valid = ~np.asarray(column.is_null())
    k = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return textvec.mix(k * np.uint64(2) + valid.astype(np.uint64))


def _encode(path, smoothing, seed, digest):
    def run(batches):
        model = Model(path, smoothing)
        lattice = Lattice(model)
        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), PART):
                part = batch.slice(low, high - low)
                texts = part.column("text").to_pylist()
                ids, begin = encode(lattice, [t or "" for t in texts], _keys(part.column("key")), seed)
                if not digest:
                    null = pa.array(np.asarray(part.column("text").is_null()))
                    lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids), mask=null)
                    yield pa.RecordBatch.from_arrays([part.column("key"), lists], ["key", "ids"])
                    continue
                back = decode(model, ids, begin)
                rows = [(int(b - a), zlib.crc32(ids[a:b].astype("<u4")), (t or "").encode() == d) for a, b, t, d in zip(begin[:-1], begin[1:], texts, back, strict=True)]
                cols = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()), strict=True))], ["key", "n_pieces", "ids_crc32", "lossless"])

    return run


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """(key, ids) of each row."""
    return _plain(docs, key, text).mapInArrow(_encode(path or default_path(), smoothing, seed, False), "key long, ids array<int>").withColumnRenamed("key", key)


def decoded(ids: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) of rows with ids."""
    path = path or default_path()

    def run(batches):
        model = Model(path)
        for batch in batches:
            lists = batch.column("ids")
            begin = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists.to_pylist()])]).astype(np.int64)
            texts = decode(model, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), begin)
            null = np.asarray(lists.is_null())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([None if x else t.decode() for t, x in zip(texts, null, strict=True)], pa.string())], ["key", "text"])

    return ids.select(F.col(key).alias("key"), "ids").mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, smoothing: float = SMOOTHING, seed: int = SEED) -> DataFrame:
    """(key, n_pieces, ids_crc32, lossless): digests of the sampled ids, and whether
    they decode to the text."""
    return _plain(docs, key, text).mapInArrow(_encode(path or default_path(), smoothing, seed, True), "key long, n_pieces long, ids_crc32 long, lossless boolean").withColumnRenamed("key", key)


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
