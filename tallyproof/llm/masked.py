"""Operator 3: document scores by masked pseudo-likelihood.

A network predicts each word from the SIDE words before and after it: their vectors
(one table for each offset) are summed and bent by tanh, and a softmax in two steps
gives the word's class and then the word in its class, so that probabilities sum to
one. A document's score is the sum of the log probabilities of all its words.

The vocabulary is counted over all documents: the most frequent words have a symbol
each, all others share OTHERS symbols by hash. A word that shares a symbol has that
symbol's probability times its own share of the symbol's count (plus one, which is
left to words that were never counted). The counts of all words stay a table of Spark,
in as many buckets as there are shuffle partitions: a scoring task sends the hashes of
such words to their buckets, packed by units of documents, and gets back one sum for
each document and bucket. Training is in numpy: documents are dealt to groups of about
GROUP words by a hash of id and text and sorted in them, each group starts from the
same parameters and goes through all its documents with every word as a target, and the
parameters of all groups are averaged by Spark, weighted by their words, FAN groups at
a time. The table of counts grows with the corpus; the averaged parameters have a fixed
size (about 1.4 MB).

The result depends on the documents alone, not on how the input is split or on lost
tasks: groups, their order and the order of the averages are fixed.

Edge cases. Words never counted (in texts other than those of fit) share what a symbol
leaves to them. A null or empty text has no words: its sum is 0 and its mean null. A null
doc_id is kept. Repeated rows get equal scores; with copies of one id and text in one
group they are trained on as often as they are there. A very long text is held in one
task's memory. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, textvec

SIDE, DIM, CLASSES, OTHERS, ROUNDS, BATCH, RATE = 2, 16, 64, 256, 1, 16384, 0.08
PART = 1 << 20
#: Up to this, float32 holds sums of exponentials without taking off the largest first.
SAFE = 60.0
#: Words that one copy of the parameters is trained on, and copies averaged at a time.
GROUP, FAN = 1 << 22, 64
#: Bytes of text (and 64 for each document) whose rare words are sent together.
UNIT = 1 << 25


def _hashes(part):
    data, offsets = textvec.buffers(part.column("text"))
    starts, _, first = textvec.word_bounds(data, offsets)
    return textvec.word_hashes(data, starts, lower=True), first


def _count(buckets: int):
    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held = []

        def fold():
            nonlocal keys, counts, held
            k, c = np.concatenate([keys, *(x[0] for x in held)]), np.concatenate([counts, *(x[1] for x in held)])
            keys, back = np.unique(k, return_inverse=True)
            counts, held = np.bincount(back, weights=c, minlength=len(keys)).astype(np.int64), []

        def packed():
            bucket = keys % np.uint64(buckets)
            for b in np.unique(bucket):
                m = bucket == b
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([keys[m].tobytes()], pa.binary()), pa.array([counts[m].tobytes()], pa.binary())], ["bucket", "keys", "counts"])

        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), 1 << 22):
                held.append(np.unique(_hashes(batch.slice(low, high - low))[0], return_counts=True))
                if sum(len(x[0]) for x in held) > 1_000_000:
                    fold()
                if len(keys) > 2_000_000:  # bounds a task's memory
                    yield from packed()
                    keys, counts = keys[:0], counts[:0]
        fold()
        yield from packed()

    return run


def _read(table, name, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])


def _merged(table):
    """One row with all keys of a bucket, in order, and their counts."""
    keys, back = np.unique(_read(table, "keys", np.uint64), return_inverse=True)
    counts = np.bincount(back, weights=_read(table, "counts", np.int64), minlength=len(keys)).astype(np.int64)
    return pa.Table.from_arrays([table.column("bucket").slice(0, 1), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["bucket", "keys", "counts"])


def tally(texts: DataFrame) -> DataFrame:
    """(bucket, keys, counts) of all words: a stored row for each bucket."""
    schema = "bucket int, keys binary, counts binary"
    found = texts.mapInArrow(_count(common.shuffle_partitions(texts.sparkSession)), schema)
    return common.stored(found.groupBy("bucket").applyInArrow(_merged, schema), "words")


def _most(top: int):
    """One row with the top keys of all rows, and what the others come to for each of
    the OTHERS symbols."""

    def run(table):
        keys, counts = _read(table, "keys", np.uint64), _read(table, "counts", np.int64)
        best = np.lexsort((keys, -counts))
        rest = np.bincount((keys[best[top:]] % np.uint64(OTHERS)).astype(np.int64), weights=counts[best[top:]], minlength=OTHERS).astype(np.int64)
        if "rest" in table.column_names:
            rest += _read(table, "rest", np.int64).reshape(-1, OTHERS).sum(0)
        row = (keys[best[:top]], counts[best[:top]], rest)
        return pa.Table.from_arrays([table.column("bucket").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in row)], ["bucket", "keys", "counts", "rest"])

    return run


def _cut(top: int):
    """Each bucket's row with its top keys."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _most(top)(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()

    return run


def _ranked(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    own = size - OTHERS
    schema = "bucket int, keys binary, counts binary, rest binary"
    group = max(1, round(common.shuffle_partitions(words.sparkSession) ** 0.5))
    few = words.mapInArrow(_cut(own), schema).withColumn("bucket", F.pmod("bucket", F.lit(group)).cast("int")).groupBy("bucket").applyInArrow(_most(own), schema)
    table = few.toArrow()
    counts = np.zeros(size, np.int64)
    if not table.num_rows:
        return np.zeros(0, np.uint64), counts
    last = _most(own)(table).to_pylist()[0]
    keys, n = np.frombuffer(last["keys"], np.uint64), np.frombuffer(last["counts"], np.int64)
    counts[: len(n)], counts[own:] = n, np.frombuffer(last["rest"], np.int64)
    return keys, counts


def vocabulary(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the most frequent words by rank, counts of all symbols). Buckets are
    cut to their top and merged, about the square root of their number together, so
    that as many rows of size keys come to the driver."""
    return _ranked(tally(texts), size)


class Network:
    def __init__(self, keys: np.ndarray, flat: np.ndarray, size: int, classes: int, dim: int, side: int):
        self.order = np.argsort(keys)
        self.keys, self.size, self.classes, self.dim, self.side, self.each = keys[self.order], size, classes, dim, side, size // classes
        self.offsets = [k for k in range(-side, side + 1) if k]
        self.load(flat)

    @staticmethod
    def shapes(size, classes, dim, side):
        each = size // classes
        return [("tables", (2 * side, size + 1, dim)), ("bend", (dim,)), ("top", (dim, classes)), ("top_bias", (classes,)), ("low", (classes, dim, each)), ("low_bias", (classes, each))]

    @classmethod
    def start(cls, counts: np.ndarray, classes: int, dim: int, side: int) -> np.ndarray:
        """First parameters: small vectors, and biases that give word frequencies."""
        size, rng = len(counts), np.random.default_rng(3)
        p = (counts + 0.5).reshape(classes, -1)
        parts = {"tables": rng.normal(0, 0.1, (2 * side, size + 1, dim)), "bend": np.zeros(dim), "top": rng.normal(0, 0.1, (dim, classes)), "top_bias": np.log(p.sum(1) / p.sum()), "low": rng.normal(0, 0.1, (classes, dim, size // classes)), "low_bias": np.log(p / p.sum(1, keepdims=True))}
        return np.concatenate([parts[k].ravel() for k, _ in cls.shapes(size, classes, dim, side)]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        self.flat, at, self.parts = flat.astype(np.float32).copy(), 0, {}
        self.seen = np.full_like(self.flat, 1e-3)
        self.part_seen = {}
        for k, shape in self.shapes(self.size, self.classes, self.dim, self.side):
            n = int(np.prod(shape))
            self.parts[k], self.part_seen[k] = self.flat[at : at + n].reshape(shape), self.seen[at : at + n].reshape(shape)
            at += n

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        out = self.size - OTHERS + (hashes % np.uint64(OTHERS)).astype(np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out = np.where(self.keys[at] == hashes, self.order[at], out)
        return out

    def contexts(self, symbols: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The neighbours of words at; beyond a text's ends a symbol of its own."""
        text = np.searchsorted(first, at, "right") - 1
        out = np.full((len(self.offsets), len(at)), self.size)
        for row, k in zip(out, self.offsets, strict=True):
            ok = (at + k >= first[text]) & (at + k < first[text + 1])
            row[ok] = symbols[at[ok] + k]
        return out

    def bound(self, name: str) -> float:
        """The largest value that a row can have before its softmax, as |h| <= 1."""
        return float((np.abs(self.parts[name]).sum(-2) + np.abs(self.parts[f"{name}_bias"])).max())

    def forward(self, context: np.ndarray, target: np.ndarray):
        """(log probabilities, what learn needs, in the order of the targets' classes)."""
        p, n = self.parts, len(target)
        group = target // self.each
        order = np.argsort(group.astype(np.uint16), kind="stable")
        context, group, inside = context[:, order], group[order], target[order] % self.each
        h = p["bend"] + p["tables"][0][context[0]]
        for k in range(1, len(context)):
            h += p["tables"][k][context[k]]
        np.tanh(h, out=h)
        top = h @ p["top"]
        top += p["top_bias"]
        if self.bound("top") > SAFE:
            top -= top.max(1, keepdims=True)
        rows = np.arange(n)
        log = top[rows, group]
        np.exp(top, out=top)
        total = top.sum(1)
        low = np.empty((n, self.each), np.float32)
        cut = np.searchsorted(group, np.arange(self.classes + 1)).tolist()
        spans = [(g, a, b) for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < b]
        for g, a, b in spans:
            np.matmul(h[a:b], p["low"][g], out=low[a:b])
            low[a:b] += p["low_bias"][g]
        if self.bound("low") > SAFE:
            low -= low.max(1, keepdims=True)
        log += low[rows, inside]
        np.exp(low, out=low)
        share = low.sum(1)
        log -= np.log(total)
        log -= np.log(share)
        out = np.empty(n, log.dtype)
        out[order] = log
        return out, (context, group, inside, h, top, total, low, share, spans)

    def _step(self, name, at, grad, rate):
        seen = self.part_seen[name]
        seen[at] += grad * grad
        self.parts[name][at] -= rate * grad / np.sqrt(seen[at])

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of Adagrad on the mean loss."""
        n = len(target)
        _, (context, group, inside, h, top, total, low, share, spans) = self.forward(context, target)
        rows = np.arange(n)
        top /= total[:, None]
        top[rows, group] -= 1
        low /= share[:, None]
        low[rows, inside] -= 1
        dh = top @ self.parts["top"].T
        grads = np.empty((len(spans), self.dim, self.each), np.float32)
        sums = np.empty((len(spans), self.each), np.float32)
        for x, (g, a, b) in enumerate(spans):
            dh[a:b] += low[a:b] @ self.parts["low"][g].T
            np.matmul(h[a:b].T, low[a:b], out=grads[x])
            np.sum(low[a:b], axis=0, out=sums[x])
        some = [g for g, _, _ in spans]
        self._step("low", some, grads / n, rate)
        self._step("low_bias", some, sums / n, rate)
        self._step("top", ..., h.T @ top / n, rate)
        self._step("top_bias", ..., top.sum(0) / n, rate)
        dh *= (1 - h * h) / n
        self._step("bend", ..., dh.sum(0), rate)
        for k, own in enumerate(context):
            order = np.argsort(own.astype(np.uint16), kind="stable")
            s = own[order]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            self._step("tables", (k, s[head]), np.add.reduceat(dh[order], head, axis=0), rate)


def _train(made, rate: float, batch_size: int, chunk: int):
    """Rows (group, text) come sorted; each group has its own copy of the parameters."""

    def run(batches):
        net, n, now = None, 0, None

        def sent():
            for i in range(0, len(net.flat), chunk):
                row = (now, i // chunk, n, net.flat[i : i + chunk].astype(np.float64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["group", "chunk", "n", "values"])

        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                if begin == end:
                    continue
                if int(group[begin]) != now:
                    if n:
                        yield from sent()
                    net, n, now = made(), 0, int(group[begin])
                rows = batch.slice(begin, end - begin)
                for low, high in textvec.slices(rows.column("text"), PART):
                    hashes, first = _hashes(rows.slice(low, high - low))
                    symbols = net.symbols(hashes)
                    at = np.random.default_rng(len(symbols)).permutation(len(symbols))
                    for i in range(0, len(at), batch_size):
                        own = at[i : i + batch_size]
                        net.learn(net.contexts(symbols, first, own), symbols[own], rate)
                    n += len(symbols)
        if n:
            yield from sent()

    return run


SENT = "group long, chunk int, n long, values binary"


def _average(table):
    """One row of the weighted mean; rows in the order of their groups."""
    table = table.sort_by("group")
    n = np.array(table.column("n").to_pylist(), np.int64)
    total = np.zeros(0)
    for w, x in zip(n / n.sum(), table.column("values").to_pylist(), strict=True):
        x = np.frombuffer(x, np.float64)
        total = w * x + (total if len(total) else 0)
    one = [table.column(c).slice(0, 1) for c in ("group", "chunk")]
    return pa.table({"group": one[0], "chunk": one[1], "n": pa.array([int(n.sum())], pa.int64()), "values": pa.array([total.tobytes()], pa.binary())})


def averaged(sent: DataFrame, groups: int) -> DataFrame:
    """The mean of all groups' rows, FAN of them at a time."""
    while True:
        groups = -(-groups // FAN)
        parent = sent.withColumn("parent", F.floor(F.col("group") / FAN).cast("long"))
        mean = parent.groupBy("parent", "chunk").applyInArrow(lambda t: _up(_average(t)), SENT)
        sent = common.stored(mean, "network")
        if groups == 1:
            return sent


def _up(table):
    return table.set_column(0, "group", pa.array([table.column("group")[0].as_py() // FAN], pa.int64()))


def _score(made, buckets: int, unit: int):
    """Rows of two kinds: a unit's documents with the sums by symbol (bucket -1), and
    the words of the unit that share a symbol: for each bucket their places in the list
    of documents and their hashes."""
    kind = np.min_scalar_type(buckets)

    def run(batches):
        net, task = made(), TaskContext.get().partitionId()
        number, size, held = 0, 0, []

        def packed():
            n, log = (np.concatenate([x[k] for x in held]) for k in (1, 2))
            base = np.cumsum([0, *(len(x[1]) for x in held)])
            at = np.concatenate([x[3] + b for x, b in zip(held, base[:-1], strict=True)]).astype(np.int32)
            hashes = np.concatenate([x[4] for x in held])
            docs = pa.StructArray.from_arrays([pa.concat_arrays([x[0] for x in held]), pa.array(n, pa.int64()), pa.array(log, pa.float64())], ["doc_id", "n_words", "log_likelihood"])
            bucket = (hashes % np.uint64(buckets)).astype(kind)
            order = np.argsort(bucket, kind="stable")
            at, hashes, bucket = at[order], hashes[order], bucket[order]
            heads = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
            ends = [*heads[1:], len(bucket)]
            cut = lambda x: [None, *(x[i:j].tobytes() for i, j in zip(heads, ends, strict=False))]
            many = len(heads) + 1
            lists = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(many + 1), 1) * len(n), pa.int32()), docs)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + number] * many, pa.int64()), pa.array([-1, *bucket[heads].tolist()], pa.int32()), lists, pa.array(cut(at), pa.binary()), pa.array(cut(hashes), pa.binary())],
                ["unit", "bucket", "docs", "at", "hashes"],
            )

        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), PART):
                part = batch.slice(low, high - low)
                hashes, first = _hashes(part)
                symbols = net.symbols(hashes)
                log = np.zeros(len(symbols))
                for i in range(0, len(symbols), 1 << 13):
                    at = np.arange(i, min(i + (1 << 13), len(symbols)))
                    log[at] = net.forward(net.contexts(symbols, first, at), symbols[at])[0]
                sums = np.concatenate([[0], np.cumsum(log)])
                n = np.diff(first)
                rare = np.flatnonzero(symbols >= net.size - OTHERS)
                held.append((part.column("doc_id"), n, np.where(n > 0, sums[first[1:]] - sums[first[:-1]], 0.0), np.searchsorted(first, rare, "right") - 1, hashes[rare]))
                size += part.column("text").nbytes + 64 * part.num_rows
                if size >= unit:
                    yield packed()
                    number, size, held = number + 1, 0, []
        if held:
            yield packed()

    return run


def _shares(rest: np.ndarray):
    """A bucket's words with their counts: for each unit the sums, by document, of the
    logs of what the words have of their symbols."""
    whole = np.log(rest + 1.0)

    def run(left, right):
        keys, logs = _read(right, "keys", np.uint64), np.log(_read(right, "counts", np.int64).astype(np.float64))
        docs, sums = [], []
        for at, hashes in zip(left.column("at").to_pylist(), left.column("hashes").to_pylist(), strict=True):
            at, hashes = np.frombuffer(at, np.int32), np.frombuffer(hashes, np.uint64)
            log = np.zeros(len(hashes))
            if len(keys):
                place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                log = np.where(keys[place] == hashes, logs[place], 0.0)
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            docs.append(at[heads].tobytes())
            sums.append(np.add.reduceat(log - whole[(hashes % np.uint64(OTHERS)).astype(np.int64)], heads).tobytes())
        return pa.Table.from_arrays([left.column("unit"), left.column("bucket"), pa.array(docs, pa.binary()), pa.array(sums, pa.binary())], ["unit", "bucket", "at", "sums"])

    return run


def _total(left, right):
    """The documents of a unit, with the sums of all buckets, in the buckets' order."""
    docs = left.column("docs").combine_chunks().flatten()
    right = right.sort_by("bucket")
    more = np.bincount(_read(right, "at", np.int32), weights=_read(right, "sums", np.float64), minlength=len(docs))
    return pa.Table.from_arrays([docs.field("doc_id"), docs.field("n_words"), pa.array(docs.field("log_likelihood").to_numpy(zero_copy_only=False) + more)], ["doc_id", "n_words", "log_likelihood"])


class Model(NamedTuple):
    """made: a function that makes the trained Network; words: the counts of all words,
    in so many buckets; rest: those of the symbols that words share."""

    made: Callable
    words: DataFrame
    buckets: int
    rest: np.ndarray


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """(group, text) dealt by a hash of id and text, and sorted, whatever the input's
    splits are."""
    text, h = F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.pmod(h, F.lit(groups)).alias("group"), h.alias("key"), text.alias("text")).where("text is not null")
    dealt = rows.repartition(common.shuffle_partitions(docs.sparkSession), "group")
    return dealt.sortWithinPartitions("group", "key", "text").select("group", "text")


def fit(docs: DataFrame, side: int = SIDE, dim: int = DIM, classes: int = CLASSES, size: int | None = None, rounds: int = ROUNDS, rate: float = RATE, batch_size: int = BATCH, group: int = GROUP) -> Model:
    """The trained network and the counts of all words."""
    size = size or classes * classes
    texts = docs.select(F.col("text").cast("string").alias("text"))
    buckets, words = common.shuffle_partitions(docs.sparkSession), tally(texts)
    keys, counts = _ranked(words, size)
    groups = max(1, -(-int(counts.sum()) // group))
    flat = Network.start(counts, classes, dim, side)
    for turn in range(rounds):
        made = lambda flat=flat: Network(keys, flat, size, classes, dim, side)
        sent = common.stored(grouped(docs, groups).mapInArrow(_train(made, rate / (turn + 1), batch_size, 1 << 15), SENT), "trained")
        rows = averaged(sent, groups).orderBy("chunk").collect()  # one set of parameters
        flat = np.concatenate([np.frombuffer(r["values"], np.float64) for r in rows]).astype(np.float32) if rows else flat
    return Model(lambda: Network(keys, flat, size, classes, dim, side), words, buckets, counts[size - OTHERS :])


def score(docs: DataFrame, model: Model, unit: int = UNIT) -> DataFrame:
    """(doc_id, n_words, log_likelihood, mean_log_likelihood) of each row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sums = "doc_id long, n_words long, log_likelihood double"
    rows = common.stored(plain.mapInArrow(_score(model.made, model.buckets, unit), f"unit long, bucket int, docs array<struct<{sums.replace(' ', ':').replace(',:', ',')}>>, at binary, hashes binary"), "scored")
    rare = rows.where("bucket >= 0").select("unit", "bucket", "at", "hashes").groupBy("bucket")
    shares = rare.cogroup(model.words.groupBy("bucket")).applyInArrow(_shares(model.rest), "unit long, bucket int, at binary, sums binary")
    out = rows.where("bucket < 0").select("unit", "docs").groupBy("unit").cogroup(shares.groupBy("unit")).applyInArrow(_total, sums)
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def op3_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs))
