"""Vector retrieval, score analysis, evidence selection and typed facts.

Every query meets every document in cells: a block of the queries and a part of the
documents. A task holds a cell's queries and reads its documents batch by batch, so
that neither side has to fit into memory; numpy takes a batch's cosines at once.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of the query vectors of a cell; bytes of its documents at least, if there are fewer
#: parts than shuffle partitions, and at most.
BLOCK_BYTES, LEAST_BYTES, PART_BYTES = 32 << 20, 1 << 20, 32 << 20
#: Pairs whose scores are taken at once: by matrix products, one by one.
PRODUCTS, PAIRS = 1 << 21, 1 << 15
#: How far a matrix product may be from the same sum taken in order.
CLOSE = 1e-9


class _Vectors:
    """Rows of a batch whose vectors have one size (-1: null), their matrix, norms, and
    whether they are without null components."""

    def __init__(self, size: int, rows: np.ndarray, x: np.ndarray, whole: np.ndarray, norm: np.ndarray | None = None):
        self.size, self.rows, self.x, self.whole = size, rows, x, whole
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_dot(x, x)) if norm is None else norm

    def part(self, at) -> _Vectors:
        return _Vectors(self.size, self.rows[at], self.x[at], self.whole[at], self.norm[at])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products over the last axis, from first to last, as the SQL twins add."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def _sized(column) -> list[_Vectors]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1)).astype(np.int64)
    flat = column.flatten()  # null vectors have nothing in it
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.maximum(sizes, 0)
    starts = np.cumsum(length) - length
    whole = np.ones(len(sizes), bool)
    if flat.null_count:
        whole[np.repeat(np.arange(len(sizes)), length)[np.asarray(flat.is_null())]] = False
    out = []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        out.append(_Vectors(size, rows, values[starts[rows][:, None] + np.arange(max(size, 0))], whole[rows]))
    return out


def _told(dot: np.ndarray, norm: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(norm == 0, 0.0, dot / norm)


def _alone(q: _Vectors, d: _Vectors) -> bool:
    """Whether the scores don't depend on components: null beside a null vector, else 0."""
    return min(q.size, d.size) < 0 or q.size != d.size


def _chunks(q: _Vectors, width: int, pairs: int):
    step = max(1, pairs // max(1, width))
    for low in range(0, len(q.rows), step):
        yield q.part(slice(low, low + step))


class _All:
    """The score of every pair, null where a vector or a component is. With digits it is
    rounded half away from 0; a product that is close to such a half is summed in order."""

    def __init__(self, queries: pa.Table, keep: list[str], digits: int | None = None):
        self.queries, self.keep, self.digits, self.sized = queries, keep, digits, _sized(queries.column("vec"))

    def _scores(self, q: _Vectors, d: _Vectors) -> np.ndarray:
        with np.errstate(all="ignore"):
            norm = q.norm[:, None] * d.norm
            if self.digits is None:
                return _told(_dot(q.x[:, None, :], d.x[None, :, :]), norm)
            unit = 10.0**self.digits
            score = _told(q.x @ d.x.T, norm)
            size = np.abs(score) * unit
            i, j = np.nonzero(np.abs(size - np.floor(size) - 0.5) < CLOSE * unit)
            for low in range(0, len(i), PAIRS):
                a, b = i[low : low + PAIRS], j[low : low + PAIRS]
                score[a, b] = _told(_dot(q.x[a], d.x[b]), norm[a, b])
            return np.sign(score) * np.floor(np.abs(score) * unit + 0.5) / unit + 0.0  # no -0

    def met(self, docs: pa.RecordBatch):
        for d, q in itertools.product(_sized(docs.column("vec")), self.sized):
            for low in range(0, len(d.rows), 1024):
                x = d.part(slice(low, low + 1024))
                for part in _chunks(q, len(x.rows), 8 * PAIRS):
                    if _alone(part, x):
                        score, null = np.zeros((len(part.rows), len(x.rows))), min(part.size, x.size) < 0
                    else:
                        score, null = self._scores(part, x), ~(part.whole[:, None] & x.whole)
                    i, j = np.repeat(part.rows, len(x.rows)), np.tile(x.rows, len(part.rows))
                    yield _found(self.queries, docs, self.keep, i, j, pa.array(score.ravel(), mask=np.broadcast_to(null, score.shape).ravel()))

    def end(self):
        return ()


def _found(queries, docs, keep: list[str], i: np.ndarray, j: np.ndarray, score: pa.Array) -> pa.RecordBatch:
    cells = [queries.column("id").take(pa.array(i)), docs.column("id").take(pa.array(j)), *(t.column(c).take(pa.array(at)) for t, at in ((queries, i), (docs, j)) for c in keep), score]
    cells = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells]
    return pa.RecordBatch.from_arrays(cells, _names(keep))


def _names(keep: list[str]) -> list[str]:
    return ["query_id", "doc_id", *(f"{s}_{c}" for s in "qd" for c in keep), "score"]


def _needed(d: _Vectors, ids: np.ndarray, k: int) -> np.ndarray:
    """Which of the documents can be among a query's best k: of equal vectors those of the
    k + 1 smallest ids, as one may be the query's own, and k of each id."""
    same = d.whole.astype(np.int64)
    if d.size > 0:
        rows = np.ascontiguousarray(np.where(d.whole[:, None], d.x, np.nan))
        same += 2 * np.unique(rows.view(np.dtype((np.void, 8 * d.size))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    same, ids, at = same[order], ids[order], np.arange(len(order))
    vector = np.concatenate([[True], same[1:] != same[:-1]])
    each = vector | np.concatenate([[True], ids[1:] != ids[:-1]])
    nth = np.cumsum(each)
    nth -= nth[np.maximum.accumulate(np.where(vector, at, 0))]
    copy = at - np.maximum.accumulate(np.where(each, at, 0))
    return np.sort(order[(nth <= k) & (copy < k)])


class _Best:
    """The best k documents of each query, ties by document; NaN is above all scores, as
    in Spark's order, and null below."""

    def __init__(self, queries: pa.Table, keep: list[str], k: int):
        self.queries, self.keep, self.k, self.sized = queries, keep, k, _sized(queries.column("vec"))
        self.ids = queries.column("id").to_numpy()
        self.least = np.full(len(self.ids), -np.inf)  # what a query's k-th hit has by now
        self.i, self.key, self.j = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.docs = None

    def met(self, docs: pa.RecordBatch):
        ids = docs.column("id").to_numpy(zero_copy_only=False)
        for d in _sized(docs.column("vec")):
            d = d.part(_needed(d, ids[d.rows], self.k))
            hits = [self._near(part, d, ids[d.rows]) for q in self.sized for part in _chunks(q, len(d.rows), PRODUCTS)]
            self._merge(docs, d, *(np.concatenate(x) for x in zip(*hits, strict=True)))
        return ()

    def _near(self, q: _Vectors, d: _Vectors, ids: np.ndarray):
        """(queries, keys, documents) of the pairs that are as near as the k-th one."""
        if _alone(q, d):
            near = np.full((len(q.rows), len(d.rows)), -np.inf if min(q.size, d.size) < 0 else 0.0)
        else:
            with np.errstate(all="ignore"):
                near = _told(q.x @ d.x.T, q.norm[:, None] * d.norm)
            near = self._key(near, q.whole[:, None] & d.whole)
        near[self.ids[q.rows][:, None] == ids] = np.nan
        least = self.least[q.rows]
        if len(d.rows) > self.k and np.isneginf(least).any():
            own = np.partition(np.where(np.isnan(near), -np.inf, near), -self.k, axis=1)[:, -self.k]
            least = np.maximum(least, own)
        i, j = np.nonzero(near >= least[:, None] - CLOSE)
        key = near[i, j]
        if not _alone(q, d):
            for low in range(0, len(i), PAIRS):
                a, b = i[low : low + PAIRS], j[low : low + PAIRS]
                with np.errstate(all="ignore"):
                    key[low : low + PAIRS] = self._key(_told(_dot(q.x[a], d.x[b]), q.norm[a] * d.norm[b]), q.whole[a] & d.whole[b])
        return q.rows[i], key, j

    @staticmethod
    def _key(score: np.ndarray, whole: np.ndarray) -> np.ndarray:
        score[np.isnan(score)] = np.inf
        score[~whole] = -np.inf
        return score

    def _merge(self, docs: pa.RecordBatch, d: _Vectors, i: np.ndarray, key: np.ndarray, j: np.ndarray):
        if not len(i):
            return
        own, j = np.unique(j, return_inverse=True)
        kept = pa.Table.from_batches([docs.select(["id", *self.keep]).take(pa.array(d.rows[own]))])
        n = self.docs.num_rows if self.docs else 0
        self.docs = pa.concat_tables([self.docs, kept]) if n else kept
        i, key, j = np.concatenate([self.i, i]), np.concatenate([self.key, key]), np.concatenate([self.j, n + j])
        order = np.lexsort((self.docs.column("id").to_numpy()[j], -key, i))
        i, key, j = i[order], key[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.k - 1
        self.least[i[last]] = key[last]
        self.i, self.key, self.j = (x[place < self.k] for x in (i, key, j))
        rows, self.j = np.unique(self.j, return_inverse=True)
        self.docs = self.docs.take(pa.array(rows)).combine_chunks()

    def end(self):
        if len(self.i):
            score = np.where(np.isposinf(self.key), np.nan, self.key)
            yield _found(self.queries, self.docs, self.keep, self.i, self.j, pa.array(score, mask=np.isneginf(self.key)))


def _cells(start):
    """Rows come sorted by cell, its queries (side 0) first; start(queries) makes what its
    documents are given to."""

    def run(batches):
        cell, held, now = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, sides = (np.asarray(batch.column(c)) for c in ("cell", "side"))
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), batch.num_rows]
            for low, high in itertools.pairwise(cuts):
                if cells[low] != cell:
                    if now:
                        yield from now.end()
                    cell, held, now = cells[low], [], None
                part = batch.slice(low, high - low)
                if sides[low] == 0:
                    held.append(part)
                elif held or now:
                    if now is None:
                        now, held = start(pa.Table.from_batches(held).combine_chunks()), []
                    yield from now.met(part)
        if now:
            yield from now.end()

    return run


def _met(queries: DataFrame, docs: DataFrame, qid: str, did: str, vector: str, keep: list[str], start) -> DataFrame:
    """Every query beside every document, each cell in one task."""
    spark = queries.sparkSession
    size = lambda d: d.agg(F.coalesce(F.sum(8 * F.greatest(F.size(vector), F.lit(0)) + 64), F.lit(0)).alias("n")).first()["n"]
    blocks, most = max(1, -(-size(queries) // BLOCK_BYTES)), size(docs)
    parts = max(1, -(-most // PART_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // LEAST_BYTES)))
    kind = docs.schema[vector].dataType.simpleString()
    vec = F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vec")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    row = lambda d, i, b, p, side: d.select(b.alias("b"), F.col(i).alias("id"), vec, *keep, p.alias("p"), F.lit(side).alias("side"))
    q, d = row(queries, qid, dealt(blocks, qid), F.lit(0), 0).withColumn("p", every(parts)), row(docs, did, F.lit(0), dealt(parts, did, vector), 1).withColumn("b", every(blocks))
    rows = q.unionByName(d).withColumn("cell", F.col("b") * parts + F.col("p")).drop("b", "p")
    types = {c: docs.schema[c].dataType.simpleString() for c in keep}
    out = ", ".join([f"query_id {queries.schema[qid].dataType.simpleString()}", f"doc_id {docs.schema[did].dataType.simpleString()}", *(f"`{s}_{c}` {types[c]}" for s in "qd" for c in keep), "score double"])
    return rows.repartitionById(blocks * parts, F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(_cells(start), out)


def scores(queries: DataFrame, docs: DataFrame, qid: str, did: str, vector: str, keep: list[str] = (), digits: int | None = None) -> DataFrame:
    """Cosine of every query with every document in double precision, rounded to digits
    if given; 0 for a zero norm or sizes that differ. (query_id, doc_id, q_<keep>,
    d_<keep>, score)"""
    keep = list(keep)
    return _met(queries, docs, qid, did, vector, keep, lambda q: _All(q, keep, digits))


def nearest(queries: DataFrame, docs: DataFrame, qid: str, did: str, vector: str, k: int, keep: list[str] = ()) -> DataFrame:
    """The best k documents of each query by those scores, exactly, with their rank; a
    query's own id is left out. Each cell gives its best k only; they are ranked again."""
    keep = list(keep)
    some = lambda d, c: d.where(F.col(c).isNotNull())
    return top_k(_met(some(queries, qid), some(docs, did), qid, did, vector, keep, lambda q: _Best(q, keep, k)), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The best k documents of each query, ties by document. A first cut inside hash
    parts of a query keeps the last ranking small."""
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(F.desc("score"), "doc_id")
    best = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that applies, in order; null if none does."""
    out = F.when(rules[0][0], rules[0][1])
    for cond, name in rules[1:]:
        out = out.when(cond, name)
    return out


def superseded(facts: DataFrame, keys: list[str], single: Column, ts: str, tie: str) -> DataFrame:
    """Adds valid_to: when a later fact of the same key replaced one of a
    single-valued kind; null while it is active."""
    nxt = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts, tie))
    return facts.withColumn("valid_to", F.when(single, nxt))


def gated(asked: DataFrame, found: DataFrame, least: float = 0.60, sure: float = 0.92, gap: float = 0.05) -> DataFrame:
    """(query_id, passes): the best hit must reach least and either be alone, be sure or
    lead by gap. A query without hits passes only if it is typed. asked: query_id, typed;
    found: query_id, top1, top2."""
    alone, lead = F.col("top2").isNull(), F.col("top1") - F.col("top2") >= gap
    passes = (F.col("top1") >= least) & (alone | (F.col("top1") >= sure) | lead)
    return asked.join(found, "query_id", "left").select("query_id", F.when(F.col("top1").isNull(), F.col("typed")).otherwise(passes).alias("passes"))


def contract_hits(found: DataFrame, terms: list[str]) -> DataFrame:
    """(query_id, hit, n_hits, first_rank) of hits (query_id, rank, negative, expected_<t>
    and own_<t> of each term): a null expectation asks for nothing, and a negative query
    has no hits."""
    met = ~F.col("negative")
    for t in terms:
        met = met & (F.col(f"expected_{t}").isNull() | F.coalesce(F.col(f"expected_{t}") == F.col(f"own_{t}"), F.lit(False)))
    rows = found.withColumn("met", met)
    return rows.groupBy("query_id").agg(F.bool_or("met").alias("hit"), F.count_if("met").alias("n_hits"), F.min(F.when(F.col("met"), F.col("rank"))).alias("first_rank"))
