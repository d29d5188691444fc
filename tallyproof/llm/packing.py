"""Operator 10: bulk-synchronous best-fit packing of tokenized documents.

Each document is its token ids and a closing id 0; one longer than a sequence is
cut into full pieces, the first of which may be shorter. A piece of more than half a
sequence opens one. The others are placed in bands of size, from the longest band on.
A superstep range-sorts a band's pieces and the gaps they may fill together, from the
largest on; each range is swept by one task, which gives each piece the smallest gap
there that it fits (its successor) and puts back what is left of the gap. Pieces
without a gap in their own range look for one in the nearest range of larger gaps:
ranges report how many pieces and places are left, and the k-th piece of a range gets
the k-th place, so that ranks settle conflicts. A gap has as many places as pieces of
the band's largest size fit it. Gaps are updated, and supersteps repeat until no piece
finds a gap; the band's other pieces then open sequences, range by range, best fit
again. A sequence is named after the piece that opens it, and its pieces lie one after
another, so a gap is all that a sweep needs to know of it.

Only counts by range come to the driver. A size that many pieces share is dealt to
several ranges. With one range this is exactly best-fit decreasing within each band.

Edge cases. A null or empty text is the one id 0. Null and repeated doc_ids are
packed row by row. Pieces of equal size are placed in the order of their rows. A very
long text is encoded in one task's memory and cut there. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import bytebpe, common, textvec

#: RANGE: rows that a sweep deals to one range.
LENGTH, RANGE = 2048, 10_000
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED, PIECE, PLACE, GAP = range(4)
SWEPT = "kind int, part int, rank long, id long, size int, sequence long, offset int"


def _cut(path: str, length: int, with_ids: bool):
    def run(batches):
        encoder, row = bytebpe.Encoder(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), 1 << 21):
                part = batch.slice(low, high - low)
                ids, begin = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                rows = [[], [], [], [], [], []]
                for doc, a, b in zip(part.column("doc_id").to_pylist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], 0).astype("<u4")
                    at = 0
                    for k, end in enumerate(range((len(own) - 1) % length + 1, len(own) + 1, length)):
                        piece = own[at:end]
                        for r, x in zip(rows, (doc, k, at, len(piece), zlib.crc32(piece), piece if with_ids else None), strict=True):
                            r.append(x)
                        at = end
                arrays = [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                arrays = [pa.array(row + np.arange(len(rows[0]))), *arrays]
                row += len(rows[0])
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int32) for x in rows[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of each document, with their ids if asked for; row: a number of its
    own, from its input split and its place there."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_cut(path or bytebpe.default_path(), length, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def bands(length: int) -> list[tuple[int, int]]:
    """(low, high): sizes above low up to high, from half a sequence on, by halves."""
    ends = [length // 2]
    while ends[-1]:
        ends.append(ends[-1] // 2)
    return list(zip(ends[1:], ends[:-1], strict=True))


class _Gaps:
    """Sequences by their gap."""

    def __init__(self):
        self.of, self.have = defaultdict(list), []

    def add(self, gap: int, sequence: int) -> None:
        held = self.of[gap]
        if not held:
            insort(self.have, gap)
        held.append(sequence)

    def successor(self, size: int):
        """(gap, sequence) of the smallest gap of that size or more, taken out."""
        at = bisect_left(self.have, size)
        if at == len(self.have):
            return None
        gap = self.have[at]
        sequence = self.of[gap].pop()
        if not self.of[gap]:
            del self.have[at]
        return gap, sequence


def _sweep(length: int, high: int, opening: bool):
    """Rows (is_piece, id, size) of one range come sorted, the largest first."""

    def run(batches):
        part, gaps, placed, left, least = TaskContext.get().partitionId(), _Gaps(), [], [], length
        for batch in batches:
            for is_piece, own, size in zip(*(batch.column(c).to_pylist() for c in ("is_piece", "id", "size")), strict=True):
                least = size
                if not is_piece:
                    gaps.add(size, own)
                    continue
                found = gaps.successor(size) or ((length, own) if opening else None)
                if not found:
                    left.append((PIECE, part, len(left), own, size, None, None))
                    continue
                gap, sequence = found
                placed.append((PLACED, part, None, own, size, sequence, length - gap))
                if gap > size:
                    gaps.add(gap - size, sequence)
        places = 0
        for gap in gaps.have:
            for sequence in gaps.of[gap]:
                # a gap below the range isn't known to fit what later ranges hold
                left.append((PLACE if gap >= least else GAP, part, places, sequence, gap, None, None))
                places += max(1, gap // high) if gap >= least else 0
        columns = list(zip(*placed, *left, strict=True)) or [[]] * 7
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["kind", "part", "rank", "id", "size", "sequence", "offset"])

    return run


def matches(counts: dict) -> list[tuple]:
    """counts: {part: (pieces, places) left}. (part, rank, other part, place, many): so
    many pieces of a part from that rank on get the places of an earlier one from that
    place on, the nearest first."""
    out, stack = [], []
    for part in sorted(counts):
        left, places = counts[part]
        rank = 0
        while rank < left and stack:
            other, place, many = stack.pop()
            n = min(many, left - rank)
            out.append((part, rank, other, place, n))
            rank += n
            if many > n:
                stack.append((other, place + n, many - n))
        if places:
            stack.append((part, 0, places))
    return out


def _assign(found: list[tuple]):
    """The place of each piece that gets one."""
    part, rank, other, place, many = (np.array(c, np.int64) for c in zip(*found, strict=True))
    key = part << 40 | rank

    def run(batches):
        for batch in batches:
            own = batch.column("part").to_numpy().astype(np.int64) << 40 | batch.column("rank").to_numpy()
            at = np.maximum(np.searchsorted(key, own, "right") - 1, 0)
            inside = own - key[at]
            ok = (inside >= 0) & (inside < many[at])
            at, keep = at[ok], pa.array(ok)
            yield pa.RecordBatch.from_arrays([pa.array(other[at].astype(np.int32)), pa.array(place[at] + inside[ok]), batch.column("id").filter(keep), batch.column("size").filter(keep)], ["part", "place", "id", "size"])

    return run


def _places(found: list[tuple], high: int):
    """A row for each place of a gap that a piece gets."""
    used: dict = defaultdict(int)
    for _, _, other, place, many in found:
        used[other] = max(used[other], place + many)
    bound = np.zeros(max(used) + 1, np.int64)
    bound[list(used)] = list(used.values())

    def run(batches):
        for batch in batches:
            part, rank, gap = (batch.column(c).to_numpy() for c in ("part", "rank", "size"))
            limit = np.where(part < len(bound), bound[np.minimum(part, len(bound) - 1)], 0)
            many = np.clip(limit - rank, 0, np.maximum(1, gap // high))
            take = np.repeat(np.arange(len(part)), many)
            place = textvec.ragged(rank, many)
            yield pa.RecordBatch.from_arrays([pa.array(part[take]), pa.array(place, pa.int64()), batch.column("id").take(pa.array(take)), pa.array(gap[take])], ["part", "place", "sequence", "gap"])

    return run


def _swept(pieces: DataFrame, gaps: DataFrame | None, length: int, high: int, many: int) -> DataFrame:
    """One sweep over all ranges of about many rows together; without gaps, pieces open
    sequences."""
    rows = pieces.select(F.lit(True).alias("is_piece"), "id", "size")
    if gaps is not None:
        rows = rows.unionByName(gaps.select(F.lit(False).alias("is_piece"), F.col("sequence").alias("id"), F.col("gap").alias("size")))
    order = [F.desc("size"), F.col("is_piece"), F.xxhash64("id")]
    dealt = rows.repartitionByRange(-(-many // RANGE), *order).sortWithinPartitions(*order)
    return common.stored(dealt.mapInArrow(_sweep(length, high, gaps is None), SWEPT), "swept")


def places(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, sequence, offset) of pieces (id, size), a stored table."""
    long = pieces.where(F.col("size") > length // 2)
    placed = [long.select("id", F.col("id").alias("sequence"), F.lit(0).alias("offset"))]
    gaps = long.where(F.col("size") < length).select(F.col("id").alias("sequence"), (length - F.col("size")).alias("gap"))
    cuts = bands(length)
    of = F.coalesce(*(F.when(F.col("size") > low, i) for i, (low, _) in enumerate(cuts)))
    some = {r["band"]: r["count"] for r in pieces.select(F.when(F.col("size") <= length // 2, of).alias("band")).groupBy("band").count().collect()}
    n_gaps = some.pop(None, 0)
    for i, (low, high) in enumerate(cuts):
        n = some.get(i, 0)
        if not n:
            continue
        left, idle = pieces.where(f"size > {low} and size <= {high}"), gaps.where(F.col("gap") <= low)
        gaps = gaps.where(F.col("gap") > low)
        while n:
            swept = _swept(left, gaps, length, high, n + n_gaps)
            kinds = lambda *k, swept=swept: swept.where(F.col("kind").isin(*k))
            placed.append(kinds(PLACED).select("id", "sequence", "offset"))
            counts: dict = defaultdict(lambda: [0, 0])
            room = F.when(F.col("kind") == PIECE, 1).otherwise(F.greatest(F.lit(1), F.floor(F.col("size") / high)))
            for r in kinds(PIECE, PLACE).groupBy("part", "kind").agg(F.sum(room).alias("n")).collect():
                counts[r["part"]][r["kind"] != PIECE] = r["n"]
            left, n = kinds(PIECE).select("id", "size"), sum(c for c, _ in counts.values())
            gaps = kinds(PLACE, GAP).select(F.col("id").alias("sequence"), F.col("size").alias("gap"))
            found = matches(counts)
            if not found:
                break
            got = kinds(PIECE).mapInArrow(_assign(found), "part int, place long, id long, size int")
            places = kinds(PLACE).mapInArrow(_places(found, high), "part int, place long, sequence long, gap int")
            before = F.sum("size").over(Window.partitionBy("sequence").orderBy("place")) - F.col("size")
            met = got.join(places, ["part", "place"]).withColumn("offset", (length - F.col("gap") + before).cast("int"))
            met = common.stored(met.select("id", "size", "sequence", "offset", "gap"), "met")
            placed.append(met.select("id", "sequence", "offset"))
            left, n = left.join(met, "id", "left_anti"), n - sum(x[-1] for x in found)
            filled = met.groupBy("sequence").agg((F.min("gap") - F.sum("size")).cast("int").alias("gap"))
            gaps = gaps.join(met, "sequence", "left_anti").unionByName(filled).where("gap > 0")
        if n:
            opened = _swept(left, None, length, high, n)
            placed.append(opened.where(F.col("kind") == PLACED).select("id", "sequence", "offset"))
            gaps = gaps.unionByName(opened.where(F.col("kind").isin(PLACE, GAP)).select(F.col("id").alias("sequence"), F.col("size").alias("gap")))
            n_gaps += n
        gaps = common.stored(gaps.unionByName(idle), "gaps")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    return every


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """cut (with row, a number of its own, and length; other columns stay) with
    sequence_id and offset. cut must be a stored table."""
    found = places(cut.select(F.col("row").alias("id"), F.col("length").cast("int").alias("size")), length)
    at = found.select(F.col("id").alias("row"), F.col("sequence").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return cut.join(at, "row").drop("row")


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    return pack(common.stored(pieces(docs, path, length), "pieces"), length)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"))
