"""Operator 8: near-duplicate documents by MinHash bands and odd sketches.

A document's set is its distinct SHINGLE-word shingles (a shorter document's
whole word sequence is its one shingle). Rows with equal sets form a class. Classes
share a bucket when one of BANDS bands of ROWS MinHash values agrees; a pair at the
threshold 0.8 shares none with a chance of (1 - 0.8**4)**32 < 1e-7.

A second MinHash sample takes the smallest hash of each of BINS ranges of hashes
(a small set is nearly its own sample) and folds it into an odd sketch: a parity
bitmap in which each value flips one bit. The population count of the XOR of two
sketches tells how many values differ. Pairs are dropped only if it lies over six
standard deviations beyond what the threshold allows for sets of their sizes, or if
the sizes alone rule the threshold out. What is left is confirmed on the full sets of
64-bit shingle hashes.

A bucket is not expanded into pairs. First each member is compared with the
bucket's first one; confirmed links give components. Pairs inside a component need
no test. In each bucket the members outside its largest component then meet that
component and one another, in blocks of about BLOCK shingles. A block first marks the
members that have a possible partner by sketch in another component, a pair only in
the first bucket that it shares; only these members' sets are fetched, and the block
tests its pairs on them. It joins what it links as it goes and returns only links that
join two of its components: never more than it has members. So every pair that shares
a bucket and has two components is tested, no pair leaves a task untested, and a group
of near copies gives rows in proportion to its size.

Edge cases. A null or empty text has an empty set and links with nothing. A null
doc_id cannot be linked: its component is null and the row is kept. Repeated rows
get equal results. Rows of one doc_id with different texts are linked each by its own
text; a component's id is the smallest doc_id in it. A very long text is one set in
one task's memory, 8 bytes for each distinct shingle. Sets of equal size and sketch
are told apart by their shingles; ties between links don't matter to components.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, textvec

SHINGLE, PERCENT = 4, 80
#: BLOCK: shingles (and 64 for each member) on one side of a block.
BANDS, ROWS, BINS, SKETCH_BITS, BLOCK = 32, 4, 1024, 2048, 1 << 18
#: Partners of one member in a row of confirmations; pairs looked at together.
FAN, STEP = 64, 1 << 15


def _sets(text, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin."""
    data, offsets = textvec.buffers(text)
    starts, _, first = textvec.word_bounds(data, offsets)
    words = textvec.word_hashes(data, starts, lower=True)
    out, at = [], [0]
    whole = textvec.windows(words, shingle, 4)
    for i, j in zip(first[:-1], first[1:], strict=True):
        if j - i >= shingle:
            own = np.unique(whole[i : j - shingle + 1])
        elif j > i:
            own = textvec.mix(textvec.windows(words[i:j], int(j - i), 4) + np.uint64(j - i))
        else:
            own = words[:0]
        out.append(own)
        at.append(at[-1] + len(own))
    return (np.concatenate(out) if out else words[:0]), np.array(at)


def _set_key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _signatures(shingle: int, bands: int, rows: int, bins_log: int, bits: int):
    def run(batches):
        rng = np.random.default_rng(8)
        n_hash = bands * rows
        factors = rng.integers(1, 2**63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts = rng.integers(1, 2**63, max(n_hash, bands), dtype=np.uint64)
        for batch in batches:
            # a row takes a counter for each bit of its sketch, however short its text is
            for low, high in textvec.slices(batch.column("text"), 1 << 19, bits):
                part = batch.slice(low, high - low)
                sets, begin = _sets(part.column("text"), shingle)
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes)
                least = np.zeros((n_hash, part.num_rows), np.uint64)
                if len(full):
                    for k in range(n_hash):
                        least[k, full] = np.minimum.reduceat((sets ^ salts[k]) * factors[k], begin[:-1][full])
                keys = np.zeros((bands, part.num_rows), np.uint64)
                for k in range(bands):
                    acc = np.full(part.num_rows, salts[k], np.uint64)
                    for m in range(rows):
                        acc = textvec.mix(acc ^ least[k * rows + m])
                    keys[k] = acc
                bins = sets >> np.uint64(64 - bins_log)
                head = np.ones(len(sets), bool)
                head[1:] = bins[1:] != bins[:-1]
                head[begin[:-1][full]] = True
                place = textvec.mix(sets[head] ^ salts[0]) % np.uint64(bits)
                flips = np.bincount(np.repeat(np.arange(part.num_rows), sizes)[head] * bits + place.astype(np.int64), minlength=part.num_rows * bits)
                sketches = np.packbits((flips & 1).astype(np.uint8).reshape(part.num_rows, bits), axis=1).view(np.int64)
                ids = [_set_key(sets[a:b]) if b > a else None for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), _lists(sketches), _lists(np.ascontiguousarray(keys.T).view(np.int64))],
                    ["doc_id", "digest", "n_shingles", "set_key", "sketch", "bands"],
                )

    return run


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def digest(text: Column) -> Column:
    """What tells apart rows of one doc_id."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bins: int = BINS, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, set_key, sketch, bands) of each row."""
    plain = _plain(docs).withColumn("digest", digest(F.col("text")))
    return plain.mapInArrow(_signatures(shingle, bands, rows, bins.bit_length() - 1, bits), "doc_id long, digest binary, n_shingles long, set_key binary, sketch array<long>, bands array<long>")


def _full_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for low, high in textvec.slices(batch.column("text"), 1 << 19):
                sets, begin = _sets(batch.column("text").slice(low, high - low), shingle)
                own = [sets[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "set"])

    return run


def full_sets(plain: DataFrame, wanted: DataFrame, shingle: int, tag: str) -> DataFrame:
    """(id, set) of the wanted classes (id, doc_id: one that has it)."""
    rows = plain.join(wanted.select("doc_id").distinct(), "doc_id")
    found = rows.mapInArrow(_full_sets(shingle), "id binary, set binary")
    return common.stored(found.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), tag)


def most_flips(total, percent: int, bins: int, bits: int, exp, sqrt, deviations: float = 6.0):
    """The most bits by which the sketches of a similar pair differ, for sets of
    total size `total` together; numbers, arrays or columns, with their exp and sqrt."""
    j = percent / 100
    union = total / (1 + j)
    used = bins * (1 - exp(union / -bins))  # ranges with a value of either set
    # where the smallest hash isn't common, the other set may have a value too
    both = 1 - exp(total * (-0.56 / bins))
    odd = (1 - j) * used
    differ = odd * (1 + both)
    spread = j * odd * (1 - used / (union + 1)) * (1 + both) * (1 + both) + odd * both * (1 - both)
    # bits with an odd number of so many flips
    stays, two = exp(differ * math.log(1 - 2 / bits)), exp(differ * math.log(1 - 4 / bits))
    fold = bits / 4 * (1 - two) + bits * bits / 4 * (two - stays * stays)
    return bits / 2 * (1 - stays) + deviations * sqrt(spread * stays * stays + fold + 1)


def _differing(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)


def _groups(batches, names: list, keys: list):
    """Tables of whole groups: rows come sorted by keys, and those of one group may
    reach over batches. With each, where its groups begin."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch.select(names))
        table = pa.Table.from_batches(held).combine_chunks()
        new = _heads(table, keys)
        last = int(new[-1])
        if last:
            yield table.slice(0, last), new[:-1]
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _heads(table, keys)


def _heads(table, keys: list) -> np.ndarray:
    import pyarrow.compute as pc

    new = np.ones(table.num_rows, bool)
    for i, k in enumerate(keys):
        c = table.column(k)
        differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new[1:] = differs if not i else new[1:] | differs
    return np.flatnonzero(new)


def _one(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _words64(column) -> np.ndarray:
    """Rows of equally many 64-bit words."""
    column = _one(column)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(column), -1)


def _bytes64(column) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words, begin) of binary rows."""
    data, offsets = textvec.buffers(column)
    return np.frombuffer(data.tobytes(), np.uint64), offsets // 8


class _Exact:
    """How much the sets of two rows have in common."""

    def __init__(self, column):
        values, self.begin = _bytes64(column)
        self.size = np.diff(self.begin)
        names, code = np.unique(values, return_inverse=True)
        self.code, self.many = code.astype(np.int64), len(names) + 1
        self.key = np.repeat(np.arange(len(self.size)), self.size) * self.many + self.code

    def similar(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        out = np.zeros(len(i), bool)
        total = np.cumsum(self.size[j])
        low = 0
        while low < len(i):
            base = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, base + (1 << 20))))
            p, q = i[low:high], j[low:high]
            n = self.size[q]
            want = np.repeat(p, n) * self.many + self.code[textvec.ragged(self.begin[q], n)]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            both = np.add.reduceat((self.key[at] == want).astype(np.int64), np.cumsum(n) - n)
            out[low:high] = 100 * both >= percent * (self.size[p] + n - both)
            low = high
        return out


def _partners(side: np.ndarray, heads: np.ndarray):
    """(i, j) of rows that meet, in parts: in each group side 0 meets side 1, and rows
    of side 2 meet one another."""
    n = len(side)
    ends = np.append(heads[1:], n)
    group = np.searchsorted(heads, np.arange(n), "right") - 1
    ones = np.concatenate([[0], np.cumsum(side == 1)])
    end = ends[group]
    low = np.where(side == 0, end - (ones[end] - ones[heads[group]]), np.arange(n) + 1)
    many = np.where(side == 1, 0, end - low)
    total = np.cumsum(many)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        high = max(at + 1, int(np.searchsorted(total, base + STEP)))
        rows = np.arange(at, high)
        yield np.repeat(rows, many[rows]), textvec.ragged(low[rows], many[rows])
        at = high


def _close(table, sketch, bands, i, j, percent: int, bins: int, bits: int):
    """The pairs whose sketches allow the threshold and that meet here first."""
    n = table["n"]
    x, y = n[i], n[j]
    ok = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
    i, j = i[ok], j[ok]
    apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int32)
    ok = apart <= most_flips(n[i] + n[j], percent, bins, bits, np.exp, np.sqrt)
    i, j = i[ok], j[ok]
    if len(i):
        first = (bands[i] == bands[j]).argmax(1)
        ok = bands[i, first] == table["bucket"][i]
        i, j = i[ok], j[ok]
    return i, j


MET = "bucket long, block string, side int, id binary, component binary, n long, sketch array<long>, bands array<long>"


def _meeting(percent: int, bins: int, bits: int, exact: bool):
    """Rows of (bucket, block) come sorted by side. Without exact: the rows that have
    a possible partner. With it (rows have their set): links between components."""
    names = ["bucket", "block", "side", "id", "component", "n", "sketch", "bands"] + ["set"] * exact

    def run(batches):
        for rows, heads in _groups(batches, names, ["bucket", "block"]):
            table = {c: rows.column(c).to_numpy() for c in ("side", "n")}
            table["bucket"] = rows.column("bucket").to_numpy().view(np.uint64)
            comp = _one(rows.column("component").combine_chunks().dictionary_encode()).indices.to_numpy()
            sketch, bands = _words64(rows.column("sketch")), _words64(rows.column("bands"))
            sets = _Exact(rows.column("set")) if exact else None
            marked, a, b = np.zeros(rows.num_rows, bool), [], []
            group = np.searchsorted(heads, np.arange(rows.num_rows), "right") - 1
            label = np.unique(group.astype(np.int64) << 32 | comp, return_inverse=True)[1]  # of components, by group
            up = np.arange(len(label))

            def root(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            for i, j in _partners(table["side"], heads):
                apart = label[i] != label[j]
                i, j = _close(table, sketch, bands, i[apart], j[apart], percent, bins, bits)
                if not exact:
                    marked[i] = marked[j] = True
                    continue
                hit = sets.similar(i, j, percent)
                joined = False
                for p, q in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                    x, y = root(label[p]), root(label[q])
                    if x != y:
                        up[y], joined = x, True
                        a.append(p), b.append(q)
                if joined:
                    while not np.array_equal(up, up[up]):
                        up = up[up]
                    label = up[label]
            if exact:
                ids = rows.column("id")
                yield pa.RecordBatch.from_arrays([_one(ids.take(pa.array(x, pa.int64()))) for x in (a, b)], ["a", "b"])
            else:
                yield from rows.filter(pa.array(marked)).to_batches()

    return run


def _confirm(percent: int):
    """Rows of (hub, salt) come sorted, the hub's own set first."""

    def run(batches):
        for rows, heads in _groups(batches, ["hub", "salt", "id", "set"], ["hub", "salt"]):
            i = np.repeat(heads, np.diff(np.append(heads, rows.num_rows)))
            j = np.arange(rows.num_rows)
            i, j = i[i != j], j[i != j]
            hit = _Exact(rows.column("set")).similar(i, j, percent)
            yield pa.RecordBatch.from_arrays([_one(rows.column("id").take(pa.array(x[hit], pa.int64()))) for x in (i, j)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each pair goes to the
    group of a; a group of many pairs is dealt to salts, each with a's set."""
    degree = common.stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts")), "degree")
    ends = pairs.join(degree, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    hubs = degree.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("id"))
    rows = ends.unionByName(hubs).hint("merge").join(sets, "id").select("hub", "salt", "id", "set")
    n = common.shuffle_partitions(sets.sparkSession)
    dealt = rows.repartition(n, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("id") != F.col("hub"))
    return dealt.mapInArrow(_confirm(percent), "a binary, b binary")


def met(inside: DataFrame, labels: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Rows of MET: in each bucket its largest component is met by the members outside
    it, and they meet one another, in blocks of about so many shingles."""
    labelled = inside.join(labels, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    labelled = common.stored(labelled, "labelled")
    parts = labelled.groupBy("bucket", "component").agg(F.sum(F.col("n") + 64).alias("w"))
    main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("w", "component")).alias("main"), F.max("w").alias("w_main"), (F.sum("w") - F.max("w")).alias("w_other"))
    main = common.stored(main.where("w_other > 0"), "main")
    split = labelled.join(main, "bucket").join(classes.select("id", "sketch", "bands"), "id")
    n_main, n_other = (F.ceil(F.col(c) / block).cast("int") for c in ("w_main", "w_other"))
    is_main = F.col("component") == F.col("main")
    own = F.pmod(F.xxhash64("id"), F.when(is_main, n_main).otherwise(n_other)).cast("int")
    split = split.withColumn("own", own).withColumn("is_main", is_main)
    grid = lambda count: F.sequence(F.lit(0), count - 1)
    # main block i meets each other block j; other block i meets other block j >= i
    at = F.when(F.col("is_main"), F.transform(grid(n_other), lambda j: F.struct(F.concat_ws("-", F.lit("m"), F.col("own"), j).alias("block"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(grid(n_main), lambda i: F.struct(F.concat_ws("-", F.lit("m"), i, F.col("own")).alias("block"), F.lit(1).alias("side"))),
            F.transform(grid(n_other), lambda j: F.struct(F.concat_ws("-", F.lit("o"), F.least("own", j), F.greatest("own", j)).alias("block"), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1).alias("side"))),
        )
    )
    return split.select("bucket", "id", "component", "n", "sketch", "bands", F.explode(at).alias("at")).select("bucket", "at.block", "at.side", "id", "component", "n", "sketch", "bands")


def labelled(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, bins: int = BINS, bits: int = SKETCH_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept), one row for each row of docs."""
    plain, n = _plain(docs), common.shuffle_partitions(docs.sparkSession)
    signed = common.stored(signatures(docs, shingle, bands, rows, bins, bits), "signed")
    real = signed.where("set_key is not null and doc_id is not null")
    classes = real.groupBy(F.col("set_key").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    classes = common.stored(classes, "classes")
    members = common.stored(classes.select("id", "doc_id", "n", F.explode("bands").alias("bucket")), "members")
    buckets = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "id")).getField("id").alias("center"), F.count("*").alias("size")).where("size > 1")
    inside = common.stored(members.join(buckets, "bucket").select("bucket", "center", "id", "n"), "inside")
    stars = inside.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    sketches = classes.select("id", "n", "sketch")
    close = stars.join(sketches.toDF("a", "n_a", "sketch_a"), "a").join(sketches.toDF("b", "n_b", "sketch_b"), "b")
    close = close.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    close = close.where(_differing("sketch_a", "sketch_b") <= most_flips(F.col("n_a") + F.col("n_b"), percent, bins, bits, F.exp, F.sqrt))
    close = common.stored(close.select("a", "b"), "close")
    ends = close.select(F.col("a").alias("id")).unionByName(close.select(F.col("b").alias("id"))).distinct()
    sets = full_sets(plain, classes.select("id", "doc_id").join(ends, "id"), shingle, "sets")
    links = common.stored(confirmed(close, sets, percent), "links")

    rest = met(inside, common.components(links), classes, block)
    dealt = lambda d: d.repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "side")
    marked = common.stored(dealt(rest).mapInArrow(_meeting(percent, bins, bits, False), MET), "marked")
    needed = classes.select("id", "doc_id").join(marked.select("id").distinct(), "id")
    more = full_sets(plain, needed, shingle, "sets")
    tested = dealt(marked.join(more, "id")).mapInArrow(_meeting(percent, bins, bits, True), "a binary, b binary")
    links = links.unionByName(common.stored(tested.distinct(), "links"))

    of = classes.select("id", "doc_id").join(common.components(links), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    of = common.stored(of, "of")
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = common.stored(of.join(least, "component").select(F.col("id").alias("set_key"), "component_id"), "named")
    out = signed.select("doc_id", "digest", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def link(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs."""
    return labelled(docs, **options).drop("digest")


def op8_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
"""
