"""Each operator against a plain version on small documents with the hard cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import bytebpe, common, linedup, masked, minhash, neighbours, packing, pieces, quality, recompress, substrings, suffixes, textvec, urls

from .helpers import documents, frame, prose, rows_of, words


def thue_morse(n, zero="a", one="b"):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


# Words that a polynomial modulo 2**64 can't tell apart, whatever its base is.
PATTERNS = [(1024, "a", "b"), (1024, "b", "a"), (2048, "a", "b"), (2048, "b", "a")]
PATTERNS = [thue_morse(*p) for p in PATTERNS]


def test_words_of_a_pattern_have_their_own_hashes():
    text = " ".join([*PATTERNS, *(p.upper() for p in PATTERNS), *(p[:n] for p in PATTERNS for n in (63, 64, 65, 128, 129))])
    data, offsets = textvec.buffers(pa.array([text]))
    starts, _, _ = textvec.word_bounds(data, offsets)
    assert len(set(textvec.word_hashes(data, starts).tolist())) == len(set(words(text)))
    assert len(set(textvec.word_hashes(data, starts, lower=True).tolist())) == len(set(words(text.lower())))
    two = np.array([1, 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    seqs = [np.array([two[int(c)] for c in thue_morse(128, *z)], np.uint64) for z in (("0", "1"), ("1", "0"))]
    assert textvec.wide(seqs[0], 128) != textvec.wide(seqs[1], 128)


# --- 7: passages of words

def plain_passages(rows, width):
    first = {}
    for doc, text in rows:
        w = words(text)
        if doc is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = set()
        if doc is not None:
            for i in range(len(w) - width + 1):
                if first[tuple(w[i : i + width])] < doc:
                    gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append({"doc_id": doc, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_passages(spark):
    got = rows_of(substrings.judge(frame(spark)).drop("removed"))
    want = plain_passages(documents(), 50)
    assert got == want
    assert sum(r["n_removed"] > 0 for r in got) > 5


def test_passages_of_pattern_words(spark):
    rows = [(i, " ".join([p] * 60)) for i, p in enumerate(PATTERNS)] + [(9, " ".join([PATTERNS[1]] * 55))]
    assert rows_of(substrings.judge(frame(spark, rows)).drop("removed")) == plain_passages(rows, 50)


def test_passages_of_empty_table(spark):
    assert substrings.judge(frame(spark, [])).count() == 0


def test_symbols_are_consistent():
    rng = random.Random(1)
    shared = [rng.randrange(2**60) for _ in range(50)]
    seen = []
    for _ in range(6):
        own = [rng.randrange(2**60) for _ in range(rng.randint(0, 90))] + shared + [rng.randrange(2**60) for _ in range(rng.randint(0, 90))]
        at = own.index(shared[0]) + 1
        levels = recompress.parse(np.array(own, np.uint64), np.array([0, len(own)]), 7, 25)
        names, low, high = recompress.anchors(levels, 50)
        seen.append({(n, a - at) for n, a, b in zip(names.tolist(), low.tolist(), high.tolist(), strict=True) if a >= at and b <= at + 50})
    assert seen[0] and all(s == seen[0] for s in seen)


# --- 5: byte strings

def plain_bytes(rows, width):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for i in range(len(b) - width + 1):
                first[b[i : i + width]] = min(first.get(b[i : i + width], doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if doc is not None:
            for i in range(len(b) - width + 1):
                if first[b[i : i + width]] < doc:
                    gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append({"doc_id": doc, "n_bytes": len(b), "n_removed": sum(gone), "n_spans": spans, "kept_sha256": hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()})
    return sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_byte_strings(spark):
    rows = [*documents(), (50, "-" * 500), (51, "x" + "-" * 300 + "y"), (52, "\x00" * 60), (53, "a\x00" * 40 + "\x00" * 60)]
    got = rows_of(suffixes.judge(frame(spark, rows), shard_bytes=300).drop("removed"))
    assert got == plain_bytes(rows, 50)
    assert sum(r["n_removed"] > 0 for r in got) > 8


def test_fragments_of_one_hash_stay_apart():
    blob = np.frombuffer(b"abcd" * 3 + b"abce" + b"abc", np.uint8)
    at, size = np.array([0, 4, 12, 16, 8]), np.array([4, 4, 4, 3, 4])
    one, of = suffixes._equal(np.array([7, 7, 7, 7, 9], np.uint64), blob, at, size)
    assert of[0] == of[1] and len({of[0], of[2], of[3], of[4]}) == 4 and len(one) == 4


def test_byte_strings_of_a_pattern(spark):
    rows = [(i, p + "." + p[::-1]) for i, p in enumerate(PATTERNS)]
    assert rows_of(suffixes.judge(frame(spark, rows)).drop("removed")) == plain_bytes(rows, 50)


def test_byte_strings_removed_and_empty(spark):
    df = frame(spark).withColumn("a b", F.lit(1)).withColumn("a.b", F.lit(2))
    out = suffixes.removed(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert suffixes.judge(frame(spark, [])).count() == 0


def test_merged_shards_equal_one_sort():
    rng = random.Random(3)
    shards, texts = [], []
    for _ in range(3):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(5, 20))) for _ in range(8)]
        text = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        order = suffixes.suffix_order(text, ends)
        tails = [bytes(text[i:]).split(b"\0")[0] for i in order]
        assert tails == sorted(tails)
        bwt = suffixes.transform(text, order)
        shards.append((bwt, suffixes.lf_mapping(bwt, order, ends - [len(p) for p in parts], ends)))
        texts += [(t, None) for t in tails]
    entry, block = suffixes.merge(shards, 6)
    blocks = defaultdict(list)
    for e, b in zip(entry, block, strict=True):
        blocks[b].append(texts[e][0])
    long = [x for x in (t for t, _ in texts) if len(x) >= 6]
    assert sum(len(v) for v in blocks.values() if len(v[0]) >= 6) == len(long)
    groups = sorted(len(v) for v in blocks.values() if all(len(x) >= 6 for x in v))
    assert groups == sorted(Counter(x[:6] for x in long).values())
    assert all(len({x[:6] for x in v}) == 1 for v in blocks.values() if len(v) > 1)


# --- 8: near copies

def plain_components(rows, shingle, percent):
    sets = {}
    for doc, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.setdefault(doc, set()).update({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    ids = [d for d in sets if d is not None]
    of = {d: d for d in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return of, {d: len(s) for d, s in sets.items()}


def test_near_copies(spark):
    rng = random.Random(5)
    rows = documents() + [(60 + i, " ".join([p, *"xyz"] * 2)) for i, p in enumerate(PATTERNS)]
    base = prose(rng, 200).split(" ")
    for i in range(30):  # a chain of edits: links between neighbours only
        base = [prose(rng, 1) if rng.random() < 0.02 else x for x in base]
        rows.append((100 + i, " ".join(base)))
    of, size = plain_components(rows, 4, 80)
    for r in rows_of(minhash.link(frame(spark, rows))):
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (of[r["doc_id"]], size[r["doc_id"]], r["doc_id"] == of[r["doc_id"]])
        else:
            assert r["component_id"] is None and r["kept"]


def test_near_copies_of_one_id_with_two_texts(spark):
    rng = random.Random(15)
    w, u = prose(rng, 40), prose(rng, 40)
    rows = [(2, w), (2, u), (1, w), (3, u), (3, u)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.link(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (3, 2, False)]


def test_a_large_group_of_near_copies_gives_few_rows(spark, monkeypatch):
    rng = random.Random(16)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(1500):  # any two differ in about four places: linked by chains only
        own = list(base)
        for _ in range(2):
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((i, " ".join(own)))
    written = []
    store = common.stored

    def counting(df, tag):
        out = store(df, tag)
        written.append((tag, out.count()))
        return out

    monkeypatch.setattr(common, "stored", counting)
    got = minhash.link(frame(spark, rows)).collect()
    of, _ = plain_fast(rows, 4, 80)
    assert {r.doc_id: r.component_id for r in got} == of
    links = [n for tag, n in written if tag == "links"]
    assert sum(links) < 40 * len(rows) and all(n <= 33 * len(rows) for _, n in written), written


def plain_fast(rows, shingle, percent):
    """As plain_components, by an inverted index."""
    sets = {d: {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for d, w in ((d, words(t)) for d, t in rows)}
    of, index = {d: d for d in sets}, defaultdict(list)

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for d, s in sets.items():
        both = Counter(o for g in s for o in index[g])
        for o, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                of[b] = a
        for g in s:
            index[g].append(d)
    return {d: root(d) for d in sets}, sets


def test_near_copies_of_empty_table(spark):
    assert minhash.link(frame(spark, [])).count() == 0


def test_many_short_texts_are_signed_in_parts():
    cut = list(textvec.slices(pa.array([""] * 5000 + [None, "x" * 4000, ""]), 1 << 19, minhash.SKETCH_BITS))
    assert max(b - a for a, b in cut) <= 257 and cut[0][0] == 0 and cut[-1][1] == 5003 and all(a[1] == b[0] for a, b in zip(cut[:-1], cut[1:], strict=True))


def test_sketch_limit_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    for n in (10, 100, 1000, 20000):
        common, own = rng.integers(0, 2**63, int(n * 0.8) + 1, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
        k = (len(own) - 0) // 10
        a, b = (np.unique(np.concatenate([common, own[:k // 2]])), np.unique(np.concatenate([common, own[k // 2 : k]])))
        bits = []
        for s in (a, b):
            s = textvec.mix(s)
            s.sort()
            bins = s >> np.uint64(54)
            first = s[np.concatenate([[True], bins[1:] != bins[:-1]])]
            bits.append(np.bincount((textvec.mix(first) % np.uint64(2048)).astype(int), minlength=2048) & 1)
        assert (bits[0] != bits[1]).sum() <= minhash.most_flips(len(a) + len(b), 80, 1024, 2048, np.exp, np.sqrt)


# --- 6: lines

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_lines(rows, classes):
    place = {}
    for doc, text in rows:
        if doc is not None and text is not None:
            for n, line in enumerate(text.split("\n")):
                if words(line):
                    place.setdefault(line, set()).add((doc, n))
    lines = sorted(place, key=len)
    of = {x: x for x in lines}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(lines):
        most = max([t for t, least in classes if len(a) >= least], default=0)
        for b in lines[i + 1 :]:
            third = len(a) // 3
            if len(b) - len(a) <= most and (a[:third] == b[:third] or a[-third:] == b[-third:] or len(a) < 60) and edits(a, b) <= most:
                of[root(a)] = root(b)
    head = {}
    for x in lines:
        head[root(x)] = min(head.get(root(x), min(place[x])), min(place[x]))
    gone = {p for x in lines for p in place[x] if p != head[root(x)]}
    return {doc: sorted(n for d, n in gone if d == doc) for doc, _ in rows}


@pytest.mark.parametrize("classes,pairs", [(((1, 24),), 32), (((1, 24), (2, 40)), 2)])
def test_lines(spark, classes, pairs):
    rng = random.Random(11)
    rows = documents()[20:]
    for stem, first in ((prose(rng, 6), 200), (prose(rng, 9), 250)):
        for i in range(14):  # many variants of one line
            at = rng.randrange(len(stem))
            rows.append((first + i, stem[:at] + rng.choice("xyz") + stem[at + rng.randint(0, 1) :] + "\n" + prose(rng, 8)))
    rows += [(300 + i, f"a numbered line of the list: {i}\n}}\n\n  ") for i in range(12)]
    want = plain_lines(rows, classes)
    for r in rows_of(linedup.judge(frame(spark, rows), classes=classes, pairs=pairs)):
        if r["doc_id"] is not None:
            assert r["removed_lines"] == ",".join(map(str, want[r["doc_id"]])), r
        else:
            assert r["n_removed"] == 0


def test_lines_removed_and_empty(spark):
    df = frame(spark).withColumn("a b", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("__gone", F.lit(3))
    out = linedup.removed(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.where("doc_id = 41").first().text == ""
    assert linedup.judge(frame(spark, [])).count() == 0


def test_lines_of_one_id_with_two_texts(spark):
    rows = [(1, "the same line of some length"), (2, "the same line of some length\nx y"), (2, "another line of some length\nz")]
    got = {r.text for r in linedup.removed(frame(spark, rows)).where("doc_id = 2").collect()}
    assert got == {"x y", "another line of some length\nz"}


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(150):
        a = "".join(rng.choices("abé😀", k=rng.randint(1, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choices("abc", k=rng.randint(0, 1))
        rows.append((a, "".join(b) or "a"))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        for r in df.select("a", "b", linedup.within(F.col("a"), F.col("b"), t).alias("w")).collect():
            assert r.w == (edits(r.a, r.b) <= t), r


# --- 4: quality rules

def test_quality_counts(spark):
    rows = [*documents(), (60, "w1 w2 w3 w4 w5 " * 2 + "x #* |"), (61, "a\n a\na\n\n\na"), (62, " ".join(f"{p} x y z w" for p in PATTERNS) + " q")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)] + [(1, 0, 0), (999, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for r, (doc, text) in zip(rows_of(quality.judge(frame(spark, rows), labels).drop("pooled", "lang")), sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        if doc is None:
            continue
        w = words(text)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_certified_is_the_exact_bound():
    for k, n, p in ((0, 100, 0.05), (3, 200, 0.05), (10, 1000, 0.02)):
        cdf = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality.log_binomial_cdf(k, n, p)), cdf, rel_tol=1e-9)
        assert quality.certified(k, n, p, cdf * 1.01) and not quality.certified(k, n, p, cdf * 0.99)
    assert not quality.certified(0, 0, 0.1, 0.5)


def test_false_rejections_stay_within_risk():
    rng = np.random.default_rng(4)
    over = 0
    for _ in range(300):
        good, bad = rng.normal(0, 1, 800), rng.normal(2, 1, 800)
        grid = {"s": [4.0, 3.0, 2.5, 2.0, 1.5, 1.0]}
        counts = {("s", i): (int((good > c).sum()), 800, int((bad > c).sum()), 800) for i, c in enumerate(grid["s"])}
        cut = quality.choose(counts, grid, 0.05, 0.05)["s"]
        over += cut is not None and 0.5 * math.erfc(cut / math.sqrt(2)) > 0.05
    assert over <= 0.05 * 300


def test_quality_rejects_labelled_junk(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60)) for i in range(900)] + [(1000 + i, prose(rng, 40) + " # | * #|" * 20) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in rows if i % 3], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.kept(frame(spark, rows), labels).collect()}
    assert kept == set(range(900))
    none = quality.judge(frame(spark, rows[:5]), labels.limit(0))
    assert none.where("kept").count() == 5


def test_quality_rejects_junk_that_passes_base_rules(spark):
    rng = random.Random(9)
    junk = lambda: " ".join("".join(rng.choices("abcdefgh#*|<>$", k=rng.randint(3, 7))) for _ in range(40))
    rows = [(i, prose(rng, 60), "a" if i < 600 else "b" if i < 900 else "c") for i in range(1200)] + [(2000 + i, junk(), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 2000), 0) for i, _, _ in rows if i % 5], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels, error=0.1).collect()
    assert not any(r["base_failed"] for r in got)
    # b and c have 240 good labels each, too few (ln(0.1 / 3) / ln(0.99) = 339) unless pooled
    assert {(r["lang"], r["pooled"]) for r in got} == {("a", False), ("b", True), ("c", True)}
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(1200))


def test_every_stratum_has_its_own_cutoffs(spark):
    rng = random.Random(10)
    langs = [None, "(null)", "(other)", *(f"l{i}" for i in range(75))]
    rows = [(i, prose(rng, 12) + (" " + " ".join("".join(rng.choices("#*|$&<>", k=4)) for _ in range(9)) if i % 10 == 9 else ""), x) for i, x in enumerate(x for x in langs for _ in range(80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("a b", F.lit(1)).withColumn("a.b", F.lit(2))
    labels = spark.createDataFrame([(i, int(i % 10 != 9), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    cuts = quality.thresholds(quality.measures(docs), labels, risk=0.2).collect()
    assert len(cuts) == len(langs) and not any(r.pooled for r in cuts) and all(r.symbols is not None for r in cuts)
    out = quality.kept(docs, labels, risk=0.2)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {i for i, _, _ in rows if i % 10 != 9}


def test_strata_are_pooled_until_large_enough():
    assert quality.pooled({"a": 2027, "b": 498, "c": 493, "d": 312}, 0.01, 0.0125) == {None, "c", "d"}
    assert quality.pooled({"a": 2027, "b": 498}, 0.01, 0.0125) == {None}
    assert quality.pooled({None: 5, "a": 498}, 0.01, 0.0125) == {None, "a"}


def test_joint_false_rejections_stay_within_risk():
    rng = np.random.default_rng(5)
    grid = {"s": [4.0, 3.0, 2.5, 2.0, 1.5], "t": [4.0, 3.0, 2.5, 2.0, 1.5]}
    steps = quality.sequence(grid)
    over = taken = 0
    for _ in range(300):
        good, bad = ({x: rng.normal(m, 1, 800) for x in grid} for m in (0, 2))
        at = lambda d: [np.logical_or.reduce([d[x] > grid[x][i] for x, i in steps[: t + 1]]).sum() for t in range(len(steps))]
        counts = {x: (int(k), 800, int(hit), 800) for x, k, hit in zip(steps, at(good), at(bad), strict=True)}
        cut = quality.choose(counts, grid, 0.05, 0.05)
        tail = [0.5 * math.erfc(c / math.sqrt(2)) for c in cut.values() if c is not None]
        over += 1 - math.prod(1 - p for p in tail) > 0.05
        taken += len(tail) == 2
    assert over <= 0.05 * 300 and taken > 250


# --- 10: packing

def test_packing(spark):
    rows = documents()
    out = packing.packed(frame(spark, rows), length=256).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bytebpe.default_path())
    want = Counter()
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        ends = range((len(ids) - 1) % 256 + 1, len(ids) + 1, 256)
        at = 0
        for k, e in enumerate(ends):
            want[(doc, k, at, e - at, zlib.crc32(np.array(ids[at:e], "<u4").tobytes()))] += 1
            at = e
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.packed(frame(spark, [])).count() == 0


def plain_best_fit(sizes, length):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else length) - s)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "one size", "long and short"])
def test_places_are_best_fit(spark, kind, monkeypatch):
    rng = random.Random(6)
    draw = {"mixed": lambda: rng.randint(1, 128), "small": lambda: rng.randint(1, 9), "one size": lambda: rng.choice([1, 43, 43, 43]), "long and short": lambda: rng.choice([rng.randint(60, 128), rng.randint(1, 3)])}[kind]
    sizes = [draw() for _ in range(900)]
    df = common.stored(spark.createDataFrame(list(enumerate(sizes)), "id long, size int"), "sizes")
    for per_range in (packing.RANGE, 200):
        monkeypatch.setattr(packing, "RANGE", per_range)
        rows = packing.places(df, 128).collect()
        assert sorted(r.id for r in rows) == list(range(len(sizes)))
        by = defaultdict(list)
        for r in rows:
            by[r.sequence].append((r.offset, sizes[r.id]))
        for own in by.values():
            at = 0
            for offset, size in sorted(own):
                assert offset == at
                at += size
            assert at <= 128
        assert len(by) <= plain_best_fit(sizes, 128) + (0 if per_range > 900 else 5)


def test_matches_take_the_nearest_places():
    assert packing.matches({0: (5, 2), 1: (1, 3), 2: (4, 0), 3: (9, 1)}) == [(1, 0, 0, 0, 1), (2, 0, 1, 0, 3), (2, 3, 0, 1, 1)]


# --- token ids

def test_token_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(bytebpe.default_path()), bytebpe.Encoder(bytebpe.default_path())
    rng = random.Random(9)
    texts = ["".join(rng.choices("a b'srtvelmd1.\n\té ß٣", k=rng.randint(0, 40))) for _ in range(2000)]
    texts += PATTERNS + [" ".join(PATTERNS)]
    texts += ["", " ", "\n", "x<|endoftext|>y", "日本 x", "don't you'll I'LL", "  a", "a  ", "''re", *(x or "" for _, x in documents())]
    ids, begin = e.encode(texts)
    for i, x in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


# --- 9: sampled pieces

def test_pieces_round_trip(spark):
    rows = [*documents(), (70, "▁a ▁ ▁▁ b"), (71, "   lead"), (72, "x" * 300 + "\x00\t\r\n"), (73, "line\n\nline "), *((80 + i, f"{p} x {p}") for i, p in enumerate(PATTERNS))]
    df = frame(spark, rows)
    ids = pieces.encoded(df)
    back = rows_of(pieces.decoded(ids))
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter(rows)
    again = pieces.encoded(df.repartition(2, "text"))
    assert Counter(map(str, rows_of(ids))) == Counter(map(str, rows_of(again)))
    assert pieces.round_trip(df).where("not lossless").count() == 0
    assert pieces.encoded(frame(spark, [])).count() == 0


def test_pieces_do_not_depend_on_the_batch(monkeypatch):
    rng, m = random.Random(17), pieces.Model(pieces.default_path())
    texts = [prose(rng, rng.randint(0, 30)) + rng.choice(["", " The quick fox", "é日本😀 x" * 9]) for _ in range(200)]
    keys = np.arange(200).astype(np.uint64)
    ids, begin = pieces.encode(pieces.Lattice(m), texts, keys)
    monkeypatch.setattr(pieces, "EDGES", 500)
    small = pieces.Lattice(m)
    for i in rng.sample(range(200), 200):
        own, _ = pieces.encode(small, [texts[i]], keys[i : i + 1])
        assert own.tolist() == ids[begin[i] : begin[i + 1]].tolist()


def test_samples_follow_the_lattice():
    m = pieces.Model(pieces.default_path())
    word = "there"
    n = 20000
    ids, begin = pieces.encode(pieces.Lattice(m), [word] * n, np.arange(n).astype(np.uint64))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:], strict=True))
    text, floor = " " + word, m.weight[m.weight > 0].min()

    def paths(i):
        if i == len(text):
            yield (), 1.0
        for j in range(i + 1, len(text) + 1):
            p = m.of.get(text[i:j])
            if p is not None:
                for rest, w in paths(j):
                    yield (p, *rest), m.weight[p] * w

    every = dict(paths(0))
    total = sum(every.values())
    assert set(got) <= set(every) and floor > 0
    for p, w in every.items():
        want = n * w / total
        assert abs(got[p] - want) <= 6 * math.sqrt(want + 1)


# --- 3: masked likelihood

def _network():
    keys = np.sort(textvec.mix(np.arange(10, dtype=np.uint64)))
    size = 512
    flat = masked.Network.start(np.arange(size)[::-1] + 1, 32, 4, 2)
    return masked.Network(keys, flat, size, 32, 4, 2)


def test_probabilities_sum_to_one():
    net = _network()
    context = np.array([[3], [7], [500], [net.size]])
    every = [net.forward(context, np.array([t]))[0][0] for t in range(net.size)]
    assert math.isclose(sum(map(math.exp, every)), 1.0, rel_tol=1e-4)


def test_gradient():
    rng = np.random.default_rng(1)
    net = _network()
    context, target = rng.integers(0, 512, (4, 64)), rng.integers(0, 512, 64)
    before = net.forward(context, target)[0].mean()
    for _ in range(30):
        net.learn(context, target, 0.05)
    assert net.forward(context, target)[0].mean() > before + 0.5


def test_scores_tell_prose_from_shuffled_words(spark):
    rng = random.Random(12)
    subjects, verbs, things = (["w%d%s" % (i, s) for i in range(8)] for s in "svo")
    say = lambda n: " ".join(f"the {rng.choice(subjects)} {rng.choice(verbs)} a {rng.choice(things)} ." for _ in range(n))
    train = [(i, say(40)) for i in range(300)]
    held = say(40)
    mixed = held.split(" ")
    rng.shuffle(mixed)
    df = frame(spark, train)
    made = masked.fit(df, classes=32, dim=8, size=1024, batch_size=4096)
    test = frame(spark, [(1, held), (2, " ".join(mixed)), (3, None), (4, ""), (None, "the"), (1, held)])
    rows = rows_of(masked.score(test, made))
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["mean_log_likelihood"] > by[2]["mean_log_likelihood"] + 1
    assert by[3]["log_likelihood"] == 0 and by[3]["mean_log_likelihood"] is None and by[4]["n_words"] == 0
    assert masked.score(frame(spark, []), masked.fit(frame(spark, []), classes=32, size=512)).count() == 0


def test_every_word_is_a_target_in_its_group():
    seen = Counter()

    class Recorder:
        def __init__(self):
            self.flat = np.zeros(4, np.float32)

        symbols = staticmethod(lambda hashes: hashes)
        contexts = staticmethod(lambda symbols, first, at: None)
        learn = staticmethod(lambda context, target, rate: seen.update(target.tolist()))

    texts = [" ".join(f"w{k}x{i}" for i in range(1001)) for k in range(3)]
    batches = [pa.RecordBatch.from_pydict({"group": [1, 1], "text": texts[:2]}), pa.RecordBatch.from_pydict({"group": [1, 5], "text": [texts[0], texts[2]]})]
    sent = [x.to_pydict() for x in masked._train(Recorder, 0.1, 64, 1 << 15)(batches)]
    assert [(x["group"], x["n"]) for x in sent] == [([1], [3003]), ([5], [1001])]
    assert sorted(Counter(seen.values()).items()) == [(1, 2002), (2, 1001)]


def test_average_is_the_weighted_mean(spark):
    rng = np.random.default_rng(7)
    values, n = rng.normal(size=(150, 2, 5)), rng.integers(1, 50, 150)
    rows = [(g, c, int(n[g]), values[g, c].tobytes()) for g in range(150) for c in range(2)]
    got = {r.chunk: np.frombuffer(r["values"]) for r in masked.averaged(spark.createDataFrame(rows, masked.SENT), 150).collect()}
    want = (values * n[:, None, None]).sum(0) / n.sum()
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1])


def test_fit_does_not_depend_on_the_split(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 30)) for i in range(120)]
    one = masked.fit(frame(spark, rows).coalesce(1), classes=32, dim=4, size=512, group=600).made().flat
    two = masked.fit(frame(spark, rows[::-1]).repartition(5), classes=32, dim=4, size=512, group=600).made().flat
    assert np.array_equal(one, two)


def test_scores_equal_a_plain_pseudo_likelihood(spark):
    rng = random.Random(18)
    rows = [(i, prose(rng, 25)) for i in range(40)]
    model = masked.fit(frame(spark, rows), classes=32, dim=4, size=masked.OTHERS + 64)
    p, keys = model.made().parts, {int(k): i for i, k in enumerate(masked.vocabulary(frame(spark, rows).select("text"), masked.OTHERS + 64)[0])}
    size, each, counts = masked.OTHERS + 64, (masked.OTHERS + 64) // 32, Counter(w for _, t in rows for w in words(t))
    code = {w: int(masked._hashes(pa.RecordBatch.from_pydict({"text": [w]}))[0][0]) for w in counts}
    symbol = {w: keys.get(c, 64 + c % masked.OTHERS) for w, c in code.items()}
    shared = Counter()
    for w, c in code.items():
        if c not in keys:
            shared[symbol[w]] += counts[w]
    got = {r["doc_id"]: r["log_likelihood"] for r in masked.score(frame(spark, rows), model).collect()}
    for doc, text in rows[:10]:
        w, total = [symbol[x] for x in words(text)], 0.0
        for i, s in enumerate(w):
            h = p["bend"].astype(np.float64)
            for k, o in enumerate((-2, -1, 1, 2)):
                h = h + p["tables"][k][w[i + o] if 0 <= i + o < len(w) else size]
            h = np.tanh(h)
            top, low = h @ p["top"] + p["top_bias"], h @ p["low"][s // each] + p["low_bias"][s // each]
            total += top[s // each] - np.log(np.exp(top).sum()) + low[s % each] - np.log(np.exp(low).sum())
        total += sum(math.log(counts[x] / (shared[symbol[x]] + 1)) for x in words(text) if code[x] not in keys)
        assert math.isclose(got[doc], total, rel_tol=1e-4)


def test_rare_words_have_their_own_probabilities(spark):
    rng = random.Random(14)
    pool = [f"r{i}" for i in range(3000)]
    rows = [(i, " ".join(["the", *rng.choices(pool, range(1, 3001), k=60)])) for i in range(150)]
    df = frame(spark, rows)
    model = masked.fit(df, classes=32, dim=4, size=masked.OTHERS + 32)
    counted = Counter(w for _, t in rows for w in words(t))
    keys, _ = masked.vocabulary(df.select("text"), masked.OTHERS + 32)
    tail = [(200, "the"), (201, "the " + " ".join(pool)), (202, "never"), (203, None), (203, "the never the"), *rows]
    by = defaultdict(list)
    for unit in (1 << 10, masked.UNIT):
        for r in masked.score(frame(spark, tail), model, unit).collect():
            by[r.doc_id, r.n_words].append(r.log_likelihood)
    net = model.made()
    rest = Counter()
    code = lambda w: int(masked._hashes(pa.RecordBatch.from_pydict({"text": [w]}))[0][0])
    hashes = {w: code(w) for w in [*counted, *pool, "never"]}
    shared = {w for w in hashes if hashes[w] not in set(keys.tolist())}
    for w in shared:
        rest[hashes[w] % masked.OTHERS] += counted[w]
    assert len(shared) > 2000 and "the" not in shared
    for doc, text in tail:
        w = words(text)
        symbols = net.symbols(np.array([hashes[x] for x in w], np.uint64))
        at = np.arange(len(w))
        want = float(net.forward(net.contexts(symbols, np.array([0, len(w)]), at), symbols)[0].sum()) if w else 0.0
        want += sum(math.log(max(counted[x], 1) / (rest[hashes[x] % masked.OTHERS] + 1)) for x in w if x in shared)
        got = by[doc, len(w)]
        assert len(got) == 2 and all(math.isclose(x, want, rel_tol=1e-4, abs_tol=1e-4) for x in got), doc


def test_vocabulary_counts(spark):
    rows = [(i, "x " * (i + 1) + "y Y rare%d" % i) for i in range(20)]
    keys, counts = masked.vocabulary(frame(spark, rows).select("text"), masked.OTHERS + 2)
    assert counts.sum() == sum(len(words(t)) for _, t in rows)
    assert counts[:2].tolist() == [210, 40]


# --- 2: neighbours

def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    x[200:210] = x[200] * np.arange(1, 11, dtype=np.float32)[:, None]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1050, [0.0] * 16, 1), (1100, [float("nan")] * 16, 1), (1150, [None] + [1.0] * 15, 1), (1200, [], 1), (None, [1.0] * 16, 1), (1250, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 600, 50):
        a = x.astype(np.float64)
        s = neighbours.exact(np.repeat(a[q : q + 1], len(a), 0), a)
        order = [i for i in np.lexsort((np.arange(len(a)), -s)) if i != q][:5]
        hits += len(set(order) & {i for i, _ in got[q]})
        total += 5
        assert all(math.isclose(v, s[i], rel_tol=1e-12) for i, v in got[q])
    assert hits / total >= 0.9
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert set(got) == set(range(0, 600, 50))
    few = neighbours.search(df.where("vec_id < 3 or vec_id = 1250"), F.col("vec_id") % 50 == 0)
    assert sorted((r.query_id, r.vec_id) for r in few.collect()) == [(0, 1), (0, 2)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_repeated_rows_leave_room_for_other_neighbours(spark):
    """An id that has a third of all rows is one candidate, in every block."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 8))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(7, (x[0] * 2).tolist())] * 20 + [(8, x[8].tolist())] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = {}
    for i, v in rows[1:]:
        s = neighbours.exact(x[:1], np.array([v]))[0]
        best[i] = max(best.get(i, -2), s)
    want = sorted(best.items(), key=lambda z: (-z[1], z[0]))[:5]
    for block in (8, 2048):
        got = [(r.vec_id, r.score) for r in neighbours.search(df, F.col("vec_id") == 0, block=block, probes=81).orderBy("rank").collect()]
        assert got[0] == (7, want[0][1]) and len({i for i, _ in got}) == 5
        assert all(math.isclose(s, best[i], rel_tol=1e-12) for i, s in got)


def test_functions_and_probes_follow_the_number_of_rows():
    assert [neighbours.fitting(n) for n in (0, 1 << 20, 1 << 24, 1 << 28)] == [(4, 16), (4, 16), (5, 48), (6, 144)]


@pytest.mark.parametrize("more", [0, 1, 2])
def test_recall_of_random_vectors(more):
    """Recall at 5 of what the visited buckets hold, on independent normal vectors."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.arange(0, 6000, 60)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -2
    truth = np.argsort(-near, axis=1)[:, :5]
    hashes, probes = neighbours.fitting(neighbours.LARGE * neighbours.GROWTH**more)
    seen = np.zeros((len(q), len(x)), bool)
    for t in range(neighbours.TABLES):
        a, b = neighbours._functions(t, 64, hashes, neighbours.CELL)
        scaled = (x @ a.T + b) / neighbours.CELL
        own = neighbours.bucket_ids(np.floor(scaled), t, 64)
        visited = neighbours.bucket_ids(neighbours.probe_cells(scaled[q], probes), t, 64)
        for i in range(len(q)):
            seen[i] |= np.isin(own, visited[i])
    assert np.take_along_axis(seen, truth, 1).mean() >= 0.94


def test_doubles_are_scored_as_doubles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)) * np.where(np.arange(60) % 3 == 0, 1e60, 1)[:, None]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.query_id for r in got} == {0, 50} and len(got) == 10
    for r in got:
        a, b = x[r.query_id] / np.abs(x[r.query_id]).max(), x[r.vec_id] / np.abs(x[r.vec_id]).max()
        assert math.isclose(r.score, a @ b / math.sqrt(a @ a) / math.sqrt(b @ b), rel_tol=1e-12)


def test_probes_come_in_order():
    cells = neighbours.probe_cells(np.array([[0.1, 0.5], [0.9, 0.45]]), 4)
    assert cells[0, :2].tolist() == [[0, 0], [-1, 0]] and cells[1, :2].tolist() == [[0, 0], [1, 0]]


# --- 1: urls

def test_urls(spark):
    cases = {
        "https://A.example.org/es/1": ("a.example.org", "/es/1", "example.org/es/", "block"), "http://example.org/en/12?x": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/fr": ("example.org", "/fr", "org/", "allow"), "http://example.org": ("example.org", "", None, None), "http://xorg/": ("xorg", "/", None, None),
        "https://b.com/fr/#t": ("b.com", "/fr/", "com/fr/", "allow"), "https://b.com/de/2": ("b.com", "/de/2", "com/de/", "block"), "no url": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
        "x://h://i/j": ("h:", "//i/j", None, None),
    }
    rows = [(i, u, "<p>news daily</p>", "r") for i, u in enumerate(cases)] + [(None, "https://b.com/de/2", None, "r"), (0, next(iter(cases)), "", "r")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    for r in urls.judge(df).collect():
        if r.page_id is not None:
            host, path, rule, verdict = list(cases.values())[r.page_id]
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judge(df).count() == len(rows) and urls.judge(df.limit(0)).count() == 0


def test_split():
    counts = {"news": 50, "daily": 40, "new": 60, "s": 5, "da": 3}
    spans = [(i, len(w), n) for w, n in counts.items() for i in range(9) if "newsdaily"[i : i + len(w)] == w]
    assert urls.best_split("newsdaily", spans, 500) == ["news", "daily"]
    assert "".join(urls.best_split("qqzz", [], 10)) == "qqzz" and urls.best_split("", [], 10) == []


def plain_split(name, counts):
    total = sum(counts.values())
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        every = []
        for start in range(end):
            w = name[start:end]
            cost = math.log(counts[w] / total) if w in counts else -math.log(total) - 3 - (end - start - 1) * math.log(10)
            every.append((best[start][0] + cost, [*best[start][1], w]))
        best.append(max(every, key=lambda x: x[0]))
    return best[-1]


def test_splits_equal_a_plain_search(spark):
    rng = random.Random(19)
    long = "abcdefghij" * 3
    counts = {"".join(rng.choices("abc", k=rng.randint(1, 6))): rng.randint(1, 90) for _ in range(60)} | {long: 40, long + "k": 3}
    names = ["".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(80)] + ["ab" + long + "kc", long, "z" * 70]
    df = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    for r in urls.segmented(df, spark.createDataFrame(list(counts.items()), "word string, n long")).collect():
        cost = sum(math.log(counts[w] / sum(counts.values())) if w in counts else -math.log(sum(counts.values())) - 3 - (len(w) - 1) * math.log(10) for w in r.words)
        assert "".join(r.words) == r.name and math.isclose(cost, plain_split(r.name, counts)[0], rel_tol=1e-9), r


def test_url_scores_equal_plain_naive_bayes(spark):
    rng = random.Random(20)
    vocabulary = ["news", "daily", "spam", "offer", "paper", "x"]
    rows = [(i, f"http://{''.join(rng.choices(vocabulary, k=2))}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['fr', 'de', 'q'])}/{rng.choice(vocabulary)}{i}", " ".join(rng.choices(vocabulary, k=9))) for i in range(150)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    counts, sides, seen = Counter(w for _, _, h in rows for w in h.split()), Counter(), {"allow": Counter(), "block": Counter()}

    def tokens(host, path):
        for mark, part in (("h:", host), ("p:", path)):
            for t in re.findall("[a-z]+|[0-9]+", part.lower()):
                yield from ([f"{mark}#{len(t)}"] if t.isdigit() else [mark + w for w in plain_split(t, counts)[1]])

    for r in got.values():
        if r.rule is not None:
            sides[r.verdict] += 1
            seen[r.verdict].update(tokens(r.host, r.path))
    words_ = set(seen["allow"]) | set(seen["block"])
    odds = {w: round((math.log((seen["allow"][w] + 1) / (seen["allow"].total() + len(words_))) - math.log((seen["block"][w] + 1) / (seen["block"].total() + len(words_)))) * urls.UNIT) for w in words_}
    for r in got.values():
        if r.rule is None:
            want = (sum(odds.get(w, 0) for w in tokens(r.host, r.path)) + round(math.log(sides["allow"] / sides["block"]) * urls.UNIT)) / urls.UNIT
            assert math.isclose(r.score, want, abs_tol=2e-5), r
            assert r.verdict == ("block" if r.score < 0 else "allow")


def test_urls_learn_words(spark):
    good, bad = ["news", "daily", "paper"], ["spam", "offer", "deal"]
    rng = random.Random(4)
    rows = []
    for i in range(200):
        side = good if i % 2 else bad
        name = "".join(rng.choices(side, k=2))
        rows.append((i, f"http://{name}.{'org' if i % 2 else 'com'}/{'x' if i % 2 else 'de/'}{i}", " ".join(good + bad)))
    rows += [(1000, "http://paperdaily.net/q", ""), (1001, "http://dealspam.net/q", "")]
    by = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert by[1000] == "allow" and by[1001] == "block"
