"""Collocations, language profiles and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import re

from tallyproof.llm import collocations, langid, periods

from .helpers import documents, frame, rows_of, words

# ---- collocations


def counted(rows, longest):
    totals, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                for i in range(len(ws) - m + 1):
                    f[lang or "und"][tuple(ws[i : i + m])] += 1
    return totals, f


def plain_collocations(rows, longest=3, least=10, first=2000):
    totals, f = counted(rows, longest)
    out = []
    for lang, own in f.items():
        held = {p: n for p, n in own.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in held.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(100 * n >= 50 * a for q, n in held.items() if len(q) > len(p) and inside(q)):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        found.sort()
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(found[:first], 1)]
    return sorted(out)


def texts(seed=3):
    rng = random.Random(seed)
    vocabulary = ["of", "the", "Foo", "foo", "bär", "日本", "x-y", "a", "b", "c😀"]
    out = []
    for _ in range(150):
        ws = [rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\x0b", "\t", "!"]) for _ in range(rng.randint(0, 40))]
        out.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(ws)))
    return [*out, ("en", None), ("fr", None), ("fr", ""), ("es", " . "), ("en", "of the " * 3000), ("en", "of the " * 20), ("en", "of the " * 20), ("xx", "alone"), ("de", "zz yy xx. " * 12)]


@pytest.mark.parametrize("longest", [3, 4])
def test_collocations_equal_a_plain_count(spark, longest):
    rows = texts()
    docs = spark.createDataFrame([(i, t, lang, 1, 2) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, slice int").repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(docs, longest).collect())
    assert got == plain_collocations(rows, longest)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_first_phrases_only_and_ties_by_bytes(spark):
    rows = [("en", f"{a} {b}. " * 10) for a, b in [("é", "z"), ("z", "é"), ("a", "b"), ("日", "x")]]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = [(r["rank"], r["phrase"]) for r in collocations.collocations(docs, first=3).orderBy("rank").collect()]
    assert got == [(1, "a b"), (2, "日 x"), (3, "z é")]


def test_scores_beyond_64_bits_are_exact(spark):
    every = spark.createDataFrame([("en", [1], 3 * 10**12 + 1), ("en", [2], 3 * 10**12 + 7), ("en", [1, 2], 3 * 10**12 - 5)], "lang string, words array<long>, n long")
    a, left, right = 3 * 10**12 - 5, 3 * 10**12 + 1, 3 * 10**12 + 7
    assert collocations.scored(every).first()["score"] == 1000000 * a * a // (left * right)


def test_no_documents_no_phrases(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(docs).collect() == []


def test_tiles_count_as_a_counter():
    rng = np.random.default_rng(5)
    i, j = (np.minimum(rng.zipf(1.2, 300000), 3000) - 1 for _ in range(2))
    n = rng.integers(1, 5, len(i))
    for weights in (None, n):
        want = Counter()
        for x, y, w in zip(i.tolist(), j.tolist(), (weights if weights is not None else np.ones(len(i), int)).tolist(), strict=True):
            want[x, y] += w
        x, y, total = collocations.tiled(i, j, weights)
        assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist(), strict=True), total.tolist(), strict=True)) == want


# ---- languages


def plain_grams(text):
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in runs:
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def plain_rank(grams, n):
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], [ord(c) for c in x[0]]))[:n]]


def plain_prediction(text, profiles, n):
    own = plain_rank(plain_grams(text or ""), n)
    if not own or not profiles:
        return "und", 0.0
    far = sorted((sum(abs(i - p.index(g)) if g in p else n for i, g in enumerate(own)), lang) for lang, p in sorted(profiles.items()))
    after = far[1][0] if len(far) > 1 else len(own) * n
    return far[0][1], 1 - far[0][0] / after if after else 0.0


LANGS = {"en": "the of and with tion ing", "de": "der und sch ung straße öl", "el": "και των λόγος", "ja": "日本 の言葉 です"}


def spoken(seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        lang = rng.choice(list(LANGS))
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(LANGS[lang].split()).title() for _ in range(rng.choice([1, 3, 60])))
        rows.append((i, text, lang))
    rows += [(900, None, "en"), (901, "", "de"), (902, "12 -- 3", "en"), (903, "Ωμέγα", None), (None, "the und", "de"), (904, "한국어 말", "en"), (904, "한국어 말", "en"), (905, "the of " * 40000, "en"), (906, "ǅ İ", None)]
    return rows


@pytest.mark.parametrize("size", [12, 400])
def test_predictions_equal_a_plain_version(spark, size):
    rows = spoken()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, n string, rank int").repartition(4)
    own = langid.fold(docs["doc_id"])
    got = Counter(map(tuple, langid.predict(docs, langid.profiles(docs.where(own != 2), size), own == 2, size).collect()))
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _, _ in rows if i is not None}
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and fold[i] != 2 and lang and text:
            counts[lang] += plain_grams(text)
    profiles = {lang: plain_rank(c, size) for lang, c in counts.items() if c}
    want = Counter((i, None if i is None else fold[i] == 2, *plain_prediction(text, profiles, size)) for i, text, _ in rows)
    assert got == want


def test_held_out_documents_get_their_language(spark):
    rows = [r for r in spoken(12) if r[0] is not None and r[0] < 900]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = langid.fold(docs["doc_id"])
    out = langid.predict(docs, langid.profiles(docs.where(own != 2)), own == 2).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95 and all(0 <= r["score"] <= 1 for r in out)


def test_nothing_learned_or_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.predict(docs, langid.profiles(docs), docs["doc_id"] == 0).collect()] == [("und", 0.0)]
    none = docs.where("doc_id > 1")
    assert langid.predict(none, langid.profiles(none), none["doc_id"] == 0).collect() == []


def test_too_many_languages_are_refused(spark):
    learned = spark.range(langid.LANGUAGES + 1).selectExpr("cast(id as string) lang", "1 rank", "97L gram")
    with pytest.raises(ValueError, match="languages"):
        langid.predict(frame(spark), learned, frame(spark)["doc_id"] == 2)


# ---- periodic runs


def smallest(ws):
    return next(q for q in range(1, len(ws) + 1) if ws[q:] == ws[: len(ws) - q])


def plain_runs(ws, least=6, times=4):
    out = set()
    for q in range(1, len(ws) // times + 1):
        i = 0
        while i < len(ws) - q:
            start = i
            while i < len(ws) - q and ws[i] == ws[i + q]:
                i += 1
            if i - start + q >= max(least, times * q) and smallest(ws[start : i + q]) == q:
                out.add((start, i - start + q, q))
            i += 1
    return sorted(out)


def plain_judgement(doc, text):
    ws = words(text)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and ws:
        g, n = h // 10, len(ws)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    found = plain_runs(ws)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if found else None
    return (doc, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_documents_with_runs_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, t) for i, t in documents() if len(t or "") < 5000]
    rows += [(i, rng.choice([" ", "\n", "\x0b "]).join(rng.choice("abc") for _ in range(rng.randint(0, 90)))) for i in range(100, 200)]
    rows += [(200, "x y z " * 4 + "x y z x"), (201, "a a a a a"), (202, "a a a a a a"), (203, "a b " * 9 + "a c " * 9), (204, " ".join(str(i % 40) for i in range(170)))]
    got = Counter(tuple(r) for r in periods.judge(frame(spark, rows), periods.altered).drop("n_words", "runs").collect())
    assert got == Counter(plain_judgement(i, t) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(100, 200))


def test_runs_of_short_alphabets_equal_a_plain_scan():
    rng = random.Random(1)
    for _ in range(1500):
        ws = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = [rng.choice("abxyz") for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(ws))
            ws[at:at] = (p * 9)[: rng.randint(3, 9) * len(p)]
        assert periods.runs(ws) == plain_runs(ws)
        assert periods.runs(ws, 3, 3) == plain_runs(ws, 3, 3)


def test_rare_words_split_until_nothing_changes():
    ids = periods.word_ids(list("aabbaabcaaaaabc"))
    assert periods.segments(ids) == []  # b is there 4 times, but on both sides of c
    deep = [1, 0] + [w for k in range(1, 50) for w in (k + 1, k, k, k)] + [50] * 3  # each cut takes one of the next word
    assert periods.segments(periods.word_ids(deep)) == []


@pytest.mark.parametrize("ws", [["a"] * 200000, [i % 50000 for i in range(200000)], [bin(i).count("1") % 2 for i in range(1 << 17)]])
def test_very_long_texts(ws):
    found = periods.runs(ws)
    assert found == ([] if len(set(ws)) == 2 else [(0, len(ws), len(set(ws)))])


def test_no_documents_no_runs(spark):
    assert rows_of(periods.judge(frame(spark, []))) == []
