"""Small documents with the hard cases, and brute-force versions."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g int, row string, bucket string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def documents():
    """(doc_id, text) with copies, near copies, shared passages, nulls, empties, long
    runs of one word, repeated rows and a very long text."""
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(6)]
    shared = prose(rng, 70)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0]), (22, base[1].replace(" ", "  ", 1)), (23, shared + "\n" + base[2]), (24, base[3][:300] + " " + shared), (25, shared)]
    w = base[4].split(" ")
    rows += [(26, " ".join([*w[:60], "changed", *w[61:]])), (27, " ".join([*w[:59], "other", "words", *w[61:]]))]
    rows += [(30, None), (31, ""), (32, "  \n\t "), (33, "one"), (34, "one two three"), (35, "One Two three"), (36, "a " * 130), (37, "b " + "a " * 200), (38, "é日本😀 " * 30), (39, "é日本😀 " * 30 + "x")]
    rows += [(40, "\n".join(["the same line of some length here", "another line which is quite long", "short", "short"])), (41, "\n".join(["the same line of some length here!", "Another line which is quite long", "short"]))]
    rows += [(42, prose(rng, 5000) + " " + shared), (5, base[5]), (None, base[0]), (None, None)]
    return rows


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    # columns beside text whose names the operators use themselves
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "r", "b") for i, t in rows], SCHEMA)


def rows_of(df, key="doc_id"):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: (r[key] is None, r[key] or 0, str(r)))
