"""Groups of short texts, extreme vectors, and strata of few labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyproof.llm import neighbours, quality, substrings, suffixes

from .helpers import frame, prose, rows_of
from .test_operators import plain_bytes, plain_passages

rng = random.Random(31)
LONG = [(i, prose(rng, 120)) for i in range(3)]
SHORT = {
    "all short": [(i, prose(rng, 3)) for i in range(20)],
    "all empty": [(1, ""), (2, None), (3, " \n")],
    "two rows": [(1, ""), (2, None)],
    "null ids only": [(None, LONG[0][1]), (None, LONG[0][1]), (None, None)],
    "long among short": [*LONG, (9, LONG[1][1]), *((10 + i, prose(rng, 2)) for i in range(20))],
    "one letter": [(i, "a") for i in range(30)],
}


@pytest.mark.parametrize("parts", ["2", "8"])
@pytest.mark.parametrize("name", SHORT)
def test_repeats_among_short_texts(spark, name, parts):
    rows, had = SHORT[name], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = frame(spark, rows)
        assert rows_of(suffixes.judge(df).drop("removed")) == plain_bytes(rows, 50)
        assert rows_of(substrings.judge(df).drop("removed")) == plain_passages(rows, 50)
        out = suffixes.removed(df)
        assert out.columns == df.columns and out.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)


def test_vectors_of_any_size_take_part(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [5e-324, 0.0]), (3, [1.5e308, 1.5e308]), (4, [1.0, 2.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in neighbours.search(df, F.col("vec_id") % 2 == 0).collect()}
    unit = {0: (1, 2), 1: (1, 2), 2: (1, 0), 3: (1, 1), 4: (1, 2)}
    assert set(got) == {(q, v) for q in (0, 2, 4) for v in unit if v != q}
    for (q, v), score in got.items():
        a, b = np.array(unit[q], float), np.array(unit[v], float)
        assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_leveled_rows_are_exact():
    x = np.random.default_rng(3).normal(size=(50, 8))
    assert (neighbours.leveled(x * 2.0**-900) == neighbours.leveled(x)).all()
    plain = (x[:25] * x[25:]).sum(1) / (np.sqrt((x[:25] ** 2).sum(1)) * np.sqrt((x[25:] ** 2).sum(1)))
    assert (neighbours.exact(x[:25], x[25:]) == plain).all()


def test_as_few_strata_are_pooled_as_can_be():
    assert quality.strata({"a": 200, "b": 50, "c": 45, "d": 40}, 0.01, 0.05) == ({"a", "b", "c", "d"}, 0.05)  # 335 of 299
    assert quality.strata({"a": 2027, "b": 498, "c": 493, "d": 312}, 0.01, 0.05) == ({"c", "d"}, 0.05 / 3)
    assert quality.strata({"a": 500, "b": 500}, 0.01, 0.05) == (set(), 0.025)
    assert quality.strata({"a": 500, "b": 380, "c": 1}, 0.01, 0.05) == ({"b", "c"}, 0.025)
    assert quality.strata({"a": 10}, 0.01, 0.05)[0] <= {"a"}


def test_a_small_set_of_labels_rejects_junk(spark):
    langs = ["en"] * 200 + ["fr"] * 55 + ["de"] * 50 + ["es"] * 40
    own = random.Random(6)
    junk = lambda: " ".join("".join(own.choices("abcdefgh#*|<>$", k=own.randint(3, 7))) for _ in range(40))
    rows = [(i, prose(own, 60), x) for i, x in enumerate(langs)] + [(1000 + i, junk(), langs[5 * i]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(len(langs))) and all(r["certified"] and r["pooled"] for r in got)
    few = quality.judge(docs, labels.where("doc_id < 100 or doc_id > 1030")).collect()
    assert all(r["kept"] and not r["certified"] for r in few)
