"""Exact retrieval against the column expression and brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyproof.functions.numbers import cosine
from tallyproof.operators import retrieval as R

SCHEMA = "vec_id long, embedding array<float>, label int"


def hard_rows():
    """Copies beyond k, near copies, repeated ids, zero, null and short vectors, null and NaN components."""
    rng = random.Random(3)
    near = lambda v: [x + rng.choice([0, 0, 1e-6]) for x in v]
    base = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, near(base[i % 12]), i % 5) for i in range(140)]
    rows += [(200 + i, base[0], 1) for i in range(20)] + [(10, base[3], 7), (10, base[3], 7), (30, base[3], 2)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [0.5] * 4, 1), (303, [], 1), (304, [None] + [1.0] * 7, 1), (305, [float("nan")] * 8, 2), (306, [None] * 8, 2), (None, base[1], 3)]
    return rows


def listed(df, *columns):
    return sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("small", [False, True])
def test_scores_and_best_equal_the_expression(spark, monkeypatch, small):
    if small:  # many blocks, parts and batches
        monkeypatch.setattr(R, "BLOCK_BYTES", 500)
        monkeypatch.setattr(R, "PART_BYTES", 3000)
        monkeypatch.setattr(R, "PRODUCTS", 64)
        monkeypatch.setattr(R, "PAIRS", 7)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        e = spark.createDataFrame(hard_rows(), SCHEMA)
        q = e.where("vec_id % 10 = 0 or vec_id > 300")
        pairs = q.selectExpr("vec_id query_id", "embedding q", "label q_label").crossJoin(e.selectExpr("vec_id doc_id", "embedding v", "label d_label")).withColumn("score", cosine("q", "v"))
        columns = ("query_id", "doc_id", "q_label", "d_label", "score")
        assert listed(R.scores(q, e, "vec_id", "vec_id", "embedding", ["label"]), *columns) == listed(pairs, *columns)
        rounded = pairs.withColumn("score", F.round("score", 6))
        assert listed(R.scores(q, e, "vec_id", "vec_id", "embedding", ["label"], digits=6), *columns) == listed(rounded, *columns)
        for k in (1, 3, 400):
            got = R.nearest(q, e, "vec_id", "vec_id", "embedding", k, ["label"])
            want = R.top_k(pairs.where("query_id <> doc_id"), k)
            # rows of one id may change places
            assert listed(got, "query_id", "doc_id", "score", "rank") == listed(want, "query_id", "doc_id", "score", "rank")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_to_search(spark):
    e = spark.createDataFrame(hard_rows(), SCHEMA)
    for q, d in ((e.limit(0), e), (e, e.limit(0))):
        assert R.nearest(q, d, "vec_id", "vec_id", "embedding", 2).count() == R.scores(q, d, "vec_id", "vec_id", "embedding").count() == 0


def test_sixteen_million_pairs(spark):
    """40,000 documents and 400 queries, half of the documents copies of one: by an
    expression for each pair this takes many minutes."""
    vector = F.when(F.col("id") % 2 == 1, F.array(*(F.lit(0.5) for _ in range(64)))).otherwise(F.array(*(F.rand(i) - 0.5 for i in range(64)))).cast("array<float>")
    e = spark.range(40_000).select(F.col("id").alias("vec_id"), vector.alias("embedding"))
    began = time.time()
    out = R.nearest(e.where("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", 5)
    assert out.count() == 2000 and time.time() - began < 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
