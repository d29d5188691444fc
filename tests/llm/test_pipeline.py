"""The pipeline's stages on the hard cases and on planted copies."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P

from .helpers import documents, frame, prose


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    clean = [(500 + i, "\n".join(prose(rng, 30) for _ in range(4))) for i in range(30)]
    copy = [(600, clean[0][1]), (601, clean[1][1].replace(" ", " x ", 1)), (602, clean[2][1].split("\n")[0] + "\n" + prose(rng, 60))]
    df = frame(spark, [*documents(), *clean, *copy])
    spark.createDataFrame([(500 + i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, n = df, {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == df.columns, name
        docs = P.common.stored(out, name)
        n[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert docs.where("doc_id = 602").first().text.startswith("\n") or clean[2][1].split("\n")[0] not in docs.where("doc_id = 602").first().text
    assert {i for i, _ in clean} <= n["suffix_dedup"]
    assert 30 not in n["quality_rules"] and 33 not in n["quality_rules"]
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def run_stages(spark, docs, folder):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    out = {}
    for name, stage in P.STAGES:
        docs = P.common.stored(stage(spark, docs, str(folder)), name)
        out[name] = docs
    return out


def test_empty_table(spark, tmp_path):
    out = run_stages(spark, frame(spark, []), tmp_path)
    assert all(d.count() == 0 for d in out.values())


def test_short_texts_only(spark, tmp_path):
    rows = [(i, f"{w} " * 3 + " ".join("".join(random.Random(f"{w}{k}").choices("abcdefgh", k=5)) for k in range(9))) for i, w in enumerate("pqrstuv")]
    out = run_stages(spark, frame(spark, rows), tmp_path)
    assert [d.select("doc_id").distinct().count() for d in out.values()] == [7] * 5


def test_repeated_rows_null_ids_and_other_texts_of_an_id(spark, tmp_path):
    rng = random.Random(22)
    a, b, c = (prose(rng, 80) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (3, c), (None, c), (None, c), (4, c)]
    docs = frame(spark, rows).withColumn("of", F.lit(1)).withColumn("id", F.lit("x"))
    kept = P.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(1, a), (3, b), (3, c), (0, c), (0, c)])


def test_names():
    assert [k for k, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "suffix_dedup", "best_fit_packing"]
