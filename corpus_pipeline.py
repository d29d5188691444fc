"""A training corpus from raw documents, each stage on what the one before it kept.

quality_rules drops documents; line_dedup cuts lines that came before; near_dedup
keeps one document of each group of near copies; suffix_dedup cuts byte strings that
an earlier document has; packing lays the tokens of what is left into sequences. A
document whose text is cut away wholly stays, with an empty text. n_chars follows the
text. Rows with a null doc_id pass the stages that compare documents unchanged. Of rows
that repeat with the same doc_id and text one stays after near_dedup; rows of one doc_id
with different texts are different documents. An empty table passes all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyproof.llm import common, linedup, minhash, packing, quality, suffixes


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that they share with earlier ones."""
    return _recounted(linedup.removed(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once if
    its row repeats. Five words a shingle, as for all near-duplicate stages. Rows are
    dropped by id and text, so that an id that repeats with another text keeps that one."""
    found = common.stored(minhash.labelled(docs, shingle=5).where("doc_id is not null").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "kept"), "found")
    again = common.stored(found.where("kept").groupBy("id", "of").count().where("count > 1").select("id", "of"), "again")
    gone = common.stored(found.where("not kept").select("id", "of").distinct().unionByName(again), "gone")
    same = lambda d, t: (d["doc_id"].cast("long") == t["id"]) & (minhash.digest(d["text"]) == t["of"])
    mark = f"of_{uuid.uuid4().hex}"
    once = docs.join(again, same(docs, again), "left_semi").withColumn(mark, minhash.digest(docs["text"])).dropDuplicates(["doc_id", mark]).drop(mark)
    return docs.join(gone, same(docs, gone), "left_anti").unionByName(once)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that earlier ones have."""
    return _recounted(suffixes.removed(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = common.stored(docs, name) if i + 1 < len(STAGES) else docs
    return docs
