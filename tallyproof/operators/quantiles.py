"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources import files


def percentiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(keys, p, n, value): for each group and each p of at, the value at rank
    p * (n - 1) of its n values in order, between two ranks in proportion. Nulls don't
    count; a group of nulls alone has n = 0 and no value.

    Equal values are counted first, then all groups' values are dealt to sorted ranges,
    so that a large group lies in many of them. From the ranges' counts follows which of
    them hold the ranks asked for; only these are read again and counted through."""
    spark = df.sparkSession
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(1).alias("_all"))
    counts = df.select(key.alias("k"), F.col(value).cast("double").alias("v")).groupBy("k", "v").agg(F.count("v").alias("m"))
    path = files.fresh_path(spark, "values")
    counts.repartitionByRange("k", "v").sortWithinPartitions("k", "v").withColumn("part", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sizes = ranged.groupBy("k", "part").agg(F.sum("m").alias("size"))  # a group's ranges at most
    until = F.sum("size").over(Window.partitionBy("k").orderBy("part"))
    sizes = sizes.withColumns({"before": until - F.col("size"), "n": F.sum("size").over(Window.partitionBy("k"))})
    groups = sizes.select("k", "n").distinct()
    asked = groups.select("k", "n", F.explode(F.array(*(F.lit(float(p)) for p in at))).alias("p")).withColumn("rank", F.col("p") * (F.col("n") - 1))
    ends = asked.where("n > 0").select("k", "p", F.explode(F.array(F.floor("rank"), F.ceil("rank"))).alias("at")).distinct()
    needed = sizes.join(ends, "k").where("at >= before and at < before + size").select("k", "part", "before", "p", "at")
    counted = Window.partitionBy("k", "part").orderBy("v")
    inside = ranged.where("m > 0").join(needed.select("k", "part").distinct(), ["k", "part"], "left_semi").withColumn("upto", F.sum("m").over(counted))
    hit = inside.join(needed, ["k", "part"]).where("at < before + upto and at >= before + upto - m").select("k", "p", "at", "v")
    found = hit.groupBy("k", "p").agg(F.min_by("v", "at").alias("low"), F.max_by("v", "at").alias("high"))
    out = asked.join(found, ["k", "p"], "left")
    share = F.col("rank") - F.floor("rank")
    between = F.when((F.col("low") == F.col("high")) | (share == 0), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * share)
    return out.select(*(F.col("k").getField(c).alias(c) for c in keys), "p", "n", between.alias(value))
