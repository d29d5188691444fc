"""What the operators of this subpackage share: tables in the shared folder,
and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local
    session without one (as in tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tallyproof-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/tallyproof-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application. Results that haven't been
    written yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: later
    steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str):
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list:
    return [column(c) for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each end of an edge; component: the smallest id that
    can be reached. Labels spread along edges and are then shortened by looking
    up the label's own label, until nothing changes; each round is a stored
    table, read by joins whose skewed keys Spark can split."""
    spark = edges.sparkSession
    both = stored(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = (
            both.join(labels, both.u == labels.id)
            .groupBy(F.col("v").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        near = stored(near, "near")
        hooked = stored(labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")), "hooked")
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = stored(hooked.join(up, "component").select("id", F.least("component", "up").alias("component"), "was"), "jumped")
        changed = jumped.where("component <> was").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels
