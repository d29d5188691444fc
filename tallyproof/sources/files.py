"""Strict scans and canonical sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

IGNORED = ("_comment", "_internal")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a local session without one gets its own."""
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


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Deletes this application's files in the shared folder. Results that haven't been
    written elsewhere yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All cells as text, with a registered header. A row of another width lands in
    _corrupt; blank lines are skipped."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _corrupt string"
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, enforceSchema=False, columnNameOfCorruptRecord="_corrupt", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_upload(spark: SparkSession, path: str, columns: list[str], ignored=IGNORED) -> DataFrame:
    """As read_csv, without the columns that must not be kept."""
    return read_csv(spark, path, columns).drop(*ignored)


def physical_rows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, n_rows, n_wrong_width) of text files with cells between commas; a comma in
    a quoted cell is part of it."""
    bare = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    lines = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.size(F.split(bare, ",", -1)).alias("width"))
    return lines.groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if(F.col("width") != width).alias("n_wrong_width"))


def numbered_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) with line numbers from 1."""
    return texts.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def canonical_cells(df: DataFrame) -> DataFrame:
    """Every column as text: null is empty, booleans are lower case, whole numbers
    have no fraction."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind in ("double", "float"):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            c = F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_records(df: DataFrame, path: str, partition: str, order: list[str]) -> None:
    """Published records: ranges of the order, sorted inside, by publication."""
    df.repartitionByRange(partition, *order).sortWithinPartitions(partition, *order).write.partitionBy(partition).parquet(path)


def read_markdown(spark: SparkSession, path: str, label: str = r"[^/]+$") -> DataFrame:
    """(source_file, text) of the .md and .txt files under a folder, each file whole; a file's
    label is the part of its path that the pattern finds, by default its name."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), label, 0).alias("source_file"), F.col("value").alias("text"))
