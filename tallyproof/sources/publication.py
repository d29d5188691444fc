"""Tables that readers see whole: parts are staged, listed in a manifest, and made
visible by one rename.

    path/data/version=<id>/part=<part>/...   what a writer has staged
    path/manifests/<number>/                 which version of each part holds

A manifest is a small table itself (part, version, n, digest), so that the driver lists
no files. It is written beside its place and renamed into it; a rename onto a manifest
that is there fails, so that of two writers on the same state one has to start again.
Readers go by the newest manifest alone: what a lost writer left in data is in none, is
never read, and never taken for published. A part that a writer doesn't touch keeps its
version and its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

MANIFEST = "part string, version string, n bigint, digest string"


class Conflict(RuntimeError):
    """Another writer has committed since the state that this one started from."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def newest(spark: SparkSession, path: str) -> int:
    """The number of the newest manifest; 0 if nothing has been committed."""
    fs, p = _fs(spark, f"{path}/manifests")
    if not fs.exists(p):
        return 0
    return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0)


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    number = newest(spark, path) if number is None else number
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{number}") if number else spark.createDataFrame([], MANIFEST)


def staged(rows: DataFrame, path: str, part: str, files: int = 1, spread: str | None = None) -> str:
    """Writes rows under a version of their own, a folder for each part (in so many files
    dealt by spread), and returns the version. Nobody reads it yet."""
    version = uuid.uuid4().hex
    deal = [F.col("part")] if spread is None else [F.col("part"), F.pmod(F.xxhash64(spread), F.lit(files))]
    rows.withColumn("part", F.col(part).cast("string")).repartition(*deal).write.partitionBy("part").parquet(f"{path}/data/version={version}")
    return version


def _data(spark: SparkSession, path: str, schema) -> DataFrame:
    full = spark.createDataFrame([], schema).withColumns({"version": F.lit("").cast("string"), "part": F.lit("").cast("string")}).schema
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(f"{path}/data")


def read(spark: SparkSession, path: str, schema, number: int | None = None) -> DataFrame:
    """The rows that a manifest lists (the newest one's), with their part. schema: of the
    rows without part."""
    held = manifest(spark, path, number)
    if not newest(spark, path):
        return spark.createDataFrame([], schema).withColumn("part", F.lit("").cast("string"))
    return _data(spark, path, schema).join(held.select("part", "version"), ["part", "version"]).drop("version")


def counted(rows: DataFrame, part: str = "part") -> DataFrame:
    """(part, n, digest): a digest that doesn't depend on the order of rows, of every
    column but part: exact sums of hashes, which partial sums feed."""
    h = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns) if c not in ("part", "version"))), {"ignoreNullFields": "false"}), 256)
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    g = rows.select(F.col(part).cast("string").alias("part"), h.alias("h")).groupBy("part").agg(F.count("*").alias("n"), *sums)
    return g.select("part", "n", F.sha2(F.concat_ws("-", "n", *(f"s{i}" for i in range(4))), 256).alias("digest"))


def commit(spark: SparkSession, path: str, new: DataFrame, base: int) -> int:
    """Makes the parts in new (part, version, n, digest) hold in place of those before,
    on top of manifest base, and returns the new number. Raises Conflict if there is a
    manifest after base."""
    kept = manifest(spark, path, base).join(new.select("part"), "part", "left_anti") if base else None
    out = new.select("part", "version", "n", "digest")
    out = kept.select(out.columns).unionByName(out) if base else out
    aside = f"{path}/manifests/_{uuid.uuid4().hex}"
    out.write.parquet(aside)
    fs, source = _fs(spark, aside)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{base + 1}")
    # a rename into a folder that is there would move beneath it, so that is told apart
    if newest(spark, path) != base or fs.exists(target) or not fs.rename(source, target) or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName())):
        fs.delete(source, True)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(target, source.getName()), True)
        raise Conflict(f"a manifest after {base} is there")
    return base + 1


def verified(spark: SparkSession, path: str, schema, version: str, want: DataFrame) -> DataFrame:
    """What is on disk of a staged version as rows of a manifest. Raises ValueError if it
    isn't what was wanted (part, n, digest)."""
    got = counted(_data(spark, path, schema).where(F.col("version") == version)).withColumn("version", F.lit(version))
    other = got.join(want, ["part", "n", "digest"], "left_anti").limit(1).count() or want.join(got, ["part", "n", "digest"], "left_anti").limit(1).count()
    if other:
        raise ValueError("what was staged isn't what was given")
    return got


def publish(rows: DataFrame, path: str, part: str) -> int:
    """Adds the parts that aren't published yet, all or none, and returns the number of
    the manifest that holds them. Publishing again changes nothing."""
    spark, base = rows.sparkSession, newest(rows.sparkSession, path)
    fresh = rows.join(manifest(spark, path, base).select(F.col("part").alias(part)), part, "left_anti") if base else rows
    if not fresh.limit(1).count():
        return base
    schema = rows.schema
    version = staged(fresh, path, part, 16, rows.columns[0])
    return commit(spark, path, verified(spark, path, schema, version, counted(fresh, part)), base)


def upsert(rows: DataFrame, path: str, keys: list[str], order: str, buckets: int = 64) -> int:
    """Puts rows in place of those with the same keys, the last by order of several, and
    returns the number of the manifest. A key's part is a hash of it; only parts that
    rows touch are read and written again, and of those only the ones that change. A row
    whose order is below the one that is there is stale and changes nothing, so that
    rows that are put again, in whatever order, leave every file as it is."""
    spark, base = rows.sparkSession, newest(rows.sparkSession, path)
    schema = rows.schema
    own = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"))
    touched = own.select("part").distinct()
    old = read(spark, path, schema, base).join(touched, "part", "left_semi")
    both = old.withColumn("_new", F.lit(0)).unionByName(own.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy("part", *keys).orderBy(F.desc(order), "_new", *(F.desc(c) for c in rows.columns if c not in (*keys, order))))
    merged = both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")
    want = counted(merged)
    changed = want.join(manifest(spark, path, base), ["part", "n", "digest"], "left_anti")
    if not changed.limit(1).count():
        return base
    version = staged(merged.join(changed.select("part"), "part", "left_semi"), path, "part")
    return commit(spark, path, verified(spark, path, schema, version, changed), base)
