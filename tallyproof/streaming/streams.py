"""Structured Streaming versions of daily totals, intake, supersede and quarantine.

Each takes a streaming DataFrame of events (event_id, ts timestamp, user_id,
event_type, value); drained() runs one until all that is there is through and
returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.files import fresh_path

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The events in a folder of Parquet files, so many files a trigger in the order of
    their arrival."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_totals(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Totals of whole days, told once the watermark has passed the day. Later rows are
    lost; see daily_with_late."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select(F.to_date("window.start").alias("day"), "event_type", "n", "cents")


def _before(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    """What the epochs before wrote there; a repeated epoch doesn't see itself."""
    if not epoch:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, epoch int").option("basePath", path).parquet(path).where(F.col("epoch") < epoch).drop("epoch")


TOTALS = "day date, event_type string, n bigint, cents bigint"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))


def daily_with_late(stream: DataFrame, days: int = 2) -> str:
    """Daily totals of a stream of any number of epochs in which no row is lost. Written
    to the folder returned, a folder for each epoch, which a repeated epoch writes again:

    open    totals of the epoch's rows whose day wasn't closed
    told    totals of the days that the epoch closed, each day once
    late    the rows themselves that came after their day was told
    closed  the first day still open: so many days before the latest time seen

    Only days that close are summed over epochs; the ledger is one row an epoch."""
    path = fresh_path(stream.sparkSession, "daily")

    def put(df, epoch):
        spark = df.sparkSession
        first = _before(spark, f"{path}/closed", epoch, "day date").agg(F.max("day")).first()[0]
        rows = df.withColumn("day", F.to_date("ts"))
        is_late = F.coalesce(F.col("day") < F.lit(first).cast("date"), F.lit(False))
        rows.where(is_late).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        _totals(rows.where(~is_late)).write.mode("overwrite").parquet(f"{path}/open/epoch={epoch}")
        last = rows.agg(F.date_sub(F.max("day"), days)).first()[0]
        until = max(filter(None, (first, last)), default=None)
        spark.createDataFrame([(until,)], "day date").write.mode("overwrite").parquet(f"{path}/closed/epoch={epoch}")
        ending = _before(spark, f"{path}/open", epoch + 1, TOTALS).where(F.col("day") < F.lit(until).cast("date"))
        ending = ending.where(F.lit(first).isNull() | (F.col("day") >= F.lit(first).cast("date")))
        ending.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).write.mode("overwrite").parquet(f"{path}/told/epoch={epoch}")

    drained(stream, "append", put)
    return path


def corrected(spark: SparkSession, path: str) -> DataFrame:
    """(day, event_type, n, cents, n_late, is_open) of what daily_with_late wrote: the
    totals told with the rows that came later, and those of days still open."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    until = read("closed").agg(F.max("day").alias("until"))
    still = read("open").join(until).where(F.col("day").isNull() | (F.col("day") >= F.coalesce("until", "day")))
    parts = [read("told").select("day", "event_type", "n", "cents", F.lit(0).alias("late"), F.lit(False).alias("is_open"))]
    parts.append(still.select("day", "event_type", "n", "cents", F.lit(0).alias("late"), F.lit(True).alias("is_open")))
    parts.append(_totals(read("late")).select("day", "event_type", "n", "cents", F.col("n").alias("late"), F.lit(False).alias("is_open")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("day", "event_type").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.sum("late").alias("n_late"), F.max("is_open").alias("is_open"))


def once(stream: DataFrame, keys: list[str]) -> str:
    """The first row of each key, however much later it comes again. Keys that came are a
    ledger without expiry, to which an epoch adds its own new ones. Nulls are keys too."""
    path = fresh_path(stream.sparkSession, "once")
    schema = stream.sparkSession.createDataFrame([], stream.schema).select(F.struct(*keys).alias("_key")).schema["_key"].dataType.simpleString()

    def put(df, epoch):
        had = _before(df.sparkSession, f"{path}/keys", epoch, f"_key {schema}")
        new = df.withColumn("_key", F.struct(*keys)).dropDuplicates(["_key"]).join(had, "_key", "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        df.sparkSession.read.parquet(f"{path}/rows/epoch={epoch}").select("_key").write.mode("overwrite").parquet(f"{path}/keys/epoch={epoch}")

    drained(stream, "append", put)
    return f"{path}/rows"


def latest_slots(stream: DataFrame) -> DataFrame:
    """The value in force of each entity's slot."""
    last = F.max_by(F.struct("event_id", "value", "ts"), F.struct("ts", "event_id"))
    return stream.groupBy("user_id", "event_type").agg(last.alias("last")).select("user_id", "event_type", "last.event_id", "last.value", "last.ts")


def drained(out: DataFrame, mode: str, each=None) -> str:
    """Writes all that is there into a table of the shared folder; each(df, epoch)
    takes over if given. A repeated epoch writes the same folder again."""
    spark = out.sparkSession
    path = fresh_path(spark, "stream")

    def put(df, epoch):
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    q = out.writeStream.outputMode(mode).foreachBatch(each or put).option("checkpointLocation", fresh_path(spark, "progress")).trigger(availableNow=True).start()
    q.awaitTermination()
    return path
