"""Streaming queries over the events table, and the batch results that they equal."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..adapters import table
from ..registry import query
from ..sources.files import fresh_path
from ..streaming import streams as S


EPOCHS = 10


def _arriving(spark, d, arrival) -> str:
    """A folder in which the events arrive in EPOCHS portions, one after another. A user's
    events of a portion are in one file."""
    path, rows = fresh_path(spark, "arriving"), table(spark, d, "events").withColumn("arrival", arrival)
    for k in range(EPOCHS):
        rows.where(F.col("arrival") == k).drop("arrival").repartition("user_id").write.parquet(f"{path}/{k}")
    return path


def _stream(spark, d, arrival=None):
    """The events as a stream of about EPOCHS epochs, out of order unless dealt by arrival."""
    path = _arriving(spark, d, F.pmod(F.xxhash64("event_id"), F.lit(EPOCHS)) if arrival is None else arrival)
    n = len(spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles())
    return S.events(spark, path, max(1, n // EPOCHS))


def _in_order(spark, d):
    """The portion of an event by the order of ids."""
    low, high = table(spark, d, "events").agg(F.min("event_id"), F.max("event_id")).first()
    return F.floor((F.col("event_id") - (low or 0)) * EPOCHS / ((high or 0) - (low or 0) + 1))


@query("stm1_daily_totals", "WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, value, ts FROM events) SELECT day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM e GROUP BY ALL")
def stm1(spark, d):
    """Days are told once two days have passed, rows that come later are kept apart and
    joined back as corrections. As events arrive out of order, most epochs have some."""
    return S.corrected(spark, S.daily_with_late(_stream(spark, d))).select("day", "event_type", "n", "cents")


@query("stm2_exactly_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stm2(spark, d):
    path = S.once(_stream(spark, d).select("user_id", "event_type"), ["user_id", "event_type"])
    return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def _slots(spark, d):
    """In update mode: an epoch writes the slots that it changed, and the last epoch of a
    slot holds."""
    done = spark.read.parquet(S.drained(S.latest_slots(_stream(spark, d)), "update"))
    own = F.max_by(F.struct("event_id", "value", "ts"), "epoch").alias("last")
    return done.groupBy("user_id", "event_type").agg(own).select("user_id", "event_type", "last.*")


@query("stm3_slot_supersede", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def stm3(spark, d):
    return _slots(spark, d).select("user_id", "event_type", "event_id")


@query("stm4_freshness", "SELECT event_type, count(*) FILTER (last >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS fresh, count(*) AS n FROM (SELECT user_id, event_type, max(ts) AS last FROM events GROUP BY ALL) GROUP BY 1")
def stm4(spark, d):
    s = _slots(spark, d).withColumn("expires_at", F.col("ts") + F.expr("interval 7 days"))
    return s.groupBy("event_type").agg(F.count_if(F.col("expires_at") >= F.lit("2024-01-31").cast("timestamp")).alias("fresh"), F.count("*").alias("n"))


@query("stm5_late_revisions", "WITH e AS (SELECT user_id, event_id, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM events) SELECT user_id, count(*) FILTER (late) AS n_late, count(*) AS n FROM e GROUP BY 1")
def stm5(spark, d):
    """Rows whose time goes back against an earlier row of their scope go to a side table.
    A batch is judged against itself and the ledger, which has one row for each scope;
    each epoch writes the next version of it and reads the one before."""
    path = fresh_path(spark, "revisions")
    own = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)

    def put(df, epoch):
        seen = df.sparkSession.read.parquet(f"{path}/ledger/{epoch - 1}") if epoch else df.sparkSession.createDataFrame([], "user_id bigint, seen timestamp")
        late = F.coalesce(F.col("ts") < F.greatest(F.max("ts").over(own), "seen"), F.lit(False))
        judged = df.join(seen, "user_id", "left").withColumn("late", late).drop("seen")
        judged.write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/epoch={epoch}")
        new = df.groupBy("user_id").agg(F.max("ts").alias("seen")).unionByName(seen)
        new.groupBy("user_id").agg(F.max("seen").alias("seen")).write.mode("overwrite").parquet(f"{path}/ledger/{epoch}")

    S.drained(_stream(spark, d, _in_order(spark, d)).select("user_id", "event_id", "ts"), "append", put)
    done = spark.read.parquet(f"{path}/rows")
    return done.groupBy("user_id").agg(F.count_if("late").alias("n_late"), F.count("*").alias("n"))


@query("stm6_quarantine_fork", "SELECT event_type, count(*) FILTER (value IS NOT NULL AND value >= 10) AS accepted, count(*) FILTER (value IS NULL OR value < 10) AS held FROM events GROUP BY 1")
def stm6(spark, d):
    """One stream into two sinks: rows that pass and rows that are held."""
    path = fresh_path(spark, "fork")

    def put(df, epoch):
        ok = F.coalesce(F.col("value") >= 10, F.lit(False))
        df.where(ok).write.mode("overwrite").parquet(f"{path}/accepted/epoch={epoch}")
        df.where(~ok).write.mode("overwrite").parquet(f"{path}/held/epoch={epoch}")

    S.drained(_stream(spark, d).select("event_id", "event_type", "value"), "append", put)
    read = lambda kind: spark.read.parquet(f"{path}/{kind}").select("event_type", F.lit(kind).alias("kind"))
    both = read("accepted").unionByName(read("held"))
    return both.groupBy("event_type").agg(F.count_if(F.col("kind") == "accepted").alias("accepted"), F.count_if(F.col("kind") == "held").alias("held"))
