"""Streams of several epochs: late rows, keys that come again, repeated epochs."""

import datetime as dt

from pyspark.sql import functions as F

from tallyproof.streaming import streams as S


def stamp(day, hour=12):
    return dt.datetime(2024, 1, day, hour)


def arriving(spark, path, epochs):
    for k, rows in enumerate(epochs):
        df = spark.createDataFrame([(i, t, u, e, v, None) for i, t, u, e, v in rows], S.EVENTS.replace("timestamp_ntz", "timestamp"))
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{path}/{k}")
    return S.events(spark, str(path), 1)


ROWS = [
    [(1, stamp(1), 1, "a", 1.0), (2, stamp(2), 1, "a", 2.0)],
    [(3, stamp(9), 2, "a", 4.0), (4, stamp(1), 2, "a", 8.0)],  # closes all before the 7th when it ends: day 1 is still open for row 4
    [(5, stamp(1), 1, "a", 16.0), (6, stamp(6), 1, "b", None), (7, stamp(8), 1, "b", 0.5)],  # 5 and 6 are late
    [(8, stamp(1), 3, "a", 32.0), (9, stamp(20), 1, "a", 64.0)],
]


def test_late_rows_are_kept_apart_and_joined_back(spark, tmp_path):
    path = S.daily_with_late(arriving(spark, tmp_path, ROWS))
    assert spark.read.parquet(f"{path}/closed").count() == 4
    assert sorted(r.event_id for r in spark.read.parquet(f"{path}/late").collect()) == [5, 6, 8]
    told = spark.read.parquet(f"{path}/told")
    assert {(r.day.day, r.event_type): (r.n, r.cents) for r in told.collect()} == {(1, "a"): (2, 900), (2, "a"): (1, 200), (8, "b"): (1, 50), (9, "a"): (1, 400)}
    assert told.count() == told.select("day", "event_type").distinct().count()  # each once
    got = {(r.day.day, r.event_type): (r.n, r.cents, r.n_late, r.is_open) for r in S.corrected(spark, path).collect()}
    assert got == {(1, "a"): (4, 5700, 2, False), (2, "a"): (1, 200, 0, False), (6, "b"): (1, None, 1, False), (8, "b"): (1, 50, 0, False), (9, "a"): (1, 400, 0, False), (20, "a"): (1, 6400, 0, True)}


def test_a_key_is_never_forgotten(spark, tmp_path):
    rows = [[(1, stamp(1), 1, "a", 1.0), (2, stamp(1), 1, "a", 2.0), (3, stamp(1), None, "a", 2.0)], [(4, dt.datetime(2025, 6, 1), 1, "b", 1.0)], [(5, dt.datetime(2026, 6, 1), 1, "a", 1.0), (6, stamp(1), None, "a", 2.0), (7, stamp(1), 2, None, 2.0)]]
    out = spark.read.parquet(S.once(arriving(spark, tmp_path, rows), ["user_id", "event_type"]))
    got = sorted(((r.user_id, r.event_type, r.epoch) for r in out.collect()), key=str)
    assert got == sorted([(1, "a", 0), (None, "a", 0), (1, "b", 1), (2, None, 2)], key=str)


def test_a_repeated_epoch_writes_the_same(spark, tmp_path, monkeypatch):
    """Each epoch is handed over twice, as after a lost driver."""
    plain = S.drained
    twice = lambda out, mode, each=None: plain(out, mode, lambda df, k: (each(df, k), each(df, k)))
    with monkeypatch.context() as m:
        m.setattr(S, "drained", twice)
        path = S.daily_with_late(arriving(spark, tmp_path / "a", ROWS))
        once = S.once(arriving(spark, tmp_path / "b", ROWS), ["user_id"])
    assert {(r.day.day, r.event_type): r.n for r in S.corrected(spark, path).collect()} == {(1, "a"): 4, (2, "a"): 1, (6, "b"): 1, (8, "b"): 1, (9, "a"): 1, (20, "a"): 1}
    assert sorted(r.user_id for r in spark.read.parquet(once).collect()) == [1, 2, 3]
