"""Publication by manifest and copy-on-write upserts."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tallyproof.sources import publication as P

SCHEMA = "id bigint, kind string, v bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def read(spark, path):
    return sorted((tuple(r) for r in P.read(spark, path, table(spark, []).schema).select("id", "kind", "v").collect()), key=str)


def files(path):
    return {os.path.relpath(f, path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_parts_are_published_once(spark, tmp_path):
    path, rows = str(tmp_path), [(1, "a", 5), (2, "a", None), (2, "a", None), (3, "b", 7)]
    assert read(spark, path) == [] and P.newest(spark, path) == 0
    assert P.publish(table(spark, rows), path, "kind") == 1
    assert read(spark, path) == sorted(rows, key=str)
    held = files(path)
    assert P.publish(table(spark, rows), path, "kind") == 1 and files(path) == held
    assert P.publish(table(spark, [*rows, (9, "c", 1)]), path, "kind") == 2 and held.items() <= files(path).items()
    assert {r.part: r.n for r in P.manifest(spark, path).collect()} == {"a": 3, "b": 1, "c": 1}
    assert {r.part for r in P.manifest(spark, path, 1).collect()} == {"a", "b"}


def test_a_writer_lost_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    P.publish(table(spark, [(1, "a", 5)]), path, "kind")

    def lost(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(P, "commit", lost)
        with pytest.raises(KeyboardInterrupt):
            P.publish(table(spark, [(2, "b", 6)]), path, "kind")
    assert len(files(path)) == 2 and read(spark, path) == [(1, "a", 5)]
    assert P.publish(table(spark, [(2, "b", 6)]), path, "kind") == 2  # not taken for published
    assert read(spark, path) == [(1, "a", 5), (2, "b", 6)]


def test_of_two_writers_one_starts_again(spark, tmp_path):
    path = str(tmp_path)
    P.publish(table(spark, [(1, "a", 5)]), path, "kind")
    new = spark.createDataFrame([("x", "v", 1, "d")], P.MANIFEST)
    assert P.commit(spark, path, new, 1) == 2
    with pytest.raises(P.Conflict):
        P.commit(spark, path, new, 1)
    assert P.newest(spark, path) == 2 and not glob.glob(f"{path}/manifests/_*") and not glob.glob(f"{path}/manifests/2/_*-*")


def test_what_was_staged_is_compared(spark, tmp_path):
    rows = table(spark, [(1, "a", 5), (2, "a", 6)])
    version = P.staged(rows, str(tmp_path), "kind")
    with pytest.raises(ValueError, match="staged"):
        P.verified(spark, str(tmp_path), rows.schema, version, P.counted(rows.where("id = 1"), "kind"))


def test_upserts_leave_other_files_alone(spark, tmp_path):
    path = str(tmp_path)
    first = [(i, "x", 1) for i in range(400)] + [(None, "x", 1)]
    assert P.upsert(table(spark, first), path, ["id"], "v") == 1
    held = files(path)
    assert P.upsert(table(spark, [(7, "new", 2), (7, "old", 1), (1000, "y", 1)]), path, ["id"], "v") == 2
    want = {i: (i, "x", 1) for i, _, _ in first} | {7: (7, "new", 2), 1000: (1000, "y", 1)}
    assert read(spark, path) == sorted(want.values(), key=str)
    after = files(path)
    assert held.items() <= after.items() and 1 <= len(after) - len(held) <= 2  # at most two parts were written
    kept = {r.part: r.version for r in P.manifest(spark, path, 1).collect()}
    assert sum(kept.get(r.part) == r.version for r in P.manifest(spark, path).collect()) >= len(kept) - 2
    # the same rows again, stale rows and no rows change nothing
    for again in ([(7, "new", 2), (1000, "y", 1)], [(7, "stale", 1)], []):
        assert P.upsert(table(spark, again), path, ["id"], "v") == 2 and files(path) == after


def test_an_upsert_lost_before_its_commit_can_be_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    P.upsert(table(spark, [(1, "a", 1)]), path, ["id"], "v")
    with monkeypatch.context() as m:
        m.setattr(P, "verified", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            P.upsert(table(spark, [(1, "b", 2)]), path, ["id"], "v")
    assert read(spark, path) == [(1, "a", 1)]
    P.upsert(table(spark, [(1, "b", 2)]), path, ["id"], "v")
    assert read(spark, path) == [(1, "b", 2)]
    assert P.read(spark, path, table(spark, []).schema, 1).first()["kind"] == "a"  # the state before is still there


def test_digests_tell_nulls_and_columns_apart(spark):
    digest = lambda rows: P.counted(table(spark, rows).withColumn("part", F.lit("p"))).first()["digest"]
    seen = [digest(r) for r in ([(1, None, 2)], [(1, "", 2)], [(2, None, 1)], [(1, None, 2), (1, None, 2)], [(None, "1", 2)])]
    assert len(set(seen)) == len(seen) and digest([(1, "a", 2), (3, "b", 4)]) == digest([(3, "b", 4), (1, "a", 2)])
