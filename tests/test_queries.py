"""Registered queries against their SQL twins on the smallest supplied tables."""

import os

import duckdb
import pytest

from tallyproof import catalog

SF = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "NULL" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted([cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    cur = con.execute(catalog.ORACLES[name])
    want = canonical([x[0] for x in cur.description], cur.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")
def test_same_period_tells_of_every_window(spark):
    from tallyproof.adapters import sku_period, store_period
    from tallyproof.plans import diagnostics as D

    panel, skus = store_period(spark, SF), sku_period(spark, SF)
    n, target = panel.count(), panel.where(f"period_month = '{D.TARGET}'").count()
    flags = {r.scope_flag: r["count"] for r in D.same_period(panel, skus, D.WINDOW).groupBy("scope_flag").count().collect()}
    assert sum(flags.values()) == n and flags["not_comparable_period_mismatch"] == n - target > 0
    assert {r.n_rows for r in D.guardrail_sensitivity(panel, skus).collect()} == {n}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
