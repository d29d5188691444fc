"""Panels and top lists are dealt over as many tasks as their lines need."""

import os

import pytest
from pyspark.sql import functions as F

from tallyproof import adapters as A
from tallyproof.catalog import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables aren't here")


@pytest.mark.parametrize("made", [A.store_period, A.sku_period])
def test_more_lines_get_more_tasks(spark, monkeypatch, made):
    before = sorted(map(str, made(spark, SF).collect()))
    monkeypatch.setattr(A, "LINES", 100)
    many = made(spark, SF)
    assert sorted(map(str, many.collect())) == before and len(before) > 100
    n = A.tasks(spark, SF)
    assert n == -(-A.table(spark, SF, "lineitem").count() // 100) > 2
    plan = many._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Exchange" in x]
    assert any(f", {n}), REPARTITION_BY_NUM" in x for x in lines)
    # no map-side sum stands between the scan and the exchange of lines
    first = next(i for i, x in reversed(list(enumerate(plan.splitlines()))) if f", {n}), REPARTITION_BY_NUM" in x)
    assert "HashAggregate" not in "\n".join(plan.splitlines()[first:]).split("Scan parquet")[0]


@pytest.mark.parametrize("name", ["fstr13_fact_text", "lin2_nested_lists", "rtv1_corpus_documents", "rtv1_corpus_units"])
def test_facts_are_dealt_by_lines_too(spark, monkeypatch, name):
    """No step that joins or gathers facts, panel rows or top lists by store and month
    follows the number of shuffle partitions."""
    before = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(A, "LINES", 1000)
    many = QUERIES[name](spark, SF)
    assert sorted(map(str, many.collect())) == before
    plan = [x for x in many._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning(store_id" in x]
    assert plan and all(f", {A.tasks(spark, SF)}), REPARTITION_BY_NUM" in x for x in plan)


def test_month_over_month_sends_a_line_once_to_each_side(spark, monkeypatch):
    """Lines go to their store's task, so that no rows of orders are sent, months of a store
    are together for those before, and what is joined is dealt by lines. Large stores are
    dealt in shares, with the same rows."""
    before = sorted(map(str, QUERIES["dia1_month_over_month"](spark, SF).collect()))
    for lines in (100, 1000):
        monkeypatch.setattr(A, "LINES", lines)
        many = QUERIES["dia1_month_over_month"](spark, SF)
        assert sorted(map(str, many.collect())) == before
        plan = [x.split("Exchange ")[1] for x in many._jdf.queryExecution().executedPlan().toString().split("Initial Plan ==")[0].splitlines() if "Exchange hashpartitioning" in x]
        assert not any("l_orderkey" in x or "l_partkey" in x for x in plan)
        own = [x for x in plan if f", {A.tasks(spark, SF)}), REPARTITION_BY_NUM" in x]
        assert len(own) == 5 and sum("_share" in x for x in own) == 2
        # the rest are counts of the lines of stores, and the stores
        rest = [x for x in plan if x not in own and not x.startswith("hashpartitioning(l_suppkey#")]
        assert len(rest) <= 1 and all(x.startswith("hashpartitioning(store_id#") and f", {A.tasks(spark, SF)}), ENSURE" in x for x in rest)


def test_a_large_store_is_dealt_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "LINES", 500)
    one = A.table(spark, SF, "lineitem")
    one.where("l_suppkey = 1 or l_orderkey % 50 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    n = {r.l_suppkey: r["count"] for r in A.table(spark, str(tmp_path), "lineitem").groupBy("l_suppkey").count().collect()}
    met = A._dealt(spark, str(tmp_path), 8, "l_orderkey").groupBy("l_suppkey").agg(F.countDistinct("_share").alias("n"), F.count("*").alias("lines")).collect()
    assert {r.l_suppkey: (r.n, r.lines) for r in met} == {k: (-(-v // 500), v) for k, v in n.items()} and n[1] > 500 > min(n.values())
