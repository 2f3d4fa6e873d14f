"""Links meet large tables in parts that grow in number, not in size."""

from __future__ import annotations

import os

import pytest

from recollect.operators import joins as J
from recollect.plans import joins, registry
from recollect.sources import catalog


def plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_linked_table_whole(spark, sf):
    for links, _ in joins.families(spark, sf):
        assert "BroadcastHashJoin" not in plan(links) and "SortMergeJoin" in plan(links)
    assert "BroadcastHashJoin" not in plan(registry.queries()["e1_top_entities"](spark, sf))


def test_parts_follow_the_stored_bytes(spark, sf, monkeypatch):
    least = spark.sparkContext.defaultParallelism
    assert catalog.parts(spark, sf, "events", "region") == least
    monkeypatch.setattr(catalog, "PART_BYTES", 1000)
    n = catalog.parts(spark, sf, "region", "lineitem")
    assert n == os.path.getsize(f"{sf}/lineitem.parquet") // 1000 + 1 > least
    a = spark.range(100).withColumnRenamed("id", "k")
    assert J.dealt_join(a, a, "k", 7).rdd.getNumPartitions() == 7


@pytest.mark.parametrize("name", ["b11_eligible_nodes", "b20_noise_nodes", "e1_top_entities"])
def test_same_rows_in_many_parts(spark, sf, name, monkeypatch):
    few = sorted(map(tuple, registry.queries()[name](spark, sf).collect()))
    monkeypatch.setattr(catalog, "PART_BYTES", 5000)
    assert sorted(map(tuple, registry.queries()[name](spark, sf).collect())) == few
