"""Cases of the third round's findings: rows that the smallest tables lack."""

from __future__ import annotations

import duckdb
import pytest

from recollect.operators import lexical as L
from recollect.plans import registry
from recollect.sources.tail import TailReader

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def same(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    cols = [x[0] for x in want.description]
    want = sorted(want.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*cols).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["n16_ci_status", "c12_latest_run_fan_out"])
def test_an_annotation_counts_for_each_conclusion(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select 7::bigint as o_orderkey, 1::bigint as o_custkey, 'O' as o_orderstatus, timestamp '2024-01-02' as o_orderdate) to '{tmp_path}/orders.parquet'")
    con.execute(f"copy (select 7::bigint as l_orderkey, 1::bigint as l_linenumber, 5::bigint as l_suppkey, 'F' as l_linestatus, unnest(['R', 'A', 'A']) as l_returnflag) to '{tmp_path}/lineitem.parquet'")
    same(spark, tmp_path, name, ["orders", "lineitem"])


@pytest.mark.parametrize("name", ["i4_semantic_mode", "i8_recency_normalised", "i15_agent_decisions"])
def test_nodes_of_times_to_come(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"copy (select unnest([10, 20, 30000, 60000])::bigint as doc_id, unnest(['red ring', 'red stone', 'red ring here', 'blue']) as text, 'en' as lang, 's' as source) to '{tmp_path}/documents.parquet'")
    con.execute(f"copy (select doc_id, 1 as quality, 0 as toxic from '{tmp_path}/documents.parquet') to '{tmp_path}/labels.parquet'")
    con.execute(f"copy (select doc_id as vec_id, [1.0, doc_id / 20000.0]::float[] as embedding, 0 as label from '{tmp_path}/documents.parquet') to '{tmp_path}/embeddings.parquet'")
    con.execute(f"copy (select unnest([1, 2])::bigint as item_id, unnest(['red ring', 'blue stone']) as text) to '{tmp_path}/benchmark.parquet'")
    same(spark, tmp_path, name, ["documents", "labels", "embeddings", "benchmark"])


def test_small_files_share_a_task(tmp_path):
    for k in range(1500):
        (tmp_path / f"{k}.jsonl").write_text(f"{k}\n")
    (tmp_path / "long.jsonl").write_text("x" * 99 + "\n" + "y" * 99 + "\n")
    reader = TailReader({"path": str(tmp_path), "partbytes": "150"})
    end = reader.latestOffset()
    parts = TailReader({"path": str(tmp_path)}).partitions({}, end)
    assert 1 < len(parts) <= 3 and len(reader.partitions({}, end)) > 30
    for tasks in (parts, reader.partitions({}, end)):
        lines = [x for p in tasks for batch in reader.read(p) for x in batch.column("line").to_pylist()]
        assert sorted(lines) == sorted([*map(str, range(1500)), "x" * 99, "y" * 99])
    (tmp_path / "0.jsonl").write_text("0\n1\n")
    assert [*reader.latestOffset()] == [*TailReader({"path": str(tmp_path)}).latestOffset()]  # one order, whatever has changed


def test_a_search_among_given_documents(spark):
    docs = spark.createDataFrame([(i, "red " * (1 + i % 3) + ("ring" if i % 2 else "stone"), None) for i in range(400)], "id long, title string, body string")
    index = L.TextIndex.create(docs, ["title", "body"])
    q = spark.createDataFrame([(1, '"red ring" OR "red"'), (2, '"stone"')], "query_id int, match string")
    whole = {(r.query_id, r.id): r.bm25 for r in index.search(q).collect()}
    some = spark.createDataFrame([(i, -i) for i in range(0, 400, 5)], "id long, value long")
    got = {(r.query_id, r.id): r.bm25 for r in index.search(q, among=some.select("id")).collect()}
    assert got == pytest.approx({k: x for k, x in whole.items() if k[1] % 5 == 0})
    best = {(r.query_id, r.id) for r in index.search(q, 3, among=some).collect()}
    assert best >= {(1, 0), (1, 5), (1, 10), (2, 0), (2, 10), (2, 20)} and best <= {*got}
    index.apply(deleted=spark.createDataFrame([(0,), (5,)], "id long"))
    assert {r.id for r in index.search(q, among=some).collect()} == {*range(10, 400, 5)}


def test_runs_with_exact_matches_meet_no_windows(spark, sf, monkeypatch):
    from recollect.plans import joins

    met = []
    monkeypatch.setattr(joins.J, "range_join", lambda left, right, *a, real=joins.J.range_join, **b: (met.append(right), real(left, right, *a, **b))[1])
    QUERIES["c10_cascading_join"](spark, sf)
    bought = {r[0] for r in joins.role(spark, sf, "ev_user").filter("source_kind = 'purchase'").select("session_id").collect()}
    runs = {r.run for r in met[0].collect()}
    every = {r.id for r in joins.role(spark, sf, "runs").select("id").collect()}
    assert runs == {i for i in every if i % 500 not in bought} and len(runs) < len(every)
