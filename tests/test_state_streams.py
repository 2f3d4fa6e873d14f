"""Alarm state as streams: any cut of the input into micro-batches gives the batch operators' rows; state goes. And sliding counts from panes."""

from __future__ import annotations

import collections
import os
import random

import pytest

from recollect.operators import queues as Q
from recollect.streaming import ingest as I
from recollect.streaming import state as S


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, folder, rows, schema, cuts, build):
    """The rows of a stream over files that hold the rows between the cuts, one file a batch, and the last batch's state rows."""
    edges = [0, *cuts, len(rows)]
    os.makedirs(f"{folder}/in")
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{folder}/part")
        name = next(f for f in os.listdir(f"{folder}/part") if f.endswith(".parquet"))
        os.rename(f"{folder}/part/{name}", f"{folder}/in/{k:03}.parquet")
        os.utime(f"{folder}/in/{k:03}.parquet", (1000 + k,) * 2)
        for f in os.listdir(f"{folder}/part"):
            os.unlink(f"{folder}/part/{f}")
        os.rmdir(f"{folder}/part")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = build(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    state = sum(p["numRowsTotal"] for p in q.lastProgress["stateOperators"])
    return sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())), state


@pytest.mark.parametrize("cuts", [[], [40], [1, 2, 90, 150]])
def test_rate_limit_and_resolution(rocks, tmp_path, cuts):
    rng = random.Random(6)
    t, rows = 0, []
    for _ in range(200):
        t += rng.randrange(1, 40)
        rows.append((f"I-{rng.randrange(4)}", t * 1000, rng.random() < 0.3))
    schema = "k string, at long, bad boolean"
    whole = rocks.createDataFrame(rows, schema)
    got, _ = streamed(rocks, f"{tmp_path}/a", rows, schema, cuts, lambda s: S.rate_limited(s, "k", "at", 100_000))
    assert got == sorted(map(tuple, Q.rate_limited(whole, "k", "at", 100_000).collect()))
    got, _ = streamed(rocks, f"{tmp_path}/b", rows, schema, cuts, lambda s: S.auto_resolve(s, "k", "at", "bad", 2))
    assert got == sorted(map(tuple, Q.auto_resolve(whole, ["k"], "at", "bad", 2).select("k", "at").collect()))


def test_state_of_silent_keys_goes(rocks, tmp_path):
    rows = [(f"I-{k}", 1000 + k, True) for k in range(20)] + [("late", 10**9, False), ("late", 2 * 10**9, False)]
    _, state = streamed(rocks, f"{tmp_path}/a", rows, "k string, at long, bad boolean", [20, 21], lambda s: S.rate_limited(s, "k", "at", 1000))
    assert state <= 4  # of the last key alone, with its timer
    _, state = streamed(rocks, f"{tmp_path}/b", rows, "k string, at long, bad boolean", [20, 21], lambda s: S.auto_resolve(s, "k", "at", "bad", 2, silence_ms=5000))
    assert state == 0


def test_sliding_counts_are_counts_of_events(spark):
    rng = random.Random(8)
    minute = 60_000
    events = [(rng.choice("ab"), rng.randrange(3 * 24 * 60) * minute // (1 + 9 * (k % 3 == 0))) for k in range(400)] + [("c", 0), ("c", 5 * minute), ("d", 40 * 24 * 60 * minute)]
    panes = collections.Counter((s, t // (5 * minute) * 5 * minute + 5 * minute) for s, t in events)
    until = 4 * 24 * 60 * minute + 7 * 5 * minute
    df = spark.createDataFrame([(s, e, n) for (s, e), n in panes.items()], "source string, pane_end long, n long")
    got = {(r.window_end, r.source): r.n for r in I.sliding_counts(df, until).collect()}
    want = collections.Counter((e, s) for s, t in events for e in range(t // (5 * minute) * 5 * minute + 5 * minute, t // (5 * minute) * 5 * minute + 5 * minute + 24 * 60 * minute, 5 * minute) if e <= until)
    assert got == want
    assert I.sliding_counts(df.limit(0), until).count() == 0
    plan = I.sliding_counts(df, until)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") <= 2
