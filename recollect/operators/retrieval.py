"""Retrieval: exact nearest neighbours, fusion, recency, diversity, shaping and confidence.

All operators take tables of queries, so a batch of questions is one plan. Details are joined after the cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import vectors as V

RRF_K = 60
MMR_POOL = 500


#: Least and most of settings that have such.
BOUNDS = {"mmr_lambda": (0.0, 1.0), "recency_floor": (0.0, 1.0), "pool": (1, 100_000)}


@dataclass(frozen=True)
class Tuning:
    """Weights and caps; `of` clamps what a configuration gives and ignores what it cannot read."""

    knowledge_weight: float = 1.0
    lexical_weight: float = 1.0
    command_weight: float = 0.5
    mmr_lambda: float = 0.7
    half_life_days: float = 90.0
    recency_floor: float = 0.6
    pool: int = 3000

    @classmethod
    def of(cls, section: dict) -> Tuning:
        got = {}
        for f in fields(cls):
            try:
                x = type(f.default)(section[f.name])
            except (KeyError, TypeError, ValueError):
                continue
            low, high = BOUNDS.get(f.name, (0.0, float("inf")))
            got[f.name] = min(max(x, low), high)
        return cls(**got)


def tuned(name: str) -> Column:
    """The setting of this name that a text column of that name gives: clamped, and the default where it cannot be read."""
    default = next(f.default for f in fields(Tuning) if f.name == name)
    low, high = BOUNDS.get(name, (0.0, float("inf")))
    whole = isinstance(default, int)
    read = F.when(F.rlike(name, F.lit(r"^\s*[-+]?\d+\s*$")), F.expr(f"try_cast({name} AS bigint)")) if whole else F.expr(f"try_cast({name} AS double)")
    return F.when(read.isNull(), F.lit(default)).otherwise(F.least(F.greatest(read, F.lit(low)), F.lit(high))).cast("bigint" if whole else "double")


#: Queries of one call of the exact search, and of one pass over the vectors; distances that a task holds at once, and of its best.
MOST_QUERIES, QUERY_BLOCK, HELD = 65_536, 4096, 2_000_000


def _matrix(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this dimension, with zeros for the others, and their lengths."""
    fit = [r is not None and len(r) == dim and all(x is not None for x in r) for r in rows]
    out = np.zeros((len(rows), dim))
    out[fit] = np.array([r for r, ok in zip(rows, fit, strict=True) if ok], float).reshape(-1, dim)
    return out, np.sqrt((out * out).sum(1))


def nearest(block: list, k: int, id_col: str = "id"):
    """A batch function over ids and vectors: what a task has seen that is nearest to each query (query_id, q), k rows a query at most."""
    dims = sorted({len(r.q) for r in block if r.q is not None}) or [0]
    names, count = pa.array([r.query_id for r in block]), len(block)
    sides = [(dim, *_matrix([r.q for r in block], dim)) for dim in dims]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, found, held = max(1, HELD // count), None, np.zeros((count, 0))  # ids and distances by query
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            batch = batch.take(pc.array_sort_indices(batch.column(0)))
            cosine = np.zeros((count, batch.num_rows))
            rows = batch.column(1).to_pylist()
            for dim, q, size in sides:
                v, own = _matrix(rows, dim)
                both = size[:, None] * own
                cosine += np.divide(q @ v.T, both, out=np.zeros_like(both), where=both > 0)
            distance = np.round(1 - cosine, 9) + 0.0  # no negative zero
            near = np.argsort(distance, axis=1, kind="stable")[:, :k]
            new, ids = np.take_along_axis(distance, near, 1), batch.column(0).take(pa.array(near.ravel()))
            if found is None:
                found, held = ids, new
                continue
            ids = pa.concat_arrays([found, ids])
            place = np.concatenate([np.arange(len(found)).reshape(held.shape), np.arange(len(found), len(ids)).reshape(new.shape)], 1)
            order = np.empty(len(ids), np.int64)
            order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
            both = np.concatenate([held, new], 1)
            best = np.lexsort((order[place], both), axis=1)[:, :k]
            found, held = ids.take(pa.array(np.take_along_axis(place, best, 1).ravel())), np.take_along_axis(both, best, 1)
        if found is not None:
            of = np.repeat(np.arange(count), held.shape[1])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of)), found, pa.array(held.ravel())], ["query_id", id_col, "distance"])

    return run


def knn(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, id, distance of each query's k nearest by exact cosine distance, ties by id.

    `query` (query_id, q) has MOST_QUERIES rows at most. Blocks of queries meet batches of vectors as matrices, and a task gives k rows a query, however many batches it reads. A
    vector or query that is missing, zero, of another dimension or has a null component is at distance 1.
    """
    asked = query.select("query_id", "q").limit(MOST_QUERIES + 1).collect()
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: ask in batches, or use an index")
    kinds = {f.name: f.dataType.simpleString() for f in [*query.schema, *vectors.schema]}
    schema = f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, distance double"
    if not asked:
        return vectors.sparkSession.createDataFrame([], schema)
    step, v = max(1, min(QUERY_BLOCK, HELD // max(k, 1))), vectors.select(id_col, vector)
    found = reduce(DataFrame.unionByName, [v.mapInArrow(nearest(asked[i : i + step], k, id_col), schema) for i in range(0, len(asked), step)])
    w = Window.partitionBy("query_id").orderBy("distance", id_col)
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def ranked(hits: DataFrame, order: list[Column], k: int | None = None) -> DataFrame:
    """Adds rank from 1 in each query; with k, the first k."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return out if k is None else out.filter(F.col("rank") <= k)


def fuse(arms: list[tuple[DataFrame, float]], id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked arms (query_id, id, rank): sum of weight / (k + rank). An arm of weight 0 takes no part in the plan."""
    parts = [df.select("query_id", id_col, (F.lit(w) / (k + F.col("rank"))).alias("_s")) for df, w in arms if w]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("query_id", id_col).agg(F.sum("_s").alias("score"))


def with_recency(scored: DataFrame, created: str, now_ms: int, tuning: Tuning, ahead: bool = False) -> DataFrame:
    """Scores times recency, then over the query's best, so the best is 1. With `ahead`, rows of times to come count more than those of now."""
    aged = scored.withColumn("score", F.col("score") * V.recency(F.col(created), now_ms, tuning.half_life_days, tuning.recency_floor, ahead))
    top = F.max("score").over(Window.partitionBy("query_id"))
    return aged.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def mmr_pick(scores: np.ndarray, vectors: list, k: int, lam: float) -> list[int]:
    """Greedy maximal marginal relevance over candidates in order of score. A missing or zero vector is like none; similarities below 0 count as 0; the earlier wins ties. The largest similarity to the picked is kept up to date, so a pick costs one product."""
    n = len(scores)
    dim = max((len(v) for v in vectors if v is not None), default=0)
    unit = np.zeros((n, dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim and (size := float(np.linalg.norm(v))) > 0:
            unit[i] = np.asarray(v, float) / size
    closest, left, out = np.zeros(n), np.ones(n, bool), []
    while len(out) < min(k, n):
        value = np.where(left, lam * scores - (1 - lam) * closest, -np.inf) if out else np.where(left, scores, -np.inf)
        i = int(value.argmax())
        out.append(i)
        left[i] = False
        closest = np.maximum(closest, unit @ unit[i])
    return out


def mmr(scored: DataFrame, vectors: DataFrame, k: int, lam: float = 0.7, pool: int = MMR_POOL, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, id, score, pick of the k picks of each query. The pool (best `pool` rows of a query) bounds each group."""
    cut = ranked(scored.select("query_id", id_col, "score"), [F.desc("score"), F.col(id_col)], max(pool, k))
    rows = cut.join(vectors.select(id_col, F.col(vector).alias("_v")), id_col, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        at = mmr_pick(pdf["score"].to_numpy(float), list(pdf["_v"]), k, lam)
        out = pdf.loc[at, ["query_id", id_col, "score"]].copy()
        out["pick"] = range(1, len(at) + 1)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, score double, pick int")


def shaped(hits: DataFrame, linked: str = "linked") -> DataFrame:
    """Scores within 0 to 1 at four decimals, linked ids sorted."""
    return hits.withColumn("score", F.round(F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)), 4)).withColumn(linked, F.array_sort(linked))


_DAY = 86_400_000
UNHEALTHY = ("stale", "failing", "expected_absent", "unknown")


def confidence(score: Column, evidence: Column, families: Column, captured_at: Column, unhealthy: Column, statuses: Column, all_fresh: Column, cwd: Column, branch: Column, now_ms: int) -> Column:
    """Struct (level, score): six weighted factors, then caps. A single packet needs 0.78 for `high`, unhealthy capture forbids it, and no evidence withholds confidence."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    age = F.greatest(F.lit(now_ms) - captured_at, F.lit(0))
    factors = [
        (0.30, F.when(evidence == 0, 0.0).when(evidence >= 3, 1.0).when(evidence == 2, 0.8).otherwise(0.55)),
        (0.15, F.when(families >= 3, 1.0).when(families == 2, 0.75).when(families == 1, 0.45).otherwise(0.0)),
        (0.15, F.when(F.coalesce(captured_at, F.lit(0)) <= 0, 0.2).when(age <= 7 * _DAY, 1.0).when(age <= 30 * _DAY, 0.5).otherwise(0.15)),
        (0.20, F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))),
        (0.15, F.when(statuses == 0, 0.5).when(unhealthy > 0, F.greatest(F.lit(0.0), 1 - unhealthy / statuses)).when(all_fresh, 1.0).otherwise(0.7)),
        (0.05, F.when(filled(cwd) & filled(branch), 1.0).when(filled(cwd), 0.7).when(filled(branch), 0.5).otherwise(0.3)),
    ]
    total = F.lit(0.0)
    for weight, part in factors:
        total = total + F.round(F.lit(weight) * part, 4)
    total = F.round(total, 4)
    bad = unhealthy > 0
    level = (
        F.when(evidence == 0, "insufficient")
        .when(bad & (total < 0.55), "low")
        .when((total >= 0.72) & ~bad & ((evidence >= 2) | (total >= 0.78)), "high")
        .when(total >= 0.45, "medium")
        .otherwise("low")
    )
    return F.struct(level.alias("level"), F.when(evidence == 0, F.least(total, F.lit(0.2))).otherwise(total).alias("score"))


def conflicts(hits: DataFrame, key: str) -> DataFrame:
    """key, outcome_conflict, decision_conflict, all_stale of each group of hits (outcome, chosen, captured_at, id, status). Stale means every known status is unhealthy or idle."""
    known = F.col("status").isNotNull()
    g = hits.groupBy(key).agg(
        F.max((F.col("outcome") == "success").cast("int")).alias("_s"),
        F.max((F.col("outcome") == "failure").cast("int")).alias("_f"),
        F.min_by("chosen", F.when(F.col("chosen").isNotNull(), F.struct(F.coalesce("captured_at", F.lit(0)), "id"))).alias("_old"),
        F.max_by("chosen", F.when(F.col("chosen").isNotNull(), F.struct(F.coalesce("captured_at", F.lit(0)), "id"))).alias("_new"),
        F.count_if(known).alias("_n"),
        F.count_if(known & F.col("status").isin("stale", "suppressed_idle", "expected_absent", "unknown", "failing")).alias("_bad"),
    )
    return g.select(key, F.coalesce((F.col("_s") == 1) & (F.col("_f") == 1), F.lit(False)).alias("outcome_conflict"), F.coalesce(F.col("_old") != F.col("_new"), F.lit(False)).alias("decision_conflict"), ((F.col("_n") > 0) & (F.col("_n") == F.col("_bad"))).alias("all_stale"))


def parse_ranking(reply: Column, n: Column) -> Column:
    """Order of 1..n from a reply: the first [...] of numbers, repeats and others left out, those not named behind in order."""
    span = F.regexp_extract(reply, r"\[([^\]]*)\]", 1)
    named = F.filter(F.transform(F.regexp_extract_all(span, F.lit(r"\d+"), F.lit(0)), lambda x: F.try_to_number(x, F.lit("999999999")).cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= n))
    distinct = F.array_distinct(named)
    return F.concat(distinct, F.array_except(F.sequence(F.lit(1), n.cast("int")), distinct))


def check_model_drift(meta: DataFrame, model: str, column: str = "embed_model") -> None:
    """Refuses vectors of mixed or other models."""
    found = sorted(r[0] for r in meta.select(column).where(F.col(column).isNotNull()).distinct().limit(10).collect())
    if found and found != [model]:
        raise ValueError(f"vectors of {found}, not of {model}")
