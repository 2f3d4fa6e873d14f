"""Retrieval and output quality metrics as aggregates. Undefined metrics are null, so means skip them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_aggregates(ranks: DataFrame, key: str, hits: tuple[int, ...] = (1, 3, 5, 10), k: int = 10) -> DataFrame:
    """Means over items of hits within ranks, reciprocal rank and binary NDCG; a null rank is a miss."""
    near = F.coalesce(F.col("rank") <= k, F.lit(False))
    means = [F.round(F.avg(F.coalesce(F.col("rank") <= h, F.lit(False)).cast("int")), 6).alias(f"hit_{h}") for h in hits]
    mrr = F.round(F.avg(F.when(near, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    ndcg = F.round(F.avg(F.when(near, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)), 6).alias(f"ndcg_{k}")
    return ranks.groupBy(key).agg(*means, mrr, ndcg)


def ir_metrics(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, recall, mrr, ndcg from results (query_id, id, rank) and graded labels (query_id, id, gain). Queries without labels have null metrics."""
    joined = results.filter(F.col("rank") <= k).join(relevant, ["query_id", "id"], "left")
    got = joined.groupBy("query_id").agg(F.count("gain").alias("_found"), F.min(F.when(F.col("gain").isNotNull(), F.col("rank"))).alias("_first"), F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("rank") + 1.0)).alias("_dcg"))
    best = relevant.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")))
    ideal = best.groupBy("query_id").agg(F.count("*").alias("_all"), F.sum(F.when(F.col("_r") <= k, F.col("gain") / F.log2(F.col("_r") + 1.0)).otherwise(0.0)).alias("_ideal"))
    j = got.join(ideal, "query_id", "left")
    defined = F.col("_all") > 0
    return j.select(
        "query_id",
        F.round(F.when(defined, F.col("_found") / F.col("_all")), 6).alias("recall"),
        F.round(F.when(defined, F.coalesce(1.0 / F.col("_first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.when(defined & (F.col("_ideal") > 0), F.col("_dcg") / F.col("_ideal")), 6).alias("ndcg"),
    )


def golden_ranks(results: DataFrame, golden: DataFrame) -> DataFrame:
    """qa_id and the first rank whose linked ids hold the golden id; null if none does."""
    hit = results.join(golden, "qa_id").filter(F.array_contains("linked", F.col("golden"))).groupBy("qa_id").agg(F.min("rank").alias("rank"))
    return golden.select("qa_id").join(hit, "qa_id", "left")


def determinism(runs: DataFrame, model: str, metric_budgets: dict[str, float]) -> DataFrame:
    """Models with two runs or more: spread of each metric and whether all are within budget; a missing metric fails the model."""
    aggs = [F.count("*").alias("runs")]
    ok = F.lit(True)
    for m, budget in metric_budgets.items():
        aggs += [F.round(F.max(m) - F.min(m), 6).alias(f"{m}_spread"), F.count_if(F.col(m).isNull()).alias(f"_{m}")]
        ok = ok & (F.col(f"_{m}") == 0) & (F.col(f"{m}_spread") <= budget)
    g = runs.groupBy(model).agg(*aggs).filter("runs >= 2")
    return g.select(model, "runs", *[f"{m}_spread" for m in metric_budgets], F.coalesce(ok, F.lit(False)).alias("passed"))


def evidence_check(hits: Column, least: int, most: int | None, kinds: Column, required: list[str], distinct: int, dated: Column) -> Column:
    """The first failed expectation of a question's evidence, or `ok`."""
    out = F.when(hits < least, "too few hits")
    if most is not None:
        out = out.when(hits > most, "too many hits")
    if required:
        out = out.when(F.size(F.array_except(F.array(*[F.lit(k) for k in required]), kinds)) > 0, "missing source kind")
    return out.when(F.size(kinds) < distinct, "too few source kinds").when(~dated, "missing captured_at").otherwise("ok")


def qa_sample(items: DataFrame, order: str, n: int, seed: int, size: int) -> DataFrame:
    """Items (seed + i) mod size for i below n, by position in `order`. `size` is the number of items, a small fixture."""
    at = F.row_number().over(Window.orderBy(order)) - 1
    wanted = [(seed + i) % size for i in range(min(n, size))]
    return items.withColumn("_i", at).filter(F.col("_i").isin(*wanted)).drop("_i")


def ask_sample(items: DataFrame, answer: Callable[[Column], Column], n: int, seed: int) -> DataFrame:
    """sampled, keyword_hit_rate over the items (qa_id, question, keywords) at (seed + i) modulo their number for i below n, in order of qa_id: an item may be taken more than once.

    A hit is an answer in which any keyword stands, in either case. No items, or n of zero, give a rate of 0.
    """
    size = items.count() if n > 0 else 0
    if not size:
        return items.sparkSession.createDataFrame([(0, 0.0)], "sampled int, keyword_hit_rate double")
    at = F.row_number().over(Window.orderBy("qa_id")) - 1  # a small fixture
    since = F.pmod(at - F.lit(seed), F.lit(size))
    times = F.when(since < n, F.floor((F.lit(n - 1) - since) / size) + 1).otherwise(0)
    reply = F.lower(F.coalesce(answer(F.col("question")), F.lit("")))
    hit = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.contains(reply, F.lower(k)))
    taken = items.withColumn("_times", times).filter("_times > 0")
    return taken.agg(F.lit(n).alias("sampled"), (F.sum(F.when(hit, F.col("_times")).otherwise(0)) / n).alias("keyword_hit_rate"))
