"""Work queues as transition functions: new state from old state and now."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STALE_LOCK_MS = 600_000


def claimable(now_ms: int, stale_ms: int = STALE_LOCK_MS) -> Column:
    """Pending, or processing with a lock at least stale_ms old; no lock counts as oldest."""
    return (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.coalesce("locked_at", F.lit(0)) <= now_ms - stale_ms))


def claim(queue: DataFrame, order: list[Column], cap: int, now_ms: int, worker: str, stale_ms: int = STALE_LOCK_MS, eligible: Column | None = None) -> DataFrame:
    """The claimed rows after their transition, at most `cap` in `order`; with `eligible`, only such rows are charged to the budget."""
    rows = queue.filter(claimable(now_ms, stale_ms))
    if eligible is not None:
        rows = rows.filter(eligible)
    return rows.orderBy(*order).limit(cap).withColumns({"status": F.lit("processing"), "locked_at": F.lit(now_ms).cast("bigint"), "locked_by": F.lit(worker)})


def reap(queue: DataFrame, now_ms: int, stale_ms: int = STALE_LOCK_MS) -> DataFrame:
    """Stale locks go back to pending with one more retry, or to failed."""
    stale = (F.col("status") == "processing") & (F.coalesce("locked_at", F.lit(0)) <= now_ms - stale_ms)
    after = F.when(F.col("retry_count") + 1 >= F.col("max_retries"), "failed").otherwise("pending")
    return queue.withColumn("_stale", stale).withColumns({"status": F.when(F.col("_stale"), after).otherwise(F.col("status")), "retry_count": F.col("retry_count") + F.col("_stale").cast("int"), "locked_at": F.when(~F.col("_stale"), F.col("locked_at"))})


def fail(queue: DataFrame, ids: DataFrame, key: str = "id", message: str = "failed") -> DataFrame:
    """The given rows after a failed attempt."""
    after = F.when(F.col("retry_count") + 1 >= F.col("max_retries"), "failed").otherwise("pending")
    return queue.join(ids.select(key), key, "left_semi").withColumns({"status": after, "retry_count": F.col("retry_count") + 1, "locked_at": F.lit(None).cast("bigint"), "error_message": F.substring(F.lit(message), 1, 512)})


def enqueue_decision(status: Column, same_hash: Column, updated_at: Column, now_ms: int, quiet_ms: int = 300_000) -> Column:
    """Whether a segment is put in the queue, and why not."""
    return F.when(status.isNull(), "yes").when(status == "processing", "processing").when(same_hash, "same_hash").when(F.lit(now_ms) - updated_at < quiet_ms, "too_soon").otherwise("yes")


def already_enriched(segments: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Segments whose hash equals that of their last enrichment and that have a node."""
    return segments.filter(F.col("content_hash") == F.col("enriched_hash")).join(links.select(key), key, "left_semi")


def settling_sweep(segments: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Segments with a changed hash and content whose queue row is missing or ended."""
    changed = segments.filter(~F.col("content_hash").eqNullSafe(F.col("enriched_hash")) & (F.col("message_count") > 0))
    j = changed.join(queue.select(key, F.col("status").alias("_s")), key, "left")
    return j.filter(F.col("_s").isNull() | F.col("_s").isin("done", "failed", "skipped")).drop("_s")


def rate_limited(alarms: DataFrame, key: str, at: str, window_ms: int) -> DataFrame:
    """Raised alarms that are kept: one that comes within window_ms of the last kept one of its key is dropped. Rows pass in order of key and time, and a task holds the last kept one only; a null time is dropped."""
    kinds = {f.name: f.dataType.simpleString() for f in alarms.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last, begun = None, 0, False
        for batch in batches:
            kept = []
            for i, (k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if not begun or k != of or t - last >= window_ms:
                    kept.append(i)
                    of, last, begun = k, t, True
            yield batch.take(pa.array(kept, pa.int64()))

    rows = alarms.filter(F.col(at).isNotNull()).select(key, at).repartition(key).sortWithinPartitions(key, at)
    return rows.mapInArrow(run, f"{key} {kinds[key]}, {at} {kinds[at]}")


def auto_resolve(ticks: DataFrame, keys: list[str], tick: str, violated: str, clean: int = 2) -> DataFrame:
    """keys, tick at which an alarm resolves: the clean-th tick in a row without violation after one with it."""
    w = Window.partitionBy(*keys).orderBy(tick)
    runs = ticks.withColumn("_run", F.sum(F.col(violated).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(tick)) - 1
    return runs.withColumn("_n", n).filter((F.col("_run") > 0) & ~F.col(violated) & (F.col("_n") == clean)).select(*keys, tick)


def acknowledge(alarms: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    """acked_at of the given alarms, if not set."""
    hit = alarms.join(ids.select("id").withColumn("_a", F.lit(True)), "id", "left")
    return hit.withColumn("acked_at", F.when(F.col("_a"), F.coalesce("acked_at", F.lit(now_ms))).otherwise(F.col("acked_at"))).drop("_a")


def prune_alarms(alarms: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """Without alarms resolved longer ago than keep_ms."""
    return alarms.filter(F.col("resolved_at").isNull() | (F.col("resolved_at") >= now_ms - keep_ms))
