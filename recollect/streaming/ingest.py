"""Structured Streaming forms: deduplication in a window, session windows, rolling counts and micro-batch flushes.

Each has the batch form's result over bounded input, which the tests hold it to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from recollect.operators.health import update_health
from recollect.sources.catalog import epoch_ms

LATENESS = "2 minutes"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream. Back-pressure is the number of files in a trigger; nothing is dropped."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("timestamp", epoch_ms("ts")).withColumn("time", F.timestamp_millis("timestamp"))


def deduplicated(events: DataFrame, key: list[str], window: str = LATENESS) -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return events.withWatermark("time", window).dropDuplicatesWithinWatermark(key)


def closed_sessions(events: DataFrame, key: str, gap: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions by gap, given out once the watermark has passed their end."""
    w = F.session_window("time", gap)
    g = events.withWatermark("time", lateness).groupBy(key, w).agg(F.count("*").alias("n"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return g.select(key, "start_time", "end_time", "n")


def pane_counts(events: DataFrame, slide: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """source, pane_end, n: counts of tumbling panes, given out once final. An event is counted once."""
    g = events.withWatermark("time", lateness).groupBy(F.window("time", slide), F.col("event_type").alias("source")).agg(F.count("*").alias("n"))
    return g.select("source", F.unix_millis("window.end").alias("pane_end"), "n")


def sliding_counts(panes: DataFrame, until: int, length_ms: int = 86_400_000, slide_ms: int = 300_000) -> DataFrame:
    """window_end, source, n of all windows of length_ms that end at most `until` and hold an event, from counts of panes.

    A pane adds its count at its own end and takes it back a length later; running sums over these changes are the counts until the next change.
    Rows that are shuffled follow the panes, whose number follows time and not events.
    """
    changes = panes.select("source", F.explode(F.array(F.struct(F.col("pane_end").alias("at"), F.col("n").alias("d")), F.struct((F.col("pane_end") + length_ms).alias("at"), (-F.col("n")).alias("d")))).alias("c"))
    changes = changes.groupBy("source", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("d"))
    w = Window.partitionBy("source").orderBy("at")
    steps = changes.select("source", "at", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.least(F.coalesce(F.lead("at").over(w), F.col("at") + slide_ms) - slide_ms, F.lit(until)).alias("last"))
    steps = steps.filter((F.col("n") > 0) & (F.col("at") <= F.col("last")))
    return steps.select(F.explode(F.sequence("at", "last", F.lit(slide_ms))).alias("window_end"), "source", "n")


def flush(events: DataFrame, store: Callable[[DataFrame, int], None], health: Callable[[int], DataFrame], save_health: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Micro-batches go to `store`; what `health` gives for earlier epochs is merged with each and saved. A batch that `store` refuses raises the sources' failure counters, and the query stops with the error, so the checkpoint replays it."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("source", F.col("event_type")).persist()
        try:
            news = rows.select("source", "timestamp")
            try:
                store(rows, epoch)
            except Exception as e:
                save_health(update_health(health(epoch), news.limit(0), news.select("source").distinct().withColumn("message", F.lit(str(e)[:512]))), epoch)
                raise
            save_health(update_health(health(epoch), news), epoch)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(batch)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """All that is available and final, as a Parquet table under `folder`, where the checkpoint lies too."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


class StoredHealth:
    """Health rows under a folder, a table for each epoch; the last epoch's hold. A replayed epoch replaces its own."""

    SCHEMA = "source string, last_event_ts bigint, events bigint, consecutive_failures int, last_error_msg string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.save(spark.createDataFrame([], self.SCHEMA), -1)

    def load(self, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.SCHEMA}, epoch bigint").parquet(self.folder)
        if before is not None:
            rows = rows.filter(F.col("epoch") < before)
        last = rows.agg(F.max("epoch")).first()[0]
        return rows.filter(F.col("epoch") == (-1 if last is None else last)).drop("epoch")

    def save(self, health: DataFrame, epoch: int) -> None:
        health.write.mode("overwrite").parquet(f"{self.folder}/epoch={epoch}")
