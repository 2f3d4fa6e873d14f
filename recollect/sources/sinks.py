"""Sinks and replays: fallback files by UTC day, training sets, dashboards, Markdown, integrity of stored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_fallback(rows: DataFrame, path: str, at: str = "timestamp") -> None:
    """JSON lines, one folder for each UTC day."""
    rows.withColumn("day", utc_day(F.col(at))).write.mode("append").partitionBy("day").json(path)


def utc_day(ms: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int")), "yyyy-MM-dd")


def replay_fallback(spark: SparkSession, path: str, schema: str, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, lines kept as failed): envelopes that the store lacks, each once."""
    raw = spark.read.text(path).select("value").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    good = raw.filter(F.col(f"row.{key}").isNotNull()).select("row.*")
    fresh = good.join(stored.select(key), key, "left_anti").dropDuplicates([key])
    return fresh, raw.filter(F.col(f"row.{key}").isNull()).select("value")


def hash_split(key: Column, seed: int = 0) -> Column:
    """train, valid or test (80, 10, 10) by a portable hash of the key, so a row's split never changes."""
    n = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(n < 8, "train").when(n == 8, "valid").otherwise("test")


def chat_triples(nodes: DataFrame, prompts: DataFrame, key: str) -> DataFrame:
    """key, messages (JSON of system, user and assistant turns), split."""
    j = nodes.join(prompts, key)
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    chat = F.array(turn("system", F.lit("Summarise the activity.")), turn("user", F.col("prompt")), turn("assistant", F.col("answer")))
    return j.select(key, F.to_json(F.struct(chat.alias("messages"))).alias("messages"), hash_split(F.col(key)).alias("split"))


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status of files (name, content) against a manifest (name, sha256): ok, changed or missing."""
    have = files.select("name", F.sha2("content", 256).alias("_h"))
    return manifest.join(have, "name", "left").select("name", F.when(F.col("_h").isNull(), "missing").when(F.col("_h") == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def ingest_results(lines: DataFrame, column: str, schema: str, keys: list[str], order: str) -> DataFrame:
    """Rows of JSON lines: malformed lines and null keys are left out, the latest of equal keys stays."""
    rows = lines.select(order, F.from_json(column, schema).alias("r")).select(order, "r.*").dropna(subset=keys)
    fields = [c for c in rows.columns if c not in (*keys, order)]
    return rows.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in fields])


def dashboard(rows: DataFrame, key: str) -> DataFrame:
    """One JSON text for each key, of all other columns."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def scorecard(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table row for each row."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("line"), *columns[:1])
