"""Sharding by jump consistent hashing, with DataFrame functions only.

The law is `key`: a document's id and the number of shards decide. There is no
ring table, and with one more shard documents move into that shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the published algorithm: its linear congruential generator.
MULTIPLIER = "2862933555777941757"
#: Rows of one shard that one task numbers.
ROWS = 500_000


def _jump(key: str, shards: int) -> Column:
    """Jump consistent hash of the decimal column `key` (0 to 2^64 - 1), as an SQL fold: at most one jump for each shard.

    Products modulo 2^64 are taken from 32-bit halves in decimals, which cannot overflow.
    """
    top, half = "18446744073709551616BD", "4294967296BD"
    k = "CAST(s.k AS DECIMAL(38,0))"
    high, low = f"CAST(floor({k} / {half}) AS DECIMAL(20,0))", f"CAST({k} % {half} AS DECIMAL(11,0))"
    times = f"CAST({MULTIPLIER}BD AS DECIMAL(19,0))"
    step = f"CAST((CAST(({high} * {times}) % {half} AS DECIMAL(11,0)) * {half} + {low} * {times} + 1BD) % {top} AS DECIMAL(20,0))"
    fold = f"""aggregate(sequence(1, {shards}),
        named_struct('b', -1L, 'j', 0L, 'k', CAST({key} AS DECIMAL(20,0))),
        (s, i) -> IF(s.j >= {shards}L, s, transform(array({step}), n -> named_struct(
            'b', s.j,
            'j', CAST(floor((s.j + 1) * (2147483648D / (CAST(floor(CAST(n AS DECIMAL(38,0)) / 8589934592BD) AS DOUBLE) + 1D))) AS BIGINT),
            'k', n))[0]),
        s -> CAST(s.b AS INT))"""
    return F.expr(fold)


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    A null text has size 1 and the crc32 of no bytes, 0; a null id hashes as empty text; repeated ids share a shard.
    Slots have no gaps: rows are dealt to buckets by a hash of the row, numbered in each bucket, and a bucket starts where the one before it ended.
    """
    raw = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    key = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    placed = slim.withColumn("_key", key).withColumn("shard", _jump("_key", shards)).withColumn("grown_shard", _jump("_key", shards + 1))
    buckets = max(1, -(-docs.count() // (shards * rows_per_task)) * 4)
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))).drop("_key")
    counts = placed.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    rank = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("_rank", F.row_number().over(rank) - 1)
    return numbered.join(starts, ["shard", "_bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_rank")).cast("bigint").alias("slot"), "grown_shard"
    )
