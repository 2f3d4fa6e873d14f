"""Exact deduplication by distributed most-significant-digit radix partitioning.

Documents are split by their length and first bytes, then the groups that remain
are split again by their next bytes, in digits that get longer, until a group has one
member or its texts have ended. Bytes decide equality, not digests. After the first
round only documents that still share a group move on.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, stage_table

SPACE = r"[\x20\x09-\x0D]+"
FIRST_DIGIT = 64
GROWTH = 4


def normalized(text: Column) -> Column:
    """White-space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), first: int = FIRST_DIGIT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns of `carry` in a struct of that name.

    Of equal texts the row with the smallest id stays (null ids come last; of repeated ids one row stays). A null text equals an empty one.
    One group may hold any share of the rows: it is counted before rows are shuffled, and its rows are joined to a single row, which adaptive execution splits.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")).alias("_carry"),
        F.encode(normalized(F.col(text_col)), "UTF-8").alias("_body"),
    )
    keyed = rows.withColumn("_n", F.octet_length("_body")).withColumn("_digit", F.expr(f"substring(_body, 1, {first})"))
    groups = materialize(keyed.groupBy("_n", "_digit").agg(F.count("*").alias("_c")).filter("_c > 1").select("_n", "_digit", F.monotonically_increasing_id().alias("_g")))
    table = stage_table(
        keyed.join(groups, ["_n", "_digit"], "left").select(
            "_id",
            "_carry",
            "_n",
            "_g",
            F.monotonically_increasing_id().alias("_rid"),
            F.sha2("_body", 256).alias("_sha"),
            F.when(F.col("_g").isNotNull(), F.expr(f"substring(_body, {first + 1})")).alias("_rest"),
        )
    )
    own = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))
    done = [table.filter("_g IS NULL").select("_id", "_carry", "_sha", "_rid", F.lit(1).cast("bigint").alias("_c"), own.alias("_k"))]
    active = table.filter("_g IS NOT NULL")
    used, width = first, first * (GROWTH * GROWTH - 1)
    while not active.isEmpty():
        split = active.withColumn("_digit", F.expr(f"substring(_rest, 1, {width})"))
        parts = split.groupBy("_g", "_digit").agg(F.count("*").alias("_c"), F.min(own).alias("_k"))
        parts = materialize(parts.withColumn("_h", F.monotonically_increasing_id()))
        over = (F.col("_c") == 1) | (F.col("_n") <= used + width)
        table = stage_table(
            split.join(parts, ["_g", "_digit"]).select(
                "_id", "_carry", "_n", "_rid", "_sha", "_c", "_k", F.col("_h").alias("_g"), over.alias("_over"), F.when(~over, F.expr(f"substring(_rest, {width + 1})")).alias("_rest")
            )
        )
        done.append(table.filter("_over").select("_id", "_carry", "_sha", "_rid", "_c", "_k"))
        active = table.filter("NOT _over").drop("_c", "_k", "_over")
        used, width = used + width, width * GROWTH
    out = reduce(DataFrame.unionByName, done)
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_k.id").alias("keep_id"),
        F.col("_c").alias("group_size"),
        (F.col("_rid") == F.col("_k.rid")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *([F.col("_carry").alias("carry")] if carry else []),
    )
