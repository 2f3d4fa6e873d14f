"""Sessionisation and other order-dependent logic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP_MS = 60_000
SEGMENT_GAP_MS, SEGMENT_CHARS = 300_000, 12_000


def gap_sessions(events: DataFrame, key: str, at: str, gap_ms: int, tie: str = "id", name: str = "chunk") -> DataFrame:
    """Adds the number of the session: a new one where the gap is more than gap_ms; exactly the gap stays together."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap_ms).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def capped_sessions(events: DataFrame, key: str, at: str, gap_ms: int, most: int, tie: str = "id") -> DataFrame:
    """Sessions of at most `most` events: run of the gap rule, and piece in it. A key with no more than `most` events is one chunk, gaps or not."""
    runs = gap_sessions(events, key, at, gap_ms, tie, "run")
    rank = F.row_number().over(Window.partitionBy(key, "run").orderBy(at, tie)) - 1
    total = F.count("*").over(Window.partitionBy(key))
    small = total <= most
    cut = runs.withColumn("_small", small).withColumn("_piece", F.floor(rank / most))
    return cut.withColumn("run", F.when(F.col("_small"), F.lit(0)).otherwise(F.col("run")).cast("bigint")).withColumn("piece", F.when(F.col("_small"), F.lit(0)).otherwise(F.col("_piece")).cast("bigint")).drop("_small", "_piece")


def segments(turns: DataFrame, key: str = "conv_id", gap_ms: int | None = SEGMENT_GAP_MS, chars: int = SEGMENT_CHARS, size: Column | None = None) -> DataFrame:
    """Transcript segments: a user turn opens one when the gap to the last user turn is over gap_ms, or the segment has more than `chars` characters.

    The running sum starts anew with each segment, which no window expresses: a fold over each transcript, sorted in SQL; one transcript is in one task.
    Output: key, segment, start_time, end_time, messages, chars.
    """
    size = F.length("text") if size is None else size
    rows = turns.select(key, "turn", "role", "timestamp", F.coalesce(size, F.lit(0)).alias("n"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, now, last_user = [], None, None
        for r in pdf.sort_values("turn", kind="stable").itertuples(index=False):
            if now is None:
                now = [r.timestamp, r.timestamp, 0, 0]
            elif r.role == "user":
                far = gap_ms is not None and last_user is not None and r.timestamp - last_user > gap_ms
                if far or now[3] > chars:
                    out.append(now)
                    now = [r.timestamp, r.timestamp, 0, 0]
            if r.role == "user":
                last_user = r.timestamp
            now[1], now[2], now[3] = max(now[1], r.timestamp), now[2] + 1, now[3] + int(r.n)
        if now is not None:
            out.append(now)
        out = [s for s in out if s[2]]
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(out), "segment": range(len(out)), "start_time": [s[0] for s in out], "end_time": [s[1] for s in out], "messages": [s[2] for s in out], "chars": [s[3] for s in out]})

    kind = turns.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fold, f"{key} {kind}, segment int, start_time bigint, end_time bigint, messages bigint, chars bigint")


def collapse_trailing_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of a run of equal values at the end of each key only the first row stays."""
    w = Window.partitionBy(key).orderBy(order)
    later = Window.partitionBy(key).orderBy(F.desc(order))
    same = F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)
    differs = F.max(F.when(~F.col(value).eqNullSafe(F.col("_last")), 1).otherwise(0)).over(later.rowsBetween(Window.unboundedPreceding, 0))
    last = F.first(value).over(later)
    return df.withColumn("_last", last).withColumn("_same", same).withColumn("_differs", differs).filter(~(F.col("_same") & (F.col("_differs") == 0))).drop("_last", "_same", "_differs")


def number_revisions(revisions: DataFrame, doc: str, at: str, tie: str = "id") -> DataFrame:
    return revisions.withColumn("revision_number", F.row_number().over(Window.partitionBy(doc).orderBy(at, tie)).cast("bigint"))


def prune_revisions(revisions: DataFrame, doc: str, at: str, protected: Column, now_ms: int, max_age_ms: int, max_count: int, tie: str = "id") -> DataFrame:
    """Revisions to delete: unprotected ones older than max_age_ms, then the oldest unprotected until max_count stay."""
    r = revisions.withColumn("_p", protected).withColumn("_old", ~F.col("_p") & (F.col(at) < now_ms - max_age_ms))
    w = Window.partitionBy(doc)
    r = r.withColumn("_left", F.count_if(~F.col("_old")).over(w))
    free = ~F.col("_p") & ~F.col("_old")
    r = r.withColumn("_rank", F.sum(free.cast("int")).over(w.orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)))
    return r.filter(F.col("_old") | (free & (F.col("_rank") <= F.col("_left") - max_count))).drop("_p", "_old", "_left", "_rank")


def stratified_sample(df: DataFrame, strata: list[str], key: Column, per: int) -> DataFrame:
    """`per` rows of each stratum in the order of a hash of the key: the same rows whatever the partitioning."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).filter(F.col("_n") <= per).drop("_n")


def positional_scores(ranked: DataFrame, order: list[Column], name: str = "score") -> DataFrame:
    """1 - rank / n by position. For results that are cut already: the window is one task."""
    w = Window.orderBy(*order)
    return ranked.withColumn(name, F.round(1 - (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy()), 6))


