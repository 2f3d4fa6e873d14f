"""Join operators that Spark has no fast path of its own for: binned range and overlap joins, cascades, division, pairing, watermarks, reachability."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.sources.store import checkpointed


#: How many bins of one level make one of the next. A span is put at the level where it touches FAN + 1 bins at most.
FAN = 16


def _level(start: str, end: str, width: int) -> Column:
    span = F.greatest((F.col(end) - F.col(start)) / width, F.lit(1.0))
    return F.greatest(F.ceil(F.log(span) / math.log(FAN)) - 1, F.lit(0)).cast("int")


def _bins(start: Column, end: Column, width: int, level: Column) -> Column:
    w = F.lit(width) * F.pow(F.lit(float(FAN)), level).cast("bigint")
    return F.sequence(F.floor(start / w), F.floor(end / w))


def _levels(spans: DataFrame, start: str, end: str, width: int) -> list[int]:
    """The levels that spans are at: their number grows with the logarithm of the longest."""
    return sorted(r[0] for r in spans.filter(F.col(end) >= F.col(start)).select(_level(start, end, width)).distinct().collect())


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """Rows of left whose `at` lies in [start, end] of a row of right, with equal `keys`.

    Both are put in bins, so the join is an equality join with a residual condition. Bins have `width` at the lowest level and FAN times more at each next one; a
    right row goes to the few bins that it touches at the level of its length, a left row to its bin at each level in use. Equal keys keep bins small; without them a hot bin is split by adaptive execution.
    """
    keys = keys or []
    levels = _levels(right, start, end, width)
    places = F.array(*[F.struct(F.lit(n).alias("l"), F.floor(F.col(at) / (width * FAN**n)).alias("b")) for n in levels]).cast("array<struct<l:int,b:bigint>>")
    a = left.withColumn("_p", F.explode(places)).withColumns({"_l": F.col("_p.l"), "_bin": F.col("_p.b")}).drop("_p")
    b = right.filter(F.col(end) >= F.col(start)).withColumn("_l", _level(start, end, width)).withColumn("_bin", F.explode(_bins(F.col(start), F.col(end), width, F.col("_l"))))
    return a.join(b, [*keys, "_l", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_l", "_bin")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose spans overlap, ends included.

    Two spans meet at the level of the longer one, where both touch few bins: each row goes to the bins of its own level and of the levels above in use. A pair is taken in the first bin that both touch, so each comes once.
    """
    keys = keys or []
    (ls, le), (rs, re_) = left_span, right_span
    levels = sorted({*_levels(left, ls, le, width), *_levels(right, rs, re_, width)})

    def posted(df: DataFrame, s: str, e: str, own: str) -> DataFrame:
        made = df.filter(F.col(e) >= F.col(s)).withColumn(own, _level(s, e, width))
        used = F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n >= F.col(own))
        made = made.withColumn("_l", F.explode(used))
        return made.withColumn("_bin", F.explode(_bins(F.col(s), F.col(e), width, F.col("_l"))))

    both = posted(left, ls, le, "_la").join(posted(right, rs, re_, "_lb"), [*keys, "_l", "_bin"])
    first = F.floor(F.greatest(ls, rs) / (F.lit(width) * F.pow(F.lit(float(FAN)), F.col("_l")).cast("bigint")))
    met = (F.col("_l") == F.greatest("_la", "_lb")) & (F.col("_bin") == first)
    return both.filter(met & (F.col(ls) <= F.col(re_)) & (F.col(rs) <= F.col(le))).drop("_l", "_la", "_lb", "_bin")


def dealt_join(left: DataFrame, right: DataFrame, key: str, parts: int) -> DataFrame:
    """Inner join of two large tables, both dealt by the key to so many parts and merged in its order. Adaptive execution goes by file sizes and may hand one whole to every task, which then holds it."""
    return left.repartition(parts, key).hint("merge").join(right.repartition(parts, key), key)


def cascading_join(left: DataFrame, exact: DataFrame, fallback: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """For each key of left the rows of `exact`, or those of `fallback` where there are none; at most `limit` in `order`."""
    found = left.select(key).distinct().join(exact, key)
    rest = left.select(key).distinct().join(exact.select(key).distinct(), key, "left_anti").join(fallback, key)
    both = found.withColumn("exact", F.lit(True)).unionByName(rest.withColumn("exact", F.lit(False)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def solely_linked(links: DataFrame, given: DataFrame, node: str, target: str) -> DataFrame:
    """Nodes all of whose links lead into `given` (a table with the target column): division by one aggregate pass."""
    marked = links.join(given.select(target).distinct().withColumn("_in", F.lit(1)), target, "left")
    return marked.groupBy(node).agg(F.count("*").alias("_n"), F.count("_in").alias("_k")).filter("_n = _k").select(node)


def union_of_semi_joins(nodes: DataFrame, node: str, families: list[DataFrame]) -> DataFrame:
    """Nodes that have a link in at least one family (tables with the node column)."""
    return nodes.join(reduce(DataFrame.unionByName, [f.select(node) for f in families]).distinct(), node, "left_semi")


def eligible_nodes(nodes: DataFrame, node: str, families: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Nodes without any link, or with an eligible one. Each family is its links with the columns that its condition reads.

    One aggregate over all links says whether a node has links and whether one is eligible.
    """
    flags = reduce(DataFrame.unionByName, [df.select(node, F.coalesce(ok, F.lit(False)).alias("_ok")) for df, ok in families])
    seen = flags.groupBy(node).agg(F.max("_ok").alias("_ok"))
    return nodes.join(seen, node, "left").filter(F.coalesce("_ok", F.lit(True))).drop("_ok")


def noise_nodes(nodes: DataFrame, node: str, families: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Nodes with links of which none is eligible."""
    flags = reduce(DataFrame.unionByName, [df.select(node, F.coalesce(ok, F.lit(False)).alias("_ok")) for df, ok in families])
    return nodes.join(flags.groupBy(node).agg(F.max("_ok").alias("_ok")).filter("NOT _ok").select(node), node, "left_semi")


def pair_requests(uses: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Request and response pairs of equal keys: uses(use_ord, use_ts), results(res_ord, res_ts); the response comes later. Unmatched requests are dropped, negative durations are 0."""
    return uses.join(results, keys).filter("res_ord > use_ord").withColumn("duration_ms", F.greatest(F.col("res_ts") - F.col("use_ts"), F.lit(0)))


def newer_than_stored(source: DataFrame, stored: DataFrame, key: str, updated: str, mark: str, busy: DataFrame) -> DataFrame:
    """Rows that are new or were updated after the stored mark, but not those being processed."""
    joined = source.join(stored.select(key, F.col(mark).alias("_mark")), key, "left").filter(F.col("_mark").isNull() | (F.col(updated) > F.col("_mark"))).drop("_mark")
    return joined.join(busy.select(key), key, "left_anti")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from `start` (column node) over edges (src, dst): frontier joins until no node is new, as many as the longest shortest path has edges. Each round's nodes are stored."""
    frontier = checkpointed(start.select("node").distinct())
    seen = frontier
    while not frontier.isEmpty():
        news = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpointed(news.join(seen, "node", "left_anti"))
        seen = checkpointed(seen.unionByName(frontier).coalesce(max(1, edges.sparkSession.sparkContext.defaultParallelism)))
    return seen


def coverage_classes(wanted: DataFrame, stored: DataFrame, in_flight: DataFrame, key: str) -> DataFrame:
    """Each wanted key as stored, in_flight or missing."""
    j = wanted.select(key).join(stored.select(key).distinct().withColumn("_s", F.lit(True)), key, "left").join(in_flight.select(key).distinct().withColumn("_f", F.lit(True)), key, "left")
    return j.select(key, F.when(F.col("_s"), "stored").when(F.col("_f"), "in_flight").otherwise("missing").alias("status"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two keyed tables: same, changed, left_only or right_only."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_la")), right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_rb"))
    status = F.when(F.col("_rb").isNull(), "left_only").when(F.col("_la").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))
