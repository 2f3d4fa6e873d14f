"""Aggregates beyond built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts of a group's range that are counted before one of them is sorted.
PARTS = 4096


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The value at index round(share * (n - 1)) of the sorted group, halves to even; exact, not approximated. Null values are left out.

    Rows are counted by value, and a group's counts summed over PARTS equal parts of its range; only the part that holds the index is sorted.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    range_ = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_n"))
    wide = F.when(F.col("_hi") > F.col("_lo"), (F.col("_v").cast("double") - F.col("_lo").cast("double")) / (F.col("_hi").cast("double") - F.col("_lo").cast("double"))).otherwise(F.lit(0.0))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))
    placed = counts.alias("c").join(range_.alias("r"), same("c", "r")).select("c.*", "_lo", "_hi", "_n").withColumn("_part", F.floor(wide * PARTS))
    at = F.bround(F.lit(share) * (F.col("_n") - 1), 0).cast("bigint")
    parts = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_s"), F.first("_n").alias("_n"))
    summed = parts.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_s"))
    hit = summed.filter((F.col("_before") <= at) & (at < F.col("_before") + F.col("_s"))).select(*keys, "_part", (at - F.col("_before")).alias("_left"))
    inside = placed.alias("p").join(hit.alias("h"), same("p", "h") & (F.col("p._part") == F.col("h._part"))).select("p.*", "_left")
    ranked = inside.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v")) - F.col("_c"))
    return ranked.filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_c"))).select(*keys, F.col("_v").alias(name))


def diversity(items: DataFrame, key: str, kind: str, kinds: int, name: str = "diversity") -> DataFrame:
    """Shannon entropy of kinds in each group over log2 of the number of possible kinds."""
    n = items.groupBy(key, kind).agg(F.count("*").alias("_n"))
    total = n.groupBy(key).agg(F.sum("_n").alias("_t"), F.sum(F.col("_n") * F.log2(F.col("_n").cast("double"))).alias("_s"))
    entropy = F.log2(F.col("_t").cast("double")) - F.col("_s") / F.col("_t")
    return total.select(key, (F.round(entropy / F.log2(F.lit(float(kinds))), 6) + 0.0).alias(name))


def mean_pairwise_cosine(vectors: DataFrame, keys: list[str], vector: str, name: str) -> DataFrame:
    """Mean cosine of all pairs of a group in closed form: (|sum of unit vectors|^2 - non-zero vectors) / (n (n - 1)). Zero vectors have similarity 0; groups of one are null.

    Sums are taken by component, so nothing but one row for each group and component is shuffled.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.withColumn("_norm", norm).select(*keys, "_norm", F.posexplode(vector).alias("_p", "_x"))
    part = unit.groupBy(*keys, "_p").agg(F.sum(F.when(F.col("_norm") > 0, F.col("_x") / F.col("_norm")).otherwise(0.0)).alias("_s"), F.count("*").alias("_n"), F.count_if(F.col("_norm") > 0).alias("_z"))
    g = part.groupBy(*keys).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.max("_n").alias("_n"), F.max("_z").alias("_z"))
    return g.select(*keys, F.when(F.col("_n") > 1, F.round((F.col("_q") - F.col("_z")) / (F.col("_n") * (F.col("_n") - 1)), 6)).alias(name))


def promote(occurrences: DataFrame, keys: list[str], at: str, threshold: int) -> DataFrame:
    """Keys with their number, first and last time, as `lesson` from the threshold on and `pending` below. Null keys are empty text."""
    filled = occurrences.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], at)
    g = filled.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return g.withColumn("state", F.when(F.col("occurrences") >= threshold, "lesson").otherwise("pending"))


def flap_stats(alarms: DataFrame, keys: list[str]) -> DataFrame:
    """Alarms, the share that resolved by itself and the median time to that, cut to whole milliseconds."""
    took = F.col("resolved_at") - F.col("raised_at")
    g = alarms.groupBy(*keys).agg(F.count("*").alias("total"), F.count("resolved_at").alias("resolved"), F.median(took).alias("_m"))
    return g.select(*keys, "total", F.round(F.col("resolved") / F.col("total"), 6).alias("auto_resolved"), F.floor("_m").cast("bigint").alias("median_ms"))


def verdict(checks: list[tuple[str, Column, float | None, float | None]]) -> Column:
    """Names of failed checks (value, least, most), joined; a null value is skipped, no failure is `pass`."""
    fails = []
    for name, value, least, most in checks:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (value < least)
        if most is not None:
            bad = bad | (value > most)
        fails.append(F.when(F.coalesce(bad, F.lit(False)), name))
    found = F.array_compact(F.array(*fails))
    return F.when(F.size(found) == 0, "pass").otherwise(F.array_join(found, ","))


def histogram_quantile(buckets: DataFrame, keys: list[str], le: str, count: str, q: float, name: str) -> DataFrame:
    """Quantile of cumulative buckets by linear interpolation in the first that reaches the rank."""
    w = Window.partitionBy(*keys).orderBy(le)
    b = buckets.withColumn("_t", F.max(count).over(Window.partitionBy(*keys))).withColumn("_below", F.coalesce(F.lag(count).over(w), F.lit(0))).withColumn("_low", F.coalesce(F.lag(le).over(w), F.lit(0.0)))
    rank = F.lit(q) * F.col("_t")
    hit = b.filter((F.col(count) >= rank) & (F.col("_below") < rank))
    return hit.select(*keys, F.round(F.col("_low") + (F.col(le) - F.col("_low")) * (rank - F.col("_below")) / (F.col(count) - F.col("_below")), 6).alias(name))
