"""Registered aggregates, set operations, windows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import RULES
from recollect.operators import aggregates as A
from recollect.operators import sessions as S
from recollect.sources.catalog import parts, role, with_roles

from .registry import register

_T0 = 1_706_659_200_000


@register("d1_status_totals", with_roles("ev_user", "SELECT count(*) AS total, count(*) FILTER (enriched) AS enriched, count(*) FILTER (exit_code = 1) AS failed FROM ev_user"))
def d1(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev_user").agg(F.count("*").alias("total"), F.count_if(F.col("enriched")).alias("enriched"), F.count_if(F.col("exit_code") == 1).alias("failed"))


@register("d4_rolling_counts", with_roles("ev_user", f"SELECT source_kind AS source, count(*) FILTER (timestamp > {_T0} - 3600000) AS last_1h, count(*) FILTER (timestamp > {_T0} - 86400000) AS last_24h FROM ev_user GROUP BY source_kind"))
def d4(spark: SparkSession, d: str) -> DataFrame:
    return rolling_counts(role(spark, d, "ev"), _T0)


def rolling_counts(events: DataFrame, now_ms: int, with_probes: bool = False) -> DataFrame:
    e = events if with_probes else events.filter("probe_tag IS NULL")
    return e.groupBy(F.col("source_kind").alias("source")).agg(F.count_if(F.col("timestamp") > now_ms - 3_600_000).alias("last_1h"), F.count_if(F.col("timestamp") > now_ms - 86_400_000).alias("last_24h"))


@register("d5_idle_sessions", with_roles("ev_user", f"SELECT session_id, min(timestamp) AS first, max(timestamp) AS last, count(*) AS n FROM ev_user GROUP BY session_id HAVING max(timestamp) < {_T0 - 3600000 * 12}"))
def d5(spark: SparkSession, d: str) -> DataFrame:
    g = role(spark, d, "ev_user").groupBy("session_id").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n"))
    return g.filter(F.col("last") < _T0 - 3_600_000 * 12)


@register("d6_fair_order", with_roles("sessions_user", "SELECT cwd, min(start_time) AS first, count(*) AS n FROM sessions_user GROUP BY cwd ORDER BY first"))
def d6(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "sessions_user").groupBy("cwd").agg(F.min("start_time").alias("first"), F.count("*").alias("n")).orderBy("first")


@register("d7_duplicate_groups", with_roles("nodes", "SELECT min(id) AS survivor, count(*) AS n FROM nodes GROUP BY content, embed_text, node_type HAVING count(*) > 1"))
def d7(spark: SparkSession, d: str) -> DataFrame:
    g = role(spark, d, "nodes").groupBy("content", "embed_text", "node_type").agg(F.min("id").alias("survivor"), F.count("*").alias("n"))
    return g.filter("n > 1").select("survivor", "n")


_D9 = """SELECT m.model, round(avg(m.mrr), 6) AS avg_mrr, round(avg(m.hit), 6) AS hit_at_1, count(*) AS n FROM (
    SELECT run_id, name AS model, 1.0 / (id % 4 + 1) AS mrr, CAST(id % 4 = 0 AS INTEGER) AS hit FROM jobs) m
    WHERE m.run_id = (SELECT max(r.id) FROM runs r WHERE r.id IN (SELECT run_id FROM jobs)) GROUP BY m.model"""


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Mean metrics of each model in the latest run that has data."""
    facts = role(spark, d, "jobs").select("run_id", F.col("name").alias("model"), (1.0 / (F.col("id") % 4 + 1)).alias("mrr"), (F.col("id") % 4 == 0).cast("int").alias("hit"))
    runs = role(spark, d, "runs").select(F.col("id").alias("run_id")).join(facts.select("run_id"), "run_id", "left_semi").agg(F.max("run_id").alias("run_id"))
    latest = facts.join(F.broadcast(runs), "run_id", "left_semi")  # one row
    return latest.groupBy("model").agg(F.round(F.avg("mrr"), 6).alias("avg_mrr"), F.round(F.avg("hit"), 6).alias("hit_at_1"), F.count("*").alias("n"))


@register("d9_latest_leaderboard", with_roles("runs jobs", _D9))
def d9(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard(spark, d)


@register("n24_leaderboard", with_roles("runs jobs", _D9))
def n24(spark: SparkSession, d: str) -> DataFrame:
    return leaderboard(spark, d)


@register("d10_orphan_backlog", with_roles("runs node_runs", "SELECT count(*) AS n, min(started_at) AS oldest FROM runs r WHERE NOT EXISTS (SELECT 1 FROM node_runs l WHERE l.run_id = r.id)"))
def d10(spark: SparkSession, d: str) -> DataFrame:
    l = role(spark, d, "node_runs").select(F.col("run_id").alias("id"))
    return role(spark, d, "runs").join(l, "id", "left_anti").agg(F.count("*").alias("n"), F.min("started_at").alias("oldest"))


_D11 = "SELECT coalesce(git_repo, '') AS git_repo, source_kind, cwd, count(*) AS occurrences, min(timestamp) AS first_seen, max(timestamp) AS last_seen, CASE WHEN count(*) >= 60 THEN 'lesson' ELSE 'pending' END AS state FROM ev_user GROUP BY 1, 2, 3"


@register("d11_promotion", with_roles("ev_user", _D11))
def d11(spark: SparkSession, d: str) -> DataFrame:
    return A.promote(role(spark, d, "ev_user"), ["git_repo", "source_kind", "cwd"], "timestamp", 60)


@register("d12_flap_stats", with_roles("alarms", "SELECT invariant_id, source, count(*) AS total, round(count(resolved_at) / count(*), 6) AS auto_resolved, CAST(floor(median(resolved_at - raised_at)) AS BIGINT) AS median_ms FROM alarms GROUP BY invariant_id, source"))
def d12(spark: SparkSession, d: str) -> DataFrame:
    return A.flap_stats(role(spark, d, "alarms"), ["invariant_id", "source"])


@register("d13_nearest_rank_p95", with_roles("ev_user", "SELECT source_kind, duration_ms AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY source_kind ORDER BY duration_ms) - 1 AS r, count(*) OVER (PARTITION BY source_kind) AS n FROM ev_user) WHERE r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)"))
def d13(spark: SparkSession, d: str) -> DataFrame:
    return A.nearest_rank(role(spark, d, "ev_user"), ["source_kind"], "duration_ms", 0.95, "p95")


_D14 = "WITH a AS (SELECT run_id, name AS model, avg(CAST(conclusion = 'success' AS INTEGER)) AS valid, avg(id % 7) AS sanity, max(id % 11) AS echo FROM jobs GROUP BY run_id, name) SELECT model, round(avg(valid), 6) AS validity, round(avg(sanity), 6) AS sanity, max(echo) AS echo_max FROM a GROUP BY model"


def model_summary(jobs: DataFrame) -> DataFrame:
    """Means of an attempt, then of a model."""
    a = jobs.groupBy("run_id", F.col("name").alias("model")).agg(F.avg((F.col("conclusion") == "success").cast("int")).alias("valid"), F.avg(F.col("id") % 7).alias("sanity"), F.max(F.col("id") % 11).alias("echo"))
    return a.groupBy("model").agg(F.round(F.avg("valid"), 6).alias("validity"), F.round(F.avg("sanity"), 6).alias("sanity"), F.max("echo").alias("echo_max"))


@register("d14_model_summary", with_roles("jobs", _D14))
def d14(spark: SparkSession, d: str) -> DataFrame:
    return model_summary(role(spark, d, "jobs"))


@register("d15_verdict", with_roles("jobs", f"SELECT model, CASE WHEN validity >= 0.7 AND sanity <= 2.99 THEN 'pass' WHEN validity >= 0.7 THEN 'sanity' WHEN sanity <= 2.99 THEN 'validity' ELSE 'validity,sanity' END AS verdict FROM ({_D14})"))
def d15(spark: SparkSession, d: str) -> DataFrame:
    s = model_summary(role(spark, d, "jobs"))
    return s.select("model", A.verdict([("validity", F.col("validity"), 0.7, None), ("sanity", F.col("sanity"), None, 2.99)]).alias("verdict"))


@register("d16_stratified_means", with_roles("ev_user", "SELECT tag, round(avg(duration_ms), 6) AS mean_ms FROM (SELECT unnest([source_kind, git_branch, coalesce(git_repo, 'none')]) AS tag, duration_ms FROM ev_user) GROUP BY tag"))
def d16(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array("source_kind", "git_branch", F.coalesce("git_repo", F.lit("none")))
    return role(spark, d, "ev_user").select(F.explode_outer(tags).alias("tag"), "duration_ms").groupBy("tag").agg(F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


@register("d17_retrieval_aggregates", with_roles("jobs", "SELECT name AS mode, round(avg(CAST(r <= 1 AS INTEGER)), 6) AS hit_1, round(avg(CAST(r <= 3 AS INTEGER)), 6) AS hit_3, round(avg(CAST(r <= 5 AS INTEGER)), 6) AS hit_5, round(avg(CASE WHEN r <= 10 THEN 1.0 / r ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_10 FROM (SELECT name, id % 13 + 1 AS r FROM jobs) GROUP BY name"))
def d17(spark: SparkSession, d: str) -> DataFrame:
    from recollect.operators.evaluation import retrieval_aggregates

    return retrieval_aggregates(role(spark, d, "jobs").select(F.col("name").alias("mode"), (F.col("id") % 13 + 1).alias("rank")), "mode", hits=(1, 3, 5))


@register("d18_export_counts", with_roles("ev_user sessions_user visits_user", "SELECT 'shell' AS source, count(*) AS n FROM ev_user WHERE enriched UNION ALL SELECT 'agentic', count(*) FROM sessions_user UNION ALL SELECT 'browser', count(*) FROM visits_user"))
def d18(spark: SparkSession, d: str) -> DataFrame:
    parts = {"shell": role(spark, d, "ev_user").filter("enriched"), "agentic": role(spark, d, "sessions_user"), "browser": role(spark, d, "visits_user")}
    out = None
    for name, df in parts.items():
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@register("d19_entities_by_type", with_roles("node_entities entities", "SELECT node_id, type, string_agg(name, '|' ORDER BY name) AS names FROM (SELECT DISTINCT l.node_id, e.type, e.name FROM node_entities l JOIN entities e ON e.id = l.entity_id) GROUP BY node_id, type"))
def d19(spark: SparkSession, d: str) -> DataFrame:
    l = role(spark, d, "node_entities")
    j = l.join(role(spark, d, "entities").select(F.col("id").alias("entity_id"), "type", "name"), "entity_id")
    return j.groupBy("node_id", "type").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


@register("d20_distinct", with_roles("ev_user", "SELECT DISTINCT session_id, cwd, git_branch FROM ev_user"))
def d20(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev_user").select("session_id", "cwd", "git_branch").distinct()


@register("d21_source_diversity", with_roles("ev_user", "SELECT session_id, round((log2(t) - s / t) / log2(5.0), 6) + 0.0 AS diversity FROM (SELECT session_id, sum(n) AS t, sum(n * log2(n)) AS s FROM (SELECT session_id, source_kind, count(*) AS n FROM ev_user GROUP BY ALL) GROUP BY session_id)"))
def d21(spark: SparkSession, d: str) -> DataFrame:
    return A.diversity(role(spark, d, "ev_user"), "session_id", "source_kind", 5)


# the sum over pairs of unit vectors is half of what the square of their sum has over their number
_PAIRS = """WITH u AS (SELECT id, label, unnest(range(1, len(vector) + 1)) AS d, unnest(vector)::DOUBLE / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) AS x FROM vectors),
    s AS (SELECT {0} d, sum(x) AS s, count(*) AS n FROM u GROUP BY {0} d) SELECT {0} round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS mean_cosine FROM s {1}"""


@register("d22_pairwise_cosine", with_roles("vectors", _PAIRS.format("", "")))
def d22(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_pairwise_cosine(role(spark, d, "vectors"), [], "vector", "mean_cosine")


@register("d23_cohesion", with_roles("vectors", _PAIRS.format("label,", "GROUP BY label")))
def d23(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_pairwise_cosine(role(spark, d, "vectors"), ["label"], "vector", "mean_cosine")


@register("d24_coverage_gap", with_roles("ev_user", "SELECT session_id, round(coalesce(avg(CAST(duration_ms < 80 AS INTEGER)), 1.0), 6) AS gap FROM ev_user GROUP BY session_id"))
def d24(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev_user").groupBy("session_id").agg(F.round(F.coalesce(F.avg((F.col("duration_ms") < 80).cast("int")), F.lit(1.0)), 6).alias("gap"))


@register("d25_health_grade", with_roles("alarms", "SELECT source, greatest(0, 100 - 10 * count(*) FILTER (resolved_at IS NULL AND id % 40 = 0)) AS grade FROM alarms GROUP BY source"))
def d25(spark: SparkSession, d: str) -> DataFrame:
    active = F.count_if(F.col("resolved_at").isNull() & (F.col("id") % 40 == 0))
    return role(spark, d, "alarms").groupBy("source").agg(F.greatest(F.lit(0), 100 - 10 * active).cast("bigint").alias("grade"))


_D26 = """WITH b AS (SELECT source_kind, le, count(*) FILTER (duration_ms <= le) AS n FROM ev_user CROSS JOIN (VALUES (50.0), (100.0), (250.0), (500.0), (1000.0), (100000.0)) t(le) GROUP BY source_kind, le),
    w AS (SELECT *, max(n) OVER (PARTITION BY source_kind) * 0.9 AS rank, coalesce(lag(n) OVER (PARTITION BY source_kind ORDER BY le), 0) AS below, coalesce(lag(le) OVER (PARTITION BY source_kind ORDER BY le), 0) AS low FROM b)
    SELECT source_kind, round(CAST(low AS DOUBLE) + (CAST(le AS DOUBLE) - CAST(low AS DOUBLE)) * (CAST(rank AS DOUBLE) - below) / (n - below), 6) AS p90 FROM w WHERE n >= rank AND below < rank"""


@register("d26_histogram_quantile", with_roles("ev_user", _D26))
def d26(spark: SparkSession, d: str) -> DataFrame:
    les = (50.0, 100.0, 250.0, 500.0, 1000.0, 100000.0)
    g = role(spark, d, "ev_user").groupBy("source_kind").agg(*[F.count_if(F.col("duration_ms") <= x).alias(f"n{i}") for i, x in enumerate(les)])
    b = g.select("source_kind", F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"n{i}").alias("n")) for i, x in enumerate(les)])).alias("x")).select("source_kind", "x.le", "x.n")
    return A.histogram_quantile(b, ["source_kind"], "le", "n", 0.9, "p90")


@register("g1_union_all", with_roles("ev_user visits_user", "SELECT id, timestamp FROM ev_user UNION ALL SELECT id, timestamp FROM visits_user"))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev_user").select("id", "timestamp").unionByName(role(spark, d, "visits_user").select("id", "timestamp"))


@register("g2_union_distinct", with_roles("node_events node_visits", "SELECT node_id, 'x' AS tag FROM node_events UNION SELECT node_id, 'x' FROM node_visits"))
def g2(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "node_events").select("node_id").union(role(spark, d, "node_visits").select("node_id")).distinct().withColumn("tag", F.lit("x"))


@register("g3_difference", with_roles("node_runs node_visits", "SELECT node_id FROM node_runs EXCEPT SELECT node_id FROM node_visits"))
def g3(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "node_runs").select("node_id").subtract(role(spark, d, "node_visits").select("node_id"))


@register("g4_ngram_jaccard", with_roles("questions", "WITH g AS (SELECT id, list_distinct(list_transform(range(1, 57), lambda i: substr(lower(question), i, 4))) AS a, list_distinct(list_transform(range(1, 57), lambda i: substr(lower(reverse(question)), i, 4))) AS b FROM questions WHERE length(question) >= 60) SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g"))
def g4(spark: SparkSession, d: str) -> DataFrame:
    from recollect.functions.text import char_ngrams, jaccard

    q = role(spark, d, "questions").filter("length(question) >= 60")
    a, b = (char_ngrams(F.substring(F.lower(x), 1, 59), 4) for x in (F.col("question"), F.reverse("question")))
    return q.select("id", F.round(jaccard(a, b), 6).alias("jaccard"))


# E: windows and sessions


@register("e1_top_entities", with_roles("node_entities entities", "SELECT node_id, type, substr(name, 1, 200) AS name FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY type, name, id) AS n FROM (SELECT DISTINCT l.node_id, e.type, e.name, e.id FROM node_entities l JOIN entities e ON e.id = l.entity_id)) WHERE n <= 20"))
def e1(spark: SparkSession, d: str) -> DataFrame:
    n = parts(spark, d, "lineitem", "part")
    l = role(spark, d, "node_entities").repartition(n, "entity_id").distinct()  # equal links are in one part, which the join takes as it is
    e = role(spark, d, "entities").select(F.col("id").alias("entity_id"), "type", "name").repartition(n, "entity_id")
    j = l.hint("merge").join(e, "entity_id")
    w = Window.partitionBy("node_id").orderBy("type", "name", "entity_id")
    return j.withColumn("n", F.row_number().over(w)).filter("n <= 20").select("node_id", "type", F.substring("name", 1, 200).alias("name"))


_GAP = "SELECT id, session_id, timestamp, sum(CAST(gap > {0} AS INTEGER)) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id), 0) AS gap FROM ev_user)"


@register("e2_capped_sessions", with_roles("ev_user", f"WITH g AS ({_GAP.format(14400000)}), n AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id, run ORDER BY timestamp, id) - 1 AS r FROM g) SELECT id, CASE WHEN total <= 8 THEN 0 ELSE CAST(run AS BIGINT) END AS run, CASE WHEN total <= 8 THEN 0 ELSE r // 8 END AS piece FROM n"))
def e2(spark: SparkSession, d: str) -> DataFrame:
    return S.capped_sessions(role(spark, d, "ev_user"), "session_id", "timestamp", 14_400_000, 8).select("id", "run", "piece")


@register("e3_gap_sessions", with_roles("ev_user", f"SELECT session_id, CAST(run AS BIGINT) AS chunk, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS n FROM ({_GAP.format(21600000)}) GROUP BY ALL"))
def e3(spark: SparkSession, d: str) -> DataFrame:
    g = S.gap_sessions(role(spark, d, "ev_user"), "session_id", "timestamp", 21_600_000)
    return g.groupBy("session_id", "chunk").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("n"))


def _segments_sql(turns: str, gap: str) -> str:
    """Segments by recursion over a transcript's turns; `turns` gives conv_id, turn, role, timestamp and n, `gap` the condition on time."""
    return f"""RECURSIVE WITH base AS ({turns}), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM base),
    s AS (SELECT conv_id, r, 0 AS segment, n AS total, CASE WHEN role = 'user' THEN timestamp END AS last_user, timestamp, n FROM o WHERE r = 1
        UNION ALL SELECT conv_id, r, segment + cut, CASE WHEN cut = 1 THEN n ELSE total + n END, CASE WHEN role = 'user' THEN timestamp ELSE last_user END, timestamp, n
        FROM (SELECT o.conv_id, o.r, o.role, o.timestamp, o.n, s.segment, s.total, s.last_user, CASE WHEN o.role = 'user' AND (s.total > 1500{gap}) THEN 1 ELSE 0 END AS cut FROM s JOIN o ON o.conv_id = s.conv_id AND o.r = s.r + 1))
    SELECT conv_id, CAST(segment AS INTEGER) AS segment, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS messages, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY conv_id, segment"""


def _sql_redacted(column: str) -> str:
    for _, pattern in RULES:
        column = f"regexp_replace({column}, '{pattern}', '[REDACTED]', 'g')"
    return f"coalesce(length({column}), 0)"


@register("e4_transcript_segments", with_roles("turns", _segments_sql("SELECT conv_id, turn, role, timestamp, coalesce(length(text), 0) AS n FROM turns", " OR coalesce(o.timestamp - s.last_user > 300000, false)")))
def e4(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(role(spark, d, "turns"), chars=1500)


@register("e5_collapse_trailing", with_roles("turns", "SELECT conv_id, turn FROM turns t WHERE NOT (turn > 0 AND role = 'assistant' AND EXISTS (SELECT 1 FROM turns p WHERE p.conv_id = t.conv_id AND p.turn = t.turn - 1 AND p.role = t.role) AND NOT EXISTS (SELECT 1 FROM turns x WHERE x.conv_id = t.conv_id AND x.turn > t.turn AND x.role <> t.role))"))
def e5(spark: SparkSession, d: str) -> DataFrame:
    return S.collapse_trailing_repeats(role(spark, d, "turns").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn")


@register("e6_newest_non_null", with_roles("ev_user", "SELECT session_id, arg_max(git_repo, timestamp) FILTER (git_repo IS NOT NULL) AS git_repo, arg_max(cwd, timestamp) AS cwd, greatest(max(timestamp), 1704200000000) AS captured_at FROM ev_user GROUP BY session_id"))
def e6(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev_user")
    return e.groupBy("session_id").agg(F.max_by("git_repo", F.when(F.col("git_repo").isNotNull(), F.col("timestamp"))).alias("git_repo"), F.max_by("cwd", "timestamp").alias("cwd"), F.greatest(F.max("timestamp"), F.lit(1704200000000)).alias("captured_at"))


@register("e7_positional_scores", with_roles("ev_user", "SELECT id, round(1 - (row_number() OVER (ORDER BY timestamp DESC, id) - 1) / count(*) OVER (), 6) AS score FROM (SELECT id, timestamp FROM ev_user ORDER BY timestamp DESC, id LIMIT 40)"))
def e7(spark: SparkSession, d: str) -> DataFrame:
    top = role(spark, d, "ev_user").select("id", "timestamp").orderBy(F.desc("timestamp"), "id").limit(40)
    return S.positional_scores(top, [F.desc("timestamp"), F.col("id")]).select("id", "score")


@register("e8_cursor_scan", with_roles("alarms", "SELECT id, invariant_id FROM alarms WHERE id > 1000 ORDER BY id"))
def e8(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "alarms").filter("id > 1000").select("id", "invariant_id").orderBy("id")


@register("e9_revision_numbers", with_roles("revisions", "SELECT document_id, id, observed_at, row_number() OVER (PARTITION BY document_id ORDER BY observed_at, id) AS revision_number FROM (SELECT DISTINCT id, document_id, observed_at FROM revisions)"))
def e9(spark: SparkSession, d: str) -> DataFrame:
    return S.number_revisions(role(spark, d, "revisions").select("id", "document_id", "observed_at").distinct(), "document_id", "observed_at").select("document_id", "id", "observed_at", "revision_number")


_E10 = """WITH r AS (SELECT DISTINCT id, document_id, observed_at FROM revisions), f AS (SELECT *, id % 9 = 0 AS p, NOT (id % 9 = 0) AND observed_at < 1704067200000 + 40000000000 - 38000000000 AS old FROM r),
    g AS (SELECT *, count(*) FILTER (NOT old) OVER (PARTITION BY document_id) AS kept, sum(CAST(NOT p AND NOT old AS INTEGER)) OVER (PARTITION BY document_id ORDER BY observed_at, id ROWS UNBOUNDED PRECEDING) AS rk FROM f)
    SELECT id FROM g WHERE old OR (NOT p AND NOT old AND rk <= kept - 30)"""


@register("e10_retention_pruning", with_roles("revisions", _E10))
def e10(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "revisions").select("id", "document_id", "observed_at").distinct()
    return S.prune_revisions(r, "document_id", "observed_at", F.col("id") % 9 == 0, 1704067200000 + 40_000_000_000, 38_000_000_000, 30).select("id")


_E11 = f"SELECT conv_id, turn, role, timestamp, {_sql_redacted('text')} AS n FROM turns t WHERE role <> 'developer' AND turn >= (SELECT min(turn) FROM turns x WHERE x.conv_id = t.conv_id AND x.role = 'user')"


@register("e11_rollout_segments", with_roles("turns", _segments_sql(_E11, " OR coalesce(o.timestamp - s.last_user > 300000, false)")))
def e11(spark: SparkSession, d: str) -> DataFrame:
    from recollect.functions.text import redact

    t = role(spark, d, "turns").filter("role <> 'developer'")
    first = t.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("from"))
    kept = t.join(first, "conv_id").filter(F.col("turn") >= F.col("from")).drop("from")  # nothing before the first user turn
    return S.segments(kept, chars=1500, size=F.length(redact(F.col("text"))))


@register("e12_untimed_segments", with_roles("turns", _segments_sql(f"SELECT conv_id, turn, role, timestamp, {_sql_redacted('text')} AS n FROM turns", "")))
def e12(spark: SparkSession, d: str) -> DataFrame:
    from recollect.functions.text import redact

    return S.segments(role(spark, d, "turns"), gap_ms=None, chars=1500, size=F.length(redact(F.col("text"))))


_A14 = "SELECT id, source_kind, bucket FROM (SELECT *, row_number() OVER (PARTITION BY source_kind, bucket ORDER BY md5(CAST(id AS VARCHAR) || ':7')) AS n FROM (SELECT id, source_kind, timestamp // 604800000 AS bucket FROM ev_user)) WHERE n <= 5"


@register("a14_stratified_sample", with_roles("ev_user", _A14))
def a14(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev_user").select("id", "source_kind", F.floor(F.col("timestamp") / 604_800_000).alias("bucket"))
    return S.stratified_sample(e, ["source_kind", "bucket"], F.md5(F.concat(F.col("id").cast("string"), F.lit(":7")).cast("binary")), 5)

