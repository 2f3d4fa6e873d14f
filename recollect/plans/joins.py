"""Registered joins and link filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions import predicates as P
from recollect.operators import joins as J
from recollect.sources.catalog import parts, role, with_roles

from .registry import register

_NOW = 1_705_000_000_000
_FAMILIES = f"""SELECT l.node_id, e.probe_tag IS NULL AS ok FROM node_events l JOIN ev e ON e.id = l.event_id
    UNION ALL SELECT l.node_id, s.probe_tag IS NULL AND s.source_file NOT LIKE '%/subagents/workflows/%journal.jsonl' AND (s.message_count > 0 OR length(trim(coalesce(s.summary_text, ''))) > 0) AND s.end_time + 90000 <= {_NOW} FROM node_sessions l JOIN sessions s ON s.id = l.session_id
    UNION ALL SELECT l.node_id, v.probe_tag IS NULL FROM node_visits l JOIN visits v ON v.id = l.visit_id
    UNION ALL SELECT l.node_id, r.conclusion IS NOT NULL OR lower(r.status) = 'completed' FROM node_runs l JOIN runs r ON r.id = l.run_id"""
_FAMILY_ROLES = "nodes node_events ev node_sessions sessions node_visits visits node_runs runs"


def families(spark: SparkSession, d: str) -> list:
    """The links of each family with the flag of what they lead to, which is told before they meet."""
    s = role(spark, d, "sessions").withColumnRenamed("id", "session_id")
    known = [
        ("node_events", "lineitem", "events", role(spark, d, "ev").withColumnRenamed("id", "event_id"), "event_id", P.probe_free()),
        ("node_sessions", "conversations", "conversations", s, "session_id", P.agentic_eligible(_NOW)),
        ("node_visits", "pages", "pages", role(spark, d, "visits").withColumnRenamed("id", "visit_id"), "visit_id", P.probe_free()),
        ("node_runs", "orders", "orders", role(spark, d, "runs").withColumnRenamed("id", "run_id"), "run_id", P.workflow_eligible()),
    ]
    return [(J.dealt_join(role(spark, d, links), table.select(key, ok.alias("flag")), key, parts(spark, d, *{stored, of})), F.col("flag")) for links, stored, of, table, key, ok in known]


def node_ids(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select(F.col("id").alias("node_id"))


@register("b11_eligible_nodes", with_roles(_FAMILY_ROLES, f"WITH f AS ({_FAMILIES}) SELECT n.id AS node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.node_id = n.id) OR EXISTS (SELECT 1 FROM f WHERE f.node_id = n.id AND f.ok)"))
def b11(spark: SparkSession, d: str) -> DataFrame:
    return J.eligible_nodes(node_ids(spark, d), "node_id", families(spark, d))


@register("b20_noise_nodes", with_roles(_FAMILY_ROLES, f"WITH f AS ({_FAMILIES}) SELECT node_id FROM f WHERE node_id IN (SELECT id FROM nodes) GROUP BY node_id HAVING NOT bool_or(coalesce(ok, false))"))
def b20(spark: SparkSession, d: str) -> DataFrame:
    return J.noise_nodes(node_ids(spark, d), "node_id", families(spark, d))


SOURCES = {"shell": "node_events", "claude": "node_sessions", "browser": "node_visits", "workflow": "node_runs"}


def source_filter(spark: SparkSession, d: str, nodes: DataFrame, source: str) -> DataFrame:
    """Nodes with a link of the family; an unknown family is an error, never no filter."""
    if source not in SOURCES:
        raise ValueError(f"unknown source: {source}")
    return nodes.join(role(spark, d, SOURCES[source]).select("node_id"), "node_id", "left_semi")


@register("b12_source_family", with_roles("nodes node_sessions", "SELECT id AS node_id FROM nodes WHERE id IN (SELECT node_id FROM node_sessions)"))
def b12(spark: SparkSession, d: str) -> DataFrame:
    return source_filter(spark, d, node_ids(spark, d), "claude")


@register(
    "b13_project_filter",
    with_roles("nodes node_events ev node_sessions sessions memdocs", "SELECT id AS node_id FROM nodes WHERE id IN (SELECT node_id FROM node_events JOIN ev ON ev.id = event_id WHERE cwd ILIKE '%u7%' OR git_repo ILIKE '%u7%') OR id IN (SELECT node_id FROM node_sessions JOIN sessions s ON s.id = session_id WHERE cwd ILIKE '%u7%') OR id IN (SELECT id FROM memdocs WHERE repository ILIKE '%u7%' OR source_path ILIKE '%u7%')"),
)
def b13(spark: SparkSession, d: str) -> DataFrame:
    q = "u7"
    e = role(spark, d, "ev").filter(P.contains(F.col("cwd"), q) | F.coalesce(P.contains(F.col("git_repo"), q), F.lit(False))).select(F.col("id").alias("event_id"))
    s = role(spark, d, "sessions").filter(P.contains(F.col("cwd"), q)).select(F.col("id").alias("session_id"))
    m = role(spark, d, "memdocs").filter(P.contains(F.col("repository"), q) | P.contains(F.col("source_path"), q)).select(F.col("id").alias("node_id"))
    return J.union_of_semi_joins(node_ids(spark, d), "node_id", [role(spark, d, "node_events").join(e, "event_id", "left_semi"), role(spark, d, "node_sessions").join(s, "session_id", "left_semi"), m])


@register("b14_branch_filter", with_roles("nodes node_events ev node_sessions sessions", "SELECT id AS node_id FROM nodes WHERE id IN (SELECT node_id FROM node_events JOIN ev ON ev.id = event_id WHERE git_branch = 'dev') OR id IN (SELECT node_id FROM node_sessions JOIN sessions s ON s.id = session_id WHERE git_branch = 'dev')"))
def b14(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev").filter("git_branch = 'dev'").select(F.col("id").alias("event_id"))
    s = role(spark, d, "sessions").filter("git_branch = 'dev'").select(F.col("id").alias("session_id"))
    return J.union_of_semi_joins(node_ids(spark, d), "node_id", [role(spark, d, "node_events").join(e, "event_id", "left_semi"), role(spark, d, "node_sessions").join(s, "session_id", "left_semi")])


CATEGORIES = ("feedback", "project", "reference", "user", "index")


def category_of(path):
    """Category by file name: the index file, the user file, or a prefix; null for others."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.when(F.element_at(F.split(path, "/"), -1) == "MEMORY.md", "index").when(F.rlike(name, F.lit(r"^user(\.[^.]*)?$")), "user")
    for prefix in ("feedback", "project", "reference", "user"):
        out = out.when(name.startswith(prefix + "_"), prefix)
    return out


def category_filter(docs: DataFrame, category: str) -> DataFrame:
    if category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    return docs.filter(category_of(F.col("source_path")) == category)


@register("b15_category_filter", with_roles("nodes memdocs", "SELECT id AS node_id FROM nodes WHERE id IN (SELECT id FROM memdocs WHERE source_path LIKE 'memory/feedback\\_%' ESCAPE '\\')"))
def b15(spark: SparkSession, d: str) -> DataFrame:
    m = category_filter(role(spark, d, "memdocs"), "feedback").select(F.col("id").alias("node_id"))
    return node_ids(spark, d).join(m, "node_id", "left_semi")


@register("b16_entity_filter", with_roles("nodes node_entities entities", "SELECT id AS node_id FROM nodes WHERE id IN (SELECT node_id FROM node_entities l JOIN entities e ON e.id = l.entity_id WHERE e.canonical = 'brand#2' OR e.name = 'brand#2')"))
def b16(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "entities").filter("canonical = 'brand#2' OR name = 'brand#2'").select(F.col("id").alias("entity_id"))
    return node_ids(spark, d).join(role(spark, d, "node_entities").join(e, "entity_id", "left_semi"), "node_id", "left_semi")


@register(
    "b17_candidate_pushdown",
    with_roles(_FAMILY_ROLES, f"WITH f AS ({_FAMILIES}) SELECT n.id AS node_id FROM nodes n WHERE n.id % 3 = 0 AND (NOT EXISTS (SELECT 1 FROM f WHERE f.node_id = n.id) OR EXISTS (SELECT 1 FROM f WHERE f.node_id = n.id AND f.ok)) AND n.id IN (SELECT node_id FROM node_visits) AND (n.created_at >= 1704300000000 OR n.id IN (SELECT node_id FROM node_visits l JOIN visits v ON v.id = l.visit_id WHERE v.timestamp >= 1704300000000))"),
)
def b17(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes").filter("id % 3 = 0").select(F.col("id").alias("node_id"), "created_at")  # candidates first: filters see few rows
    kept = source_filter(spark, d, J.eligible_nodes(n, "node_id", families(spark, d)), "browser")
    recent = role(spark, d, "node_visits").join(role(spark, d, "visits").filter("timestamp >= 1704300000000").select(F.col("id").alias("visit_id")), "visit_id", "left_semi").select("node_id").distinct().withColumn("_r", F.lit(True))
    return kept.join(recent, "node_id", "left").filter("created_at >= 1704300000000 OR _r").select("node_id")


@register("b24_score_floor", with_roles("ev_user", "SELECT id, round(duration_ms / 100.0, 4) AS score FROM ev_user WHERE duration_ms / 100.0 >= 0.5 ORDER BY score DESC, id LIMIT 30"))
def b24(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "ev_user").select("id", F.round(F.col("duration_ms") / 100.0, 4).alias("score"))
    return score_floor(s, "semantic", 0.5).orderBy(F.desc("score"), "id").limit(30)


def score_floor(hits: DataFrame, mode: str, least: float) -> DataFrame:
    """The floor holds for modes whose score is a similarity, not a position."""
    return hits.filter(F.col("score") >= least) if mode in ("semantic", "hybrid") else hits


@register("c1_bridge_join", with_roles("nodes node_events ev", "SELECT n.id AS node_id, e.id AS event_id, e.command FROM nodes n JOIN (SELECT DISTINCT * FROM node_events) l ON l.node_id = n.id JOIN ev e ON e.id = l.event_id"))
def c1(spark: SparkSession, d: str) -> DataFrame:
    l = role(spark, d, "node_events").distinct()
    return l.join(node_ids(spark, d), "node_id", "left_semi").join(role(spark, d, "ev").select(F.col("id").alias("event_id"), "command"), "event_id").select("node_id", "event_id", "command")


@register("c2_left_multi_distinct", with_roles("nodes node_events node_sessions node_visits", "SELECT DISTINCT n.id, l.event_id IS NOT NULL AS has_event, s.session_id IS NOT NULL AS has_session, v.visit_id IS NOT NULL AS has_visit FROM nodes n LEFT JOIN node_events l ON l.node_id = n.id LEFT JOIN node_sessions s ON s.node_id = n.id LEFT JOIN node_visits v ON v.node_id = n.id"))
def c2(spark: SparkSession, d: str) -> DataFrame:
    out = node_ids(spark, d)
    for name, flag in (("node_events", "has_event"), ("node_sessions", "has_session"), ("node_visits", "has_visit")):
        out = out.join(role(spark, d, name).select("node_id").distinct().withColumn(flag, F.lit(True)), "node_id", "left")  # distinct first: no fan-out
    return out.select(F.col("node_id").alias("id"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_event", "has_session", "has_visit")])


@register("c3_left_join_residual", with_roles("node_sessions sessions", "SELECT l.node_id, l.session_id, s.harness FROM node_sessions l LEFT JOIN sessions s ON s.id = l.session_id AND s.probe_tag IS NULL AND s.message_count > 3"))
def c3(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions").filter("probe_tag IS NULL AND message_count > 3").select(F.col("id").alias("session_id"), "harness")
    return role(spark, d, "node_sessions").join(s, "session_id", "left").select("node_id", "session_id", "harness")


@register("c4_nested_semi", with_roles("entities node_entities node_events ev_user", "SELECT id FROM entities e WHERE EXISTS (SELECT 1 FROM node_entities ne WHERE ne.entity_id = e.id AND EXISTS (SELECT 1 FROM node_events nv JOIN ev_user v ON v.id = nv.event_id WHERE nv.node_id = ne.node_id AND v.exit_code = 2 AND v.session_id = 3))"))
def c4(spark: SparkSession, d: str) -> DataFrame:
    v = role(spark, d, "ev_user").filter("exit_code = 2 AND session_id = 3").select(F.col("id").alias("event_id"))
    nodes = role(spark, d, "node_events").join(v, "event_id", "left_semi").select("node_id")
    return role(spark, d, "entities").select("id").join(role(spark, d, "node_entities").join(nodes, "node_id", "left_semi").select(F.col("entity_id").alias("id")), "id", "left_semi")


@register("c5_missing_vectors", with_roles("nodes vectors", "SELECT id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = n.id)"))
def c5(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id").join(role(spark, d, "vectors").select("id"), "id", "left_anti")


@register("c6_solely_linked", with_roles("node_visits", "SELECT node_id FROM node_visits GROUP BY node_id HAVING bool_and(visit_id % 2 = 0)"))
def c6(spark: SparkSession, d: str) -> DataFrame:
    l = role(spark, d, "node_visits")
    return J.solely_linked(l, l.select("visit_id").filter("visit_id % 2 = 0"), "node_id", "visit_id")


@register("c7_null_safe_pairs", with_roles("ev", "SELECT a.id AS a, b.id AS b FROM ev a JOIN ev b ON a.git_repo IS NOT DISTINCT FROM b.git_repo AND a.command = b.command AND a.probe_tag IS NOT DISTINCT FROM b.probe_tag AND a.session_id = b.session_id AND a.id < b.id AND a.exit_code = b.exit_code"))
def c7(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev").select("id", "git_repo", "command", "probe_tag", "session_id", "exit_code")
    a, b = e.alias("a"), e.alias("b")
    same = F.col("a.git_repo").eqNullSafe(F.col("b.git_repo")) & F.col("a.probe_tag").eqNullSafe(F.col("b.probe_tag"))
    for c in ("command", "session_id", "exit_code"):
        same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_W = 300_000


@register("c8_range_join", with_roles("sessions_user ev_user", f"SELECT s.id AS session, e.id AS event FROM sessions_user s JOIN ev_user e ON e.timestamp BETWEEN s.start_time - {_W} AND s.end_time + {_W}"))
def c8(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions_user").select(F.col("id").alias("session"), (F.col("start_time") - _W).alias("a"), (F.col("end_time") + _W).alias("b"))
    return J.range_join(role(spark, d, "ev_user").select(F.col("id").alias("event"), "timestamp"), s, "timestamp", "a", "b", 3_600_000).select("session", "event")


@register("c9_overlap_join", with_roles("sessions_user", "SELECT a.id AS a, b.id AS b FROM sessions_user a JOIN sessions_user b ON a.start_time <= b.end_time + 900000 AND b.start_time - 900000 <= a.end_time AND a.id < b.id"))
def c9(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions_user")
    a = s.select(F.col("id").alias("a"), "start_time", "end_time")
    b = s.select(F.col("id").alias("b"), (F.col("start_time") - 900_000).alias("rs"), (F.col("end_time") + 900_000).alias("re"))
    return J.overlap_join(a, b, ("start_time", "end_time"), ("rs", "re"), 7_200_000).filter("a < b").select("a", "b")


@register(
    "c10_cascading_join",
    with_roles(
        "runs ev_user",
        """WITH r AS (SELECT id AS run, id % 500 AS sha, repo, 1704067200000 + id * 37 % 2592000 * 1000 AS at FROM runs), x AS (SELECT r.run, e.id AS event, e.timestamp FROM r JOIN ev_user e ON e.session_id = r.sha AND e.source_kind = 'purchase'),
        y AS (SELECT r.run, e.id AS event, e.timestamp FROM r JOIN ev_user e ON e.git_repo = r.repo AND e.source_kind = 'signup' AND e.timestamp BETWEEN r.at - 3600000 AND r.at WHERE r.run NOT IN (SELECT run FROM x))
        SELECT run, event, exact FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY timestamp, event) AS n FROM (SELECT run, event, timestamp, true AS exact FROM x UNION ALL SELECT run, event, timestamp, false FROM y)) WHERE n <= 20""",
    ),
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "runs").select(F.col("id").alias("run"), (F.col("id") % 500).alias("session_id"), F.col("repo").alias("git_repo"), (F.lit(1_704_067_200_000) + F.col("id") * 37 % 2_592_000 * 1000).alias("at"))
    e = role(spark, d, "ev_user").select(F.col("id").alias("event"), "timestamp", "session_id", "git_repo", "source_kind")
    bought = e.filter("source_kind = 'purchase'").select("session_id", "event", "timestamp")
    first = bought.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("timestamp", "event"))).filter("_n <= 20").drop("_n")  # no run takes more
    exact = r.select("run", "session_id").join(first, "session_id").select("run", "event", "timestamp")
    alone = r.join(first.select("session_id").distinct(), "session_id", "left_anti")  # only these fall back, so only they meet windows of events
    pushed = alone.select("run", "git_repo", (F.col("at") - 3_600_000).alias("since"), "at")
    fallback = J.range_join(e.filter("source_kind = 'signup'").drop("session_id"), pushed, "timestamp", "since", "at", 3_600_000, ["git_repo"]).select("run", "event", "timestamp")
    return J.cascading_join(r, exact, fallback, "run", [F.col("timestamp"), F.col("event")], 20).select("run", "event", "exact")


@register("c13_alias_lookup", with_roles("entities", "SELECT DISTINCT canonical AS term FROM entities WHERE lower(name) IN ('small ring', 'brand#3', 'red widget') OR lower(canonical) IN ('small ring', 'brand#3', 'red widget') ORDER BY term LIMIT 8"))
def c13(spark: SparkSession, d: str) -> DataFrame:
    tokens = spark.createDataFrame([("small ring",), ("brand#3",), ("red widget",)], "token string")
    e = role(spark, d, "entities").select(F.lower("name").alias("n"), F.lower("canonical").alias("c"), F.col("canonical").alias("term"))
    hit = lambda k: e.join(F.broadcast(tokens), F.col(k) == F.col("token"), "left_semi").select("term")  # noqa: E731  the tokens of one query
    return hit("n").unionByName(hit("c")).distinct().orderBy("term").limit(8)


@register("c14_coverage_classes", with_roles("queue runs", "SELECT r.id, CASE WHEN q.status = 'done' THEN 'stored' WHEN q.status = 'processing' THEN 'in_flight' ELSE 'missing' END AS status FROM runs r LEFT JOIN queue q ON q.id = r.id"))
def c14(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue")
    return J.coverage_classes(role(spark, d, "runs"), q.filter("status = 'done'"), q.filter("status = 'processing'"), "id")


@register("c15_reconcile", with_roles("turns", "WITH a AS (SELECT conv_id, turn, md5(text) AS h FROM turns WHERE turn % 5 <> 4), b AS (SELECT conv_id, turn, md5(CASE WHEN turn = 2 THEN 'x' ELSE text END) AS h FROM turns WHERE turn > 0) SELECT conv_id, turn, CASE WHEN b.h IS NULL THEN 'left_only' WHEN a.h IS NULL THEN 'right_only' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b USING (conv_id, turn)"))
def c15(spark: SparkSession, d: str) -> DataFrame:
    t = role(spark, d, "turns")
    a = t.filter("turn % 5 <> 4").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("h"))
    b = t.filter("turn > 0").select("conv_id", "turn", F.md5(F.when(F.col("turn") == 2, "x").otherwise(F.col("text")).cast("binary")).alias("h"))
    return J.reconcile(a, b, ["conv_id", "turn"], "h")


@register("c16_using_join", with_roles("runs jobs", "SELECT run_id, count(*) AS jobs FROM (SELECT id AS run_id FROM runs WHERE head_branch = 'main') JOIN jobs USING (run_id) GROUP BY run_id"))
def c16(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "runs").filter("head_branch = 'main'").select(F.col("id").alias("run_id"))
    return role(spark, d, "jobs").join(r, "run_id").groupBy("run_id").agg(F.count("*").alias("jobs"))


@register("c17_provenance", with_roles("nodes memdocs node_runs", "SELECT n.id, CASE WHEN m.source_path LIKE '%feedback%' THEN 'feedback' WHEN m.source_path LIKE '%project%' THEN 'project' WHEN m.source_path LIKE '%reference%' THEN 'reference' END AS category, (SELECT string_agg(CAST(run_id AS VARCHAR), ',' ORDER BY run_id) FROM (SELECT DISTINCT run_id FROM node_runs l WHERE l.node_id = n.id)) AS links FROM nodes n JOIN memdocs m ON m.id = n.id"))
def c17(spark: SparkSession, d: str) -> DataFrame:
    n = node_ids(spark, d)
    cats = role(spark, d, "memdocs").select(F.col("id").alias("node_id"), category_of(F.col("source_path")).alias("category"))
    links = role(spark, d, "node_runs").groupBy("node_id").agg(F.array_sort(F.collect_set("run_id")).alias("x"))
    out = n.join(cats, "node_id").join(links, "node_id", "left")
    return out.select(F.col("node_id").alias("id"), "category", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("links"))


@register("c18_reachability", "WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 3 + 1) % 25 AS dst FROM nation), r(node) AS (SELECT 2 AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def c18(spark: SparkSession, d: str) -> DataFrame:
    from recollect.sources.catalog import load

    e = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("int").alias("dst")).distinct()
    return J.reachable(e, spark.createDataFrame([(2,)], "node int"))


@register("c19_request_response", with_roles("turns", "SELECT u.conv_id, u.turn AS use_ord, r.turn AS res_ord, greatest(r.timestamp - u.timestamp, 0) AS duration_ms FROM turns u JOIN turns r ON r.conv_id = u.conv_id AND r.turn // 2 = u.turn // 2 AND r.turn > u.turn WHERE u.role = 'user' AND r.role = 'assistant'"))
def c19(spark: SparkSession, d: str) -> DataFrame:
    t = role(spark, d, "turns").withColumn("call", F.floor(F.col("turn") / 2))
    u = t.filter("role = 'user'").select("conv_id", "call", F.col("turn").alias("use_ord"), F.col("timestamp").alias("use_ts"))
    r = t.filter("role = 'assistant'").select("conv_id", "call", F.col("turn").alias("res_ord"), F.col("timestamp").alias("res_ts"))
    return J.pair_requests(u, r, ["conv_id", "call"]).select("conv_id", "use_ord", "res_ord", "duration_ms")


@register("c20_watermark_join", with_roles("runs queue", "SELECT r.id FROM runs r LEFT JOIN (SELECT id, created_at + id % 3 * 1000 - 1000 AS mark FROM queue WHERE id % 4 <> 0) s ON s.id = r.id WHERE (s.mark IS NULL OR r.started_at > s.mark) AND r.id NOT IN (SELECT id FROM queue WHERE status = 'processing')"))
def c20(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue")
    stored = q.filter("id % 4 <> 0").select("id", (F.col("created_at") + F.col("id") % 3 * 1000 - 1000).alias("mark"))
    return J.newer_than_stored(role(spark, d, "runs"), stored, "id", "started_at", "mark", q.filter("status = 'processing'")).select("id")


@register("c21_file_coverage", with_roles("sessions turns", "SELECT s.source_file, count(t.conv_id) AS n, max(t.timestamp) AS last, CASE WHEN count(t.conv_id) > 0 THEN 'covered' WHEN min(s.message_count) = 0 THEN 'expected_absent' ELSE 'missing' END AS status FROM sessions s LEFT JOIN turns t ON t.conv_id = s.id AND t.turn > 1 AND t.conv_id % 3 > 0 GROUP BY s.source_file"))
def c21(spark: SparkSession, d: str) -> DataFrame:
    files = role(spark, d, "sessions").select("id", "source_file", "message_count")
    rows = role(spark, d, "turns").filter("turn > 1 AND conv_id % 3 > 0").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    g = files.join(rows, "id", "left").groupBy("source_file").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.max("last").alias("last"), F.min("message_count").alias("m"))
    return g.select("source_file", "n", "last", F.when(F.col("n") > 0, "covered").when(F.col("m") == 0, "expected_absent").otherwise("missing").alias("status"))
