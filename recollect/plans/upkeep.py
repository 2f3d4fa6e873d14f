"""Registered maintenance, queue and health queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import health as H
from recollect.operators import maintenance as M
from recollect.operators import queues as Q
from recollect.operators.aggregates import flap_stats
from recollect.sources.catalog import NOW, load, role, with_roles

from .registry import register


@register("j1_upsert_entities", with_roles("entities", "SELECT type, canonical, arg_min(name, CASE WHEN id % 5 = 0 AND type IN ('file', 'project') THEN 1e18 ELSE 0 END + first_seen) AS name, min(first_seen) AS first_seen, max(first_seen) AS last_seen FROM (SELECT type, canonical, id, first_seen, CASE WHEN id % 5 = 0 THEN '/x/.claude/worktrees/a/' || name ELSE name END AS name FROM entities) GROUP BY type, canonical"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "entities").select("type", "canonical", F.col("first_seen").alias("seen_at"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("/x/.claude/worktrees/a/"), "name")).otherwise(F.col("name")).alias("name"))
    return M.upsert_entities(e)


_J2 = "SELECT id AS loser, survivor FROM (SELECT id, min(id) OVER (PARTITION BY content, embed_text, node_type) AS survivor FROM nodes) WHERE id <> survivor"


@register("j2_node_dedup_edges", with_roles("nodes node_visits", f"WITH m AS ({_J2}) SELECT DISTINCT coalesce(m.survivor, l.node_id) AS node_id, l.visit_id FROM node_visits l LEFT JOIN m ON m.loser = l.node_id"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    m = M.survivors(role(spark, d, "nodes"), "id", ["content", "embed_text", "node_type"])
    return M.remap_edges(role(spark, d, "node_visits"), m, "node_id").select("node_id", "visit_id")


@register("j3_entity_rebrand", with_roles("entities", "SELECT id AS loser, survivor FROM (SELECT id, first_value(id) OVER (PARTITION BY type, replace(canonical, '#', ' ') ORDER BY first_seen, id) AS survivor FROM entities) WHERE id <> survivor"))
def j3(spark: SparkSession, d: str) -> DataFrame:
    return M.survivors(role(spark, d, "entities"), "id", ["type", F.regexp_replace("canonical", "#", " ")], ["first_seen"])


@register("j4_identical_content", with_roles("nodes", "SELECT id, existing FROM (SELECT id, min(id) OVER (PARTITION BY content) AS existing FROM nodes WHERE content IS NOT NULL) WHERE id > existing"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose content an earlier node has already: a link to that one stands for an insert."""
    n = role(spark, d, "nodes").filter("content IS NOT NULL").select("id", F.sha2(F.col("content").cast("binary"), 256).alias("h"))
    known = n.groupBy("h").agg(F.min("id").alias("existing"))
    return n.join(known, "h").filter("id > existing").select("id", "existing")


@register("j5_replace_prior", with_roles("nodes node_visits visits", "SELECT id AS node_id FROM nodes WHERE id NOT IN (SELECT node_id FROM node_visits l JOIN visits v ON v.id = l.visit_id GROUP BY node_id HAVING bool_and(v.dwell_ms < 2500))"))
def j5(spark: SparkSession, d: str) -> DataFrame:
    """The given visits are those of a short stay; nodes linked to no others are replaced."""
    given = role(spark, d, "visits").filter("dwell_ms < 2500").select(F.col("id").alias("visit_id"))
    return M.replace_prior(role(spark, d, "nodes").select(F.col("id").alias("node_id")), role(spark, d, "node_visits"), given, "node_id", "visit_id")


@register("j6_segment_upsert", with_roles("turns", "SELECT conv_id, arg_min(md5(text), turn) AS identity, arg_max(md5(text), turn) AS content, arg_max(timestamp, turn) AS end_time FROM turns GROUP BY conv_id"))
def j6(spark: SparkSession, d: str) -> DataFrame:
    t = role(spark, d, "turns").withColumns({"identity": F.md5(F.col("text").cast("binary")), "content": F.md5(F.col("text").cast("binary")), "end_time": F.col("timestamp")})
    return M.latest_wins(t, ["conv_id"], ["turn"], ["identity"], ["content", "end_time"])


@register("j7_run_upsert", with_roles("runs", "SELECT head_sha, repo, min(started_at) AS first_seen, arg_max(status, (started_at, id)) AS status, arg_max(coalesce(conclusion, 'none'), (started_at, id)) AS conclusion FROM runs GROUP BY head_sha, repo"))
def j7(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "runs").withColumns({"first_seen": F.col("started_at"), "conclusion": F.coalesce("conclusion", F.lit("none"))})
    return M.latest_wins(r, ["head_sha", "repo"], ["started_at", "id"], ["first_seen"], ["status", "conclusion"])


@register("j8_insert_or_ignore", with_roles("ev", "SELECT id, envelope_id, probe_tag IS NULL AS enqueued FROM (SELECT *, row_number() OVER (PARTITION BY envelope_id ORDER BY id) AS n FROM ev) WHERE n = 1"))
def j8(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev").select("id", "envelope_id", "probe_tag")
    return M.insert_or_ignore(e, "envelope_id", "id").select("id", "envelope_id", F.col("probe_tag").isNull().alias("enqueued"))


@register("j9_session_of_terminal", with_roles("sessions", "SELECT cwd, arg_max(id, (start_time, id)) AS session_id FROM sessions GROUP BY cwd"))
def j9(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions").withColumn("session_id", F.col("id"))
    return M.latest_wins(s, ["cwd"], ["start_time", "id"], [], ["session_id"])


@register("j10_re_enrichment", with_roles("nodes node_events node_visits", "SELECT DISTINCT n.id, x.family FROM nodes n JOIN (SELECT node_id, 'shell' AS family FROM node_events UNION SELECT node_id, 'browser' FROM node_visits) x ON x.node_id = n.id WHERE n.enrichment_version < 2"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    x = role(spark, d, "node_events").select("node_id", F.lit("shell").alias("family")).union(role(spark, d, "node_visits").select("node_id", F.lit("browser").alias("family"))).distinct()
    return role(spark, d, "nodes").filter("enrichment_version < 2").select("id").join(x, F.col("id") == F.col("node_id")).select("id", "family")


@register("j11_repo_backfill", with_roles("ev", "SELECT e.id, coalesce(e.git_repo, m.git_repo) AS git_repo FROM ev e LEFT JOIN (SELECT cwd, min(git_repo) AS git_repo FROM ev WHERE git_repo IS NOT NULL GROUP BY cwd) m ON m.cwd = e.cwd"))
def j11(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev").select("id", "cwd", "git_repo")
    m = e.filter("git_repo IS NOT NULL").groupBy("cwd").agg(F.min("git_repo").alias("git_repo"))
    return M.backfill(e, m, "cwd", "git_repo").select("id", "git_repo")


_HEALTH_ROWS = "SELECT source, invariant_id LIKE '%1%' AS canonical, raised_at AS last_event_ts, resolved_at AS last_error_ts, CAST(id % 2 AS INTEGER) AS probe_ok, id AS probe_lag_ms, raised_at + id % 7 * 1000000 AS probe_last_run_ts, 'm' || CAST(id AS VARCHAR) AS last_error_msg FROM alarms"


def health_rows(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "alarms").selectExpr("source", "invariant_id LIKE '%1%' AS canonical", "raised_at AS last_event_ts", "resolved_at AS last_error_ts", "CAST(id % 2 AS INT) AS probe_ok", "id AS probe_lag_ms", "raised_at + id % 7 * 1000000 AS probe_last_run_ts", "concat('m', CAST(id AS STRING)) AS last_error_msg")


@register("j12_health_merge", with_roles("alarms", f"WITH h AS ({_HEALTH_ROWS}) SELECT source, max(last_event_ts) AS last_event_ts, max(last_error_ts) AS last_error_ts, arg_max(probe_ok, (probe_last_run_ts, canonical, probe_lag_ms)) AS probe_ok, arg_max(probe_lag_ms, (probe_last_run_ts, canonical, probe_lag_ms)) AS probe_lag_ms, max(probe_last_run_ts) AS probe_last_run_ts, arg_max(last_error_msg, (coalesce(last_error_ts, -1), canonical, last_error_msg)) AS last_error_msg FROM h GROUP BY source"))
def j12(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_health(health_rows(spark, d))


@register("j13_rename_detection", with_roles("memdocs", "WITH p AS (SELECT repository, md5(substring(content, 1, 7)) AS h, count(*) AS n, min(source_path) AS new_path FROM memdocs WHERE id // 4 % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1) SELECT m.repository, m.source_path AS old_path, p.new_path FROM memdocs m JOIN p ON p.repository = m.repository AND p.h = md5(substring(m.content, 1, 7)) WHERE m.id // 4 % 2 = 1"))
def j13(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs").select("id", "repository", F.col("source_path").alias("path"), F.md5(F.substring("content", 1, 7).cast("binary")).alias("hash"))
    return M.detect_renames(m.filter("id div 4 % 2 = 1"), m.filter("id div 4 % 2 = 0"))


@register("j14_memory_ingest", with_roles("memdocs", "SELECT repository, source_path AS path, CASE WHEN id % 7 = 0 THEN 'absent' WHEN id % 5 = 0 THEN 'new_document' WHEN id % 3 = 0 THEN 'new_revision' ELSE 'unchanged' END AS action, CASE WHEN id % 7 = 0 THEN id % 4 WHEN id % 5 = 0 THEN 1 WHEN id % 3 = 0 THEN id % 4 + 1 ELSE id % 4 END AS revision_number FROM memdocs WHERE NOT (id % 7 = 0 AND id % 5 = 0)"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs").select("id", "repository", F.col("source_path").alias("path"), F.md5(F.col("content").cast("binary")).alias("hash"), (F.col("id") % 4).alias("revision_number"))
    stored = m.filter("id % 5 <> 0")
    files = m.filter("id % 7 <> 0").withColumn("hash", F.when(F.col("id") % 3 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return M.ingest_snapshot(stored, files, NOW).drop("observed_at")


@register("j15_tombstones", with_roles("memdocs", "SELECT id, CASE WHEN id % 4 = 0 THEN 'active' WHEN state = 'tombstoned' OR absent_polls + 1 >= 3 THEN 'tombstoned' ELSE 'unavailable' END AS state FROM memdocs"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "memdocs").select("id", M.tombstone(F.col("state"), F.col("absent_polls"), F.col("id") % 4 == 0).alias("state"))


@register("j16_publish_if_current", with_roles("memdocs", "SELECT id AS document_id, CASE WHEN active_revision = current_revision THEN 'publish' ELSE 'retire' END AS action FROM memdocs WHERE active_revision IS NOT NULL"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs")
    p = m.filter("active_revision IS NOT NULL").select(F.col("id").alias("document_id"), F.col("active_revision").alias("revision_id"))
    return M.publishable(p, m).select("document_id", "action")


@register("j17_replace_categories", with_roles("memdocs", "SELECT id, 'user' AS category FROM memdocs WHERE id % 3 <> 0 UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'project' END FROM memdocs WHERE id % 3 = 0 AND id % 2 = 0"))
def j17(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs").select("id")
    new = m.filter("id % 3 = 0").withColumn("category", F.when(F.col("id") % 2 == 0, "project").otherwise("index"))
    return M.replace_categories(m.withColumn("category", F.lit("user")), new, "id", ["feedback", "project", "reference", "user", "index"])


@register("j18_watchlist", with_roles("runs", "WITH w AS (SELECT head_sha AS sha, arg_max(started_at + 86400000 * (id % 3), (started_at, id)) AS expires_at, arg_max(conclusion IS NOT NULL, (started_at, id)) AS finished, arg_max(id % 2 = 0, (started_at, id)) AS notified FROM runs GROUP BY 1) SELECT sha, expires_at, CASE WHEN expires_at <= 900000000000 THEN 'expired' WHEN finished AND NOT notified THEN 'pending_notify' ELSE 'active' END AS state FROM w"))
def j18(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "runs")
    w = r.select(F.col("head_sha").alias("sha"), F.struct("started_at", "id").alias("added_at"), (F.col("started_at") + 86_400_000 * (F.col("id") % 3)).alias("expires_at"), F.col("conclusion").isNotNull().alias("finished"), (F.col("id") % 2 == 0).alias("notified"))
    return M.watchlist(w, 900_000_000_000).select("sha", "expires_at", "state")


@register("j19_vector_backfill", with_roles("nodes vectors", "SELECT id FROM nodes WHERE id NOT IN (SELECT id FROM vectors) ORDER BY id LIMIT 64"))
def j19(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id").join(role(spark, d, "vectors").select("id"), "id", "left_anti").orderBy("id").limit(64)


_CLAIM = f"status = 'pending' OR (status = 'processing' AND coalesce(locked_at, 0) <= {NOW} - 600000)"


@register("k1_claim_shell", with_roles("queue", f"SELECT id, 'processing' AS status, {NOW}::BIGINT AS locked_at, 'w1' AS locked_by FROM queue WHERE source = 'shell' AND ({_CLAIM}) ORDER BY priority, created_at, id LIMIT 50"))
def k1(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue").filter("source = 'shell'")
    return Q.claim(q, [F.col("priority"), F.col("created_at"), F.col("id")], 50, NOW, "w1").select("id", "status", "locked_at", "locked_by")


@register("k2_claim_eligible_budget", with_roles("queue", f"SELECT id FROM queue WHERE source = 'agentic' AND ({_CLAIM}) AND retry_count < 4 ORDER BY priority, created_at, id LIMIT 30"))
def k2(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue").filter("source = 'agentic'")
    return Q.claim(q, [F.col("priority"), F.col("created_at"), F.col("id")], 30, NOW, "w1", eligible=F.col("retry_count") < 4).select("id")


@register("k3_failure_transition", with_roles("queue", "SELECT id, CASE WHEN retry_count + 1 >= max_retries THEN 'failed' ELSE 'pending' END AS status, retry_count + 1 AS retry_count FROM queue WHERE status = 'processing'"))
def k3(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue")
    return Q.fail(q, q.filter("status = 'processing'")).select("id", "status", "retry_count")


@register("k4_reaper", with_roles("queue", f"WITH r AS (SELECT source, status, status = 'processing' AND coalesce(locked_at, 0) <= {NOW} - 600000 AS stale, retry_count, max_retries FROM queue) SELECT source, count(*) FILTER (stale) AS reaped, count(*) FILTER (stale AND retry_count + 1 >= max_retries) AS failed FROM r GROUP BY source"))
def k4(spark: SparkSession, d: str) -> DataFrame:
    r = Q.reap(role(spark, d, "queue"), NOW)
    return r.groupBy("source").agg(F.count_if(F.col("_stale")).alias("reaped"), F.count_if(F.col("_stale") & (F.col("status") == "failed")).alias("failed"))


@register("k5_enqueue_decision", with_roles("runs queue", "SELECT r.id, CASE WHEN q.status IS NULL THEN 'yes' WHEN q.status = 'processing' THEN 'processing' WHEN r.id % 3 = 0 THEN 'same_hash' WHEN 1000 + r.id % 5 * 100000 < 300000 THEN 'too_soon' ELSE 'yes' END AS decision FROM runs r LEFT JOIN queue q ON q.id = r.id AND q.id % 11 <> 0"))
def k5(spark: SparkSession, d: str) -> DataFrame:
    q = role(spark, d, "queue").filter("id % 11 <> 0").select("id", "status")
    r = role(spark, d, "runs").select("id").join(q, "id", "left")
    i = F.col("id")
    return r.select("id", Q.enqueue_decision(F.col("status"), i % 3 == 0, F.lit(NOW) - (1000 + i % 5 * 100_000), NOW).alias("decision"))


@register("k6_already_enriched", with_roles("sessions node_sessions", "SELECT id FROM sessions WHERE id % 3 = 0 AND id IN (SELECT session_id FROM node_sessions WHERE session_id % 2 = 0)"))
def k6(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions").select("id", F.lit("h").alias("content_hash"), F.when(F.col("id") % 3 == 0, "h").alias("enriched_hash"))
    return Q.already_enriched(s, role(spark, d, "node_sessions").filter("session_id % 2 = 0").select(F.col("session_id").alias("id")), "id").select("id")


@register("k7_settling_sweep", with_roles("sessions queue", "SELECT s.id FROM sessions s LEFT JOIN queue q ON q.id = s.id AND q.id % 5 <> 0 WHERE s.id % 3 <> 0 AND s.message_count > 0 AND (q.status IS NULL OR q.status IN ('done', 'failed', 'skipped'))"))
def k7(spark: SparkSession, d: str) -> DataFrame:
    s = role(spark, d, "sessions").select("id", "message_count", F.lit("h").alias("content_hash"), F.when(F.col("id") % 3 == 0, "h").alias("enriched_hash"))
    return Q.settling_sweep(s, role(spark, d, "queue").filter("id % 5 <> 0"), "id").select("id")


@register("k10_idle_gate", with_roles("sessions", f"SELECT id FROM sessions WHERE end_time <= {1704067200000 + 200 * 3600000} - 120000"))
def k10(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "sessions").filter(F.col("end_time") <= 1704067200000 + 200 * 3_600_000 - 120_000).select("id")


@register("k12_settle_delay", with_roles("sessions", "SELECT id FROM sessions WHERE end_time + 90000 <= 1704300000000"))
def k12(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "sessions").filter(F.col("end_time") + 90_000 <= 1704300000000).select("id")


@register("k15_probe_round_trip", with_roles("ev", "SELECT id, 1 + id % 900 AS lag_ms FROM ev WHERE probe_tag IS NOT NULL"))
def k15(spark: SparkSession, d: str) -> DataFrame:
    seen = role(spark, d, "ev").filter("probe_tag IS NOT NULL").select("id", "timestamp")
    started = seen.select("id", (F.col("timestamp") - 1 - F.col("id") % 900).alias("started_at"))
    return started.join(seen, "id").select("id", (F.col("timestamp") - F.col("started_at")).alias("lag_ms"))


_K16 = """WITH h AS (SELECT CASE c_custkey % 10 WHEN 0 THEN 'shell' WHEN 1 THEN 'agentic-session-claude' WHEN 2 THEN 'browser' WHEN 3 THEN 'agentic-session-opencode' WHEN 4 THEN 'agentic-session-codex' WHEN 5 THEN 'agentic-session-cursor' WHEN 6 THEN 'brain-preflight' WHEN 7 THEN 'claude-auto-memory' WHEN 8 THEN 'auto-memory-watcher' ELSE 'workflow' END AS source,
    c_nationkey AS consecutive_failures, {0} - c_custkey % 97 * 20000 AS last_event_ts, CASE WHEN c_nationkey % 3 = 0 THEN 1 WHEN c_nationkey % 3 = 1 THEN 0 END AS probe_ok, CASE WHEN c_nationkey % 4 > 0 THEN {0} - c_custkey % 89 * 30000 END AS probe_last_run_ts, {0} - c_custkey % 31 * 30000 AS last_heartbeat_ts, CASE WHEN c_custkey % 2 = 0 THEN {0} - 777 END AS last_error_ts FROM customer),
    i AS (SELECT source, {0} - last_event_ts AS age, {0} - probe_last_run_ts AS probe, {0} - last_heartbeat_ts AS beat, * EXCLUDE (source) FROM h)
    SELECT 'I-1' AS invariant_id, source, age AS since_ms FROM i WHERE source = 'shell' AND probe_ok = 1 AND age > 420000
    UNION ALL SELECT 'I-2', source, age FROM i WHERE source = 'agentic-session-claude' AND consecutive_failures > 3
    UNION ALL SELECT 'I-4', source, age FROM i WHERE source = 'browser' AND beat <= 420000 AND age > 420000
    UNION ALL SELECT 'I-8', source, probe FROM i WHERE probe IS NOT NULL AND (probe > 900000 OR coalesce(probe_ok = 0, false))
    UNION ALL SELECT CASE source WHEN 'agentic-session-opencode' THEN 'I-11' WHEN 'agentic-session-codex' THEN 'I-13' ELSE 'I-15' END, source, greatest(age, 0) FROM i WHERE source IN ('agentic-session-opencode', 'agentic-session-codex', 'agentic-session-cursor') AND consecutive_failures > 3
    UNION ALL SELECT 'I-12', source, age FROM i WHERE source = 'brain-preflight' AND consecutive_failures > 12
    UNION ALL SELECT 'I-18', source, {0} - coalesce(last_error_ts, last_event_ts) FROM i WHERE source = 'claude-auto-memory' AND consecutive_failures > 3
    UNION ALL SELECT 'I-17', 'auto-memory-watcher', {0} - b FROM (SELECT max(last_event_ts) FILTER (source = 'claude-auto-memory') AS a, max(last_heartbeat_ts) FILTER (source = 'auto-memory-watcher') AS b FROM h) WHERE {0} - a <= 3600000 AND {0} - b > 900000""".format(NOW)


@register("k16_invariants", _K16)
def k16(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer")
    names = ("shell", "agentic-session-claude", "browser", "agentic-session-opencode", "agentic-session-codex", "agentic-session-cursor", "brain-preflight", "claude-auto-memory", "auto-memory-watcher", "workflow")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    h = c.select(
        F.element_at(F.array(*[F.lit(x) for x in names]), (k % 10 + 1).cast("int")).alias("source"),
        n.alias("consecutive_failures"),
        (F.lit(NOW) - k % 97 * 20_000).alias("last_event_ts"),
        F.when(n % 3 == 0, 1).when(n % 3 == 1, 0).alias("probe_ok"),
        F.when(n % 4 > 0, F.lit(NOW) - k % 89 * 30_000).alias("probe_last_run_ts"),
        (F.lit(NOW) - k % 31 * 30_000).alias("last_heartbeat_ts"),
        F.when(k % 2 == 0, F.lit(NOW) - 777).alias("last_error_ts"),
        F.lit(NOW).alias("updated_at"),
        F.lit(None).cast("bigint").alias("last_success_ts"),
    )
    return H.invariants(h, NOW, shell_active=True, browser_running=True)


@register("k17_table_invariants", with_roles("memdocs nodes node_visits", "SELECT 'I-19' AS invariant_id, count(*) AS n FROM memdocs WHERE active_revision IS DISTINCT FROM current_revision AND state = 'active' UNION ALL SELECT 'I-16', count(*) FROM (SELECT content FROM nodes GROUP BY content HAVING count(*) > 1) UNION ALL SELECT 'I-20', count(*) FROM node_visits l WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = l.node_id)"))
def k17(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes")
    stale = role(spark, d, "memdocs").filter(~F.col("active_revision").eqNullSafe(F.col("current_revision")) & (F.col("state") == "active")).agg(F.count("*").alias("n"))
    twins = n.groupBy("content").count().filter("count > 1").agg(F.count("*").alias("n"))
    orphans = role(spark, d, "node_visits").join(n.select(F.col("id").alias("node_id")), "node_id", "left_anti").agg(F.count("*").alias("n"))
    named = [x.select(F.lit(i).alias("invariant_id"), "n") for i, x in (("I-19", stale), ("I-16", twins), ("I-20", orphans))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@register("k18_alarm_rate_limit", with_roles("alarms", "RECURSIVE k(invariant_id, raised_at) AS (SELECT invariant_id, min(raised_at) FROM alarms GROUP BY 1 UNION ALL SELECT k.invariant_id, (SELECT min(a.raised_at) FROM alarms a WHERE a.invariant_id = k.invariant_id AND a.raised_at >= k.raised_at + 21600000) FROM k WHERE k.raised_at IS NOT NULL) SELECT invariant_id, raised_at FROM k WHERE raised_at IS NOT NULL".replace("RECURSIVE k(", "RECURSIVE WITH k(", 1)))
def k18(spark: SparkSession, d: str) -> DataFrame:
    return Q.rate_limited(role(spark, d, "alarms").select("invariant_id", "raised_at"), "invariant_id", "raised_at", 21_600_000)


@register("k19_auto_resolve", with_roles("alarms", "WITH t AS (SELECT invariant_id, source, id AS tick, id % 5 = 0 AS bad FROM alarms), r AS (SELECT *, sum(CAST(bad AS INTEGER)) OVER (PARTITION BY invariant_id, source ORDER BY tick ROWS UNBOUNDED PRECEDING) AS run FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY invariant_id, source, run ORDER BY tick) - 1 AS k FROM r) SELECT invariant_id, source, tick FROM n WHERE run > 0 AND NOT bad AND k = 2"))
def k19(spark: SparkSession, d: str) -> DataFrame:
    t = role(spark, d, "alarms").select("invariant_id", "source", F.col("id").alias("tick"), (F.col("id") % 5 == 0).alias("bad"))
    return Q.auto_resolve(t, ["invariant_id", "source"], "tick", "bad")


@register("k20_ack_and_prune", with_roles("alarms", f"SELECT id, CASE WHEN id % 10 = 3 THEN coalesce(acked_at, {NOW}) ELSE acked_at END AS acked_at FROM alarms WHERE resolved_at IS NULL OR resolved_at >= 1704400000000"))
def k20(spark: SparkSession, d: str) -> DataFrame:
    a = role(spark, d, "alarms")
    return Q.prune_alarms(Q.acknowledge(a, a.filter("id % 10 = 3"), NOW), NOW, NOW - 1704400000000).select("id", "acked_at")


@register("k21_alarm_lessons", with_roles("alarms", "SELECT invariant_id, source, count(*) AS total, round(count(resolved_at) / count(*), 6) AS auto_resolved, CAST(floor(median(resolved_at - raised_at)) AS BIGINT) AS median_ms FROM alarms WHERE id > 100 GROUP BY 1, 2 HAVING count(*) >= 5"))
def k21(spark: SparkSession, d: str) -> DataFrame:
    return flap_stats(role(spark, d, "alarms").filter("id > 100"), ["invariant_id", "source"]).filter("total >= 5")


@register("k23_idle_signal", with_roles("ev_user", "SELECT max(timestamp) AS last_real, 1706659200000 - max(timestamp) <= 600000 AS active, 1706659200000 - max(timestamp) >= 86400000 AS backstop FROM ev_user WHERE source_kind = 'click'"))
def k23(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev_user").filter("source_kind = 'click'").agg(F.max("timestamp").alias("last_real"))
    age = F.lit(1706659200000) - F.col("last_real")
    return e.select("last_real", (age <= 600_000).alias("active"), (age >= 86_400_000).alias("backstop"))


#: A pause holds for so long after it was last asked for.
PAUSE_MS = 1_800_000
_PAUSES = "p AS (SELECT CASE source WHEN 'AUTOMOBILE' THEN 'shell' WHEN 'BUILDING' THEN 'agentic' WHEN 'FURNITURE' THEN 'browser' WHEN 'MACHINERY' THEN 'workflow' ELSE 'memory' END AS source, max(raised_at) AS asked FROM alarms GROUP BY 1), t AS (SELECT max(raised_at) + 1200000 AS now FROM alarms)"


@register("k22_paused_claims", with_roles("queue alarms", f"WITH {_PAUSES} SELECT q.source, coalesce(t.now - p.asked < {PAUSE_MS}, false) AS paused, count(*) FILTER (NOT coalesce(t.now - p.asked < {PAUSE_MS}, false)) AS claimable FROM queue q CROSS JOIN t LEFT JOIN p ON p.source = q.source WHERE q.status = 'pending' GROUP BY 1, 2"))
def k22(spark: SparkSession, d: str) -> DataFrame:
    """Pauses as stored rows: the last alarm of each source asks for one. Now is twenty minutes after the last of all."""
    a = role(spark, d, "alarms")
    s = F.col("source")
    of = F.when(s == "AUTOMOBILE", "shell").when(s == "BUILDING", "agentic").when(s == "FURNITURE", "browser").when(s == "MACHINERY", "workflow").otherwise("memory")
    pauses = a.groupBy(of.alias("source")).agg(F.max("raised_at").alias("asked"))
    now = a.agg((F.max("raised_at") + 1_200_000).alias("now"))
    waiting = with_pauses(role(spark, d, "queue").filter("status = 'pending'").crossJoin(F.broadcast(now)), pauses)  # one row
    return waiting.groupBy("source", "paused").agg(F.count_if(~F.col("paused")).alias("claimable"))


def with_pauses(claims: DataFrame, pauses: DataFrame) -> DataFrame:
    """Adds `paused`: the source's pause (source, asked) is younger than PAUSE_MS at the row's `now`. Pauses run out by themselves, so one that was never lifted blocks nothing for good."""
    j = claims.join(F.broadcast(pauses), "source", "left")  # a row for each source
    return j.withColumn("paused", F.coalesce(F.col("now") - F.col("asked") < PAUSE_MS, F.lit(False))).drop("asked")


@register("k24_health_update", with_roles("ev", "SELECT source_kind AS source, max(timestamp) AS last_event_ts, count(*) AS events, 0 AS consecutive_failures FROM ev GROUP BY source_kind"))
def k24(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev")
    old = e.filter("id % 2 = 0").groupBy(F.col("source_kind").alias("source")).agg(F.max("timestamp").alias("last_event_ts"), F.count("*").alias("events"), F.lit(2).alias("consecutive_failures"), F.lit("x").alias("last_error_msg"))
    return H.update_health(old, e.filter("id % 2 = 1").select(F.col("source_kind").alias("source"), "timestamp")).drop("last_error_msg")


_H26 = "SELECT id, CASE WHEN id % 11 = 0 THEN 'failing' WHEN id % 5 = 1 AND id % 7 > 0 THEN 'failing' WHEN age <= 86400000 THEN 'fresh' ELSE 'stale' END AS status FROM (SELECT id, {0} - raised_at AS age FROM alarms)"


@register("h26_capture_status", with_roles("alarms", _H26.format(1705500000000)))
def h26(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    now = 1705500000000
    a = role(spark, d, "alarms").select(
        "id", F.lit("shell").alias("source"), F.lit(True).alias("has_health"), F.lit(5).alias("row_count"), F.col("raised_at").alias("max_event_ts"), (i % 11 == 0).cast("int").alias("alarms"),
        F.when(i % 5 == 1, i % 7).otherwise(0).alias("consecutive_failures"), F.lit(now - 1000).alias("last_error_ts"), F.lit(1).alias("probe_ok"), F.lit(None).cast("bigint").alias("probe_last_run_ts"), F.lit(0).alias("events_last_24h"), F.col("raised_at").alias("last_event_ts"),
    )
    return a.select("id", H.capture_status(now).alias("status"))


@register("h27_doctor_staleness", with_roles("alarms", "SELECT id, CASE WHEN age <= 3600000 THEN 'ok' WHEN id % 2 = 0 AND age < 86400000 THEN 'suppressed' WHEN age > 43200000 THEN 'fail' ELSE 'warn' END AS verdict FROM (SELECT id, 1704700000000 - raised_at AS age FROM alarms)"))
def h27(spark: SparkSession, d: str) -> DataFrame:
    age = F.lit(1704700000000) - F.col("raised_at")
    return role(spark, d, "alarms").select("id", H.staleness(age, 3_600_000, 43_200_000, F.col("id") % 2 == 0).alias("verdict"))
