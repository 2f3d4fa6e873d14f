"""Tables, and the roles that the driver's tables play.

A role is a table of the activity model (event log, agent sessions, page visits, CI
runs, knowledge nodes and their links, health, alarms, memory documents) as a projection
of a stored table. `role(...)` builds the DataFrame; `SQL` has the same projections as
common table expressions. User-facing reads go through the `*_user` roles, which leave
synthetic probe rows out, so no query can forget to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_710_000_000_000  # a fixed now, epoch milliseconds, for queries over stored tables
SETTLE_MS = 90_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored bytes of a table for each task that holds a part of it: some 400,000 narrow rows.
PART_BYTES = 8 << 20


def parts(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """How many parts the largest of the stored tables should be dealt to, so that there are more tasks and not larger ones where it is larger."""
    sizes = []
    for name in names:
        files = load(spark, sf_dir, name).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
        sizes.append(files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    return max(spark.sparkContext.defaultParallelism, max(sizes) // PART_BYTES + 1)


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


#: role: (stored table, projection as (name, Spark SQL, SQL or None if the same))
_ROLES: dict[str, tuple[str, list[tuple[str, str, str | None]]]] = {
    "ev": (
        "events",
        [
            ("id", "event_id", None),
            ("session_id", "user_id", None),
            ("timestamp", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "epoch_us(ts) // 1000"),
            ("command", "concat(event_type, ' --n ', CAST(event_id % 17 AS STRING))", "event_type || ' --n ' || CAST(event_id % 17 AS VARCHAR)"),
            ("exit_code", "CAST(event_id % 3 AS INT)", "CAST(event_id % 3 AS INTEGER)"),
            ("duration_ms", "CAST(floor(value * 10) AS BIGINT)", None),
            ("cwd", "concat('/home/u', CAST(user_id % 10 AS STRING), '/src')", "'/home/u' || CAST(user_id % 10 AS VARCHAR) || '/src'"),
            ("git_repo", "CASE WHEN user_id % 4 <> 0 THEN concat('org/repo', CAST(user_id % 4 AS STRING)) END", "CASE WHEN user_id % 4 <> 0 THEN 'org/repo' || CAST(user_id % 4 AS VARCHAR) END"),
            ("git_branch", "CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'dev' END", None),
            ("source_kind", "event_type", None),
            ("envelope_id", "concat('e', CAST(event_id % 9000 AS STRING))", "'e' || CAST(event_id % 9000 AS VARCHAR)"),
            ("enriched", "event_id % 5 = 0", None),
            ("probe_tag", "CASE WHEN event_id % 50 = 0 THEN 'probe' END", None),
        ],
    ),
    "visits": (
        "pages",
        [
            ("id", "page_id", None),
            ("timestamp", "1704067200000 + page_id * 45000", None),
            ("url", "url", None),
            ("title", "regexp_extract(html, '<title>([^<]*)', 1)", None),
            ("domain", "regexp_extract(url, '^[a-z]+://([^/]+)', 1)", None),
            ("dwell_ms", "page_id * 37 % 5000", None),
            ("scroll_depth", "CAST(page_id % 101 AS DOUBLE) / 100", None),
            ("search_query", "CASE WHEN page_id % 7 = 0 THEN 'spark' END", None),
            ("probe_tag", "CASE WHEN page_id % 40 = 0 THEN 'probe' END", None),
        ],
    ),
    "turns": (
        "conversations",
        [("conv_id", "conv_id", None), ("turn", "turn", None), ("role", "role", None), ("text", "text", None), ("timestamp", "1704067200000 + conv_id * 3600000 + turn * (60000 + conv_id % 7 * 60000)", None)],
    ),
    "runs": (
        "orders",
        [
            ("id", "o_orderkey", None),
            ("repo", "concat('org/repo', CAST(o_custkey % 4 AS STRING))", "'org/repo' || CAST(o_custkey % 4 AS VARCHAR)"),
            ("head_sha", "md5(CAST(o_orderkey % 3000 AS STRING))", "md5(CAST(o_orderkey % 3000 AS VARCHAR))"),
            ("head_branch", "CASE WHEN o_custkey % 3 = 0 THEN 'main' ELSE 'dev' END", None),
            ("status", "CASE WHEN o_orderstatus = 'P' THEN 'in_progress' ELSE 'completed' END", None),
            ("conclusion", "CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' END", None),
            ("started_at", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)", "epoch_us(o_orderdate) // 1000"),
        ],
    ),
    "jobs": (
        "lineitem",
        [
            ("run_id", "l_orderkey", None),
            ("id", "l_orderkey * 8 + l_linenumber", None),
            ("name", "CASE WHEN l_linenumber % 3 = 0 THEN 'lint' WHEN l_linenumber % 3 = 1 THEN 'cargo test' ELSE 'pytest' END", None),
            ("conclusion", "CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END", None),
            ("message", "CASE WHEN l_linestatus = 'F' THEN concat('error[E', CAST(1000 + l_suppkey % 90 AS STRING), ']: bad type') WHEN l_returnflag = 'N' THEN concat('F', CAST(400 + l_suppkey % 50 AS STRING), ' unused import') ELSE 'incompatible [arg-type]' END", "CASE WHEN l_linestatus = 'F' THEN 'error[E' || CAST(1000 + l_suppkey % 90 AS VARCHAR) || ']: bad type' WHEN l_returnflag = 'N' THEN 'F' || CAST(400 + l_suppkey % 50 AS VARCHAR) || ' unused import' ELSE 'incompatible [arg-type]' END"),
        ],
    ),
    "nodes": (
        "documents",
        [
            ("id", "doc_id", None),
            ("uuid", "concat('node-', CAST(doc_id AS STRING))", "'node-' || CAST(doc_id AS VARCHAR)"),
            ("content", "text", None),
            ("embed_text", "substring(text, 1, 200)", None),
            ("node_type", "lang", None),
            ("source", "source", None),
            ("enrichment_version", "CAST(doc_id % 3 AS INT)", "CAST(doc_id % 3 AS INTEGER)"),
            ("created_at", "1704067200000 + doc_id * 600000", None),
        ],
    ),
    "node_events": ("lineitem", [("node_id", "l_partkey % 800", None), ("event_id", "l_orderkey", None)]),
    "node_sessions": ("conversations", [("node_id", "conv_id * 3 % 1100", None), ("session_id", "conv_id", None)]),
    "node_visits": ("pages", [("node_id", "page_id * 5 % 1200", None), ("visit_id", "page_id", None)]),
    "node_runs": ("orders", [("node_id", "o_custkey % 700", None), ("run_id", "o_orderkey", None)]),
    "node_entities": ("lineitem", [("node_id", "l_orderkey % 900", None), ("entity_id", "l_partkey", None)]),
    "entities": (
        "part",
        [
            ("id", "p_partkey", None),
            ("type", "CASE p_size % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'tool' WHEN 2 THEN 'project' ELSE 'concept' END", None),
            ("name", "p_name", None),
            ("canonical", "lower(p_brand)", None),
            ("first_seen", "1704067200000 + p_partkey * 1000", None),
            ("last_seen", "1704067200000 + p_partkey * 1000 + CAST(p_size AS BIGINT) * 86400000", None),
        ],
    ),
    "alarms": (
        "customer",
        [
            ("id", "c_custkey", None),
            ("invariant_id", "concat('I-', CAST(c_nationkey % 12 AS STRING))", "'I-' || CAST(c_nationkey % 12 AS VARCHAR)"),
            ("source", "c_mktsegment", None),
            ("raised_at", "1704067200000 + c_custkey * 400000", None),
            ("resolved_at", "CASE WHEN c_acctbal > 3000 THEN 1704067200000 + c_custkey * 400000 + CAST(floor(c_acctbal) AS BIGINT) * 100 END", None),
            ("acked_at", "CASE WHEN c_custkey % 5 = 0 THEN 1704067200000 + c_custkey * 400000 + 5000 END", None),
        ],
    ),
    "queue": (
        "orders",
        [
            ("id", "o_orderkey", None),
            ("source", "CASE o_custkey % 5 WHEN 0 THEN 'shell' WHEN 1 THEN 'agentic' WHEN 2 THEN 'browser' WHEN 3 THEN 'workflow' ELSE 'memory' END", None),
            ("status", "CASE o_orderkey % 7 WHEN 0 THEN 'processing' WHEN 1 THEN 'done' WHEN 2 THEN 'failed' WHEN 3 THEN 'skipped' ELSE 'pending' END", None),
            ("priority", "CAST(substring(o_orderpriority, 1, 1) AS INT)", "CAST(substring(o_orderpriority, 1, 1) AS INTEGER)"),
            ("retry_count", "CAST(o_orderkey % 6 AS INT)", "CAST(o_orderkey % 6 AS INTEGER)"),
            ("max_retries", "CAST(5 AS INT)", "CAST(5 AS INTEGER)"),
            ("locked_at", "CASE WHEN o_orderkey % 14 = 0 THEN 1710000000000 - o_orderkey * 1000 END", None),
            ("created_at", "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)", "epoch_us(o_orderdate) // 1000"),
        ],
    ),
    "memdocs": (
        "documents",
        [
            ("id", "doc_id", None),
            ("repository", "concat('org/repo', CAST(doc_id % 4 AS STRING))", "'org/repo' || CAST(doc_id % 4 AS VARCHAR)"),
            ("source_path", "concat('memory/', CASE doc_id % 5 WHEN 0 THEN 'feedback_' WHEN 1 THEN 'project_' WHEN 2 THEN 'reference_' WHEN 3 THEN 'user' ELSE 'notes_' END, CAST(doc_id AS STRING), '.md')", "'memory/' || CASE doc_id % 5 WHEN 0 THEN 'feedback_' WHEN 1 THEN 'project_' WHEN 2 THEN 'reference_' WHEN 3 THEN 'user' ELSE 'notes_' END || CAST(doc_id AS VARCHAR) || '.md'"),
            ("state", "CASE doc_id % 9 WHEN 0 THEN 'tombstoned' WHEN 1 THEN 'unavailable' ELSE 'active' END", None),
            ("absent_polls", "CAST(doc_id % 6 AS INT)", "CAST(doc_id % 6 AS INTEGER)"),
            ("current_revision", "doc_id * 10 + doc_id % 3", None),
            ("active_revision", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id * 10 + doc_id % 2 END", None),
            ("content", "text", None),
        ],
    ),
    "revisions": (
        "lineitem",
        [("id", "l_orderkey * 10 + l_linenumber", None), ("document_id", "l_orderkey % 1000", None), ("observed_at", "1704067200000 + (l_orderkey * 7 + l_linenumber) * 60000", None), ("chars", "CAST(l_quantity AS BIGINT)", None)],
    ),
    "vectors": ("embeddings", [("id", "vec_id", None), ("vector", "embedding", None), ("label", "label", None)]),
    "questions": ("benchmark", [("id", "item_id", None), ("question", "text", None)]),
    "outcomes": ("labels", [("node_id", "doc_id", None), ("outcome", "CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END", None), ("toxic", "toxic", None)]),
}

_SESSION_SQL = """SELECT conv_id AS id, CASE conv_id % 4 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'opencode' WHEN 2 THEN 'codex' ELSE 'cursor' END AS harness,
    min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS message_count,
    {cwd} AS cwd, CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'dev' END AS git_branch, {summary} AS summary_text,
    {path} AS source_file, CASE WHEN conv_id % 13 = 0 THEN 'probe' END AS probe_tag
    FROM turns GROUP BY conv_id"""


def _cte(name: str) -> str:
    table, columns = _ROLES[name]
    return f"{name} AS (SELECT {', '.join(f'{sql or spark} AS {c}' for c, spark, sql in columns)} FROM {table})"


_SQL_SESSIONS = _SESSION_SQL.format(
    cwd="'/home/u' || CAST(conv_id % 10 AS VARCHAR) || '/src'",
    summary="min(CASE WHEN turn = 1 THEN substring(text, 1, 80) END)",
    path="CASE WHEN conv_id % 11 = 0 THEN '/p/subagents/workflows/w/journal.jsonl' ELSE '/p/' || CAST(conv_id AS VARCHAR) || '.jsonl' END",
)
#: Common table expressions by role.
SQL: dict[str, str] = {n: _cte(n) for n in _ROLES} | {"sessions": f"sessions AS ({_SQL_SESSIONS})"}
for _n in ("ev", "visits", "sessions"):
    SQL[f"{_n}_user"] = f"{_n}_user AS (SELECT * FROM {_n} WHERE probe_tag IS NULL)"
_NEEDS = {"sessions": ["turns"], "ev_user": ["ev"], "visits_user": ["visits"], "sessions_user": ["turns", "sessions"]}


def with_roles(names: str, query: str) -> str:
    """SQL text with the named roles (space-separated) as common table expressions in front."""
    wanted: list[str] = []
    for n in names.split():
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    body = query.strip()
    head = "WITH RECURSIVE " if body.upper().startswith("RECURSIVE ") else "WITH "
    body = body[len("RECURSIVE ") :] if head != "WITH " else body
    tail = f",\n{body[5:]}" if body.upper().startswith("WITH ") else f"\n{body}"
    return head + ",\n".join(SQL[n] for n in wanted) + tail


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name.endswith("_user"):
        return role(spark, sf_dir, name[: -len("_user")]).filter(F.col("probe_tag").isNull())
    if name == "sessions":
        t = role(spark, sf_dir, "turns")
        c = F.col("conv_id")
        out = t.groupBy("conv_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("message_count"), F.min(F.when(F.col("turn") == 1, F.substring("text", 1, 80))).alias("summary_text"))
        return out.select(
            c.alias("id"),
            F.when(c % 4 == 0, "claude-code").when(c % 4 == 1, "opencode").when(c % 4 == 2, "codex").otherwise("cursor").alias("harness"),
            "start_time",
            "end_time",
            "message_count",
            F.concat(F.lit("/home/u"), (c % 10).cast("string"), F.lit("/src")).alias("cwd"),
            F.when(c % 2 == 0, "main").otherwise("dev").alias("git_branch"),
            "summary_text",
            F.when(c % 11 == 0, "/p/subagents/workflows/w/journal.jsonl").otherwise(F.concat(F.lit("/p/"), c.cast("string"), F.lit(".jsonl"))).alias("source_file"),
            F.when(c % 13 == 0, "probe").alias("probe_tag"),
        )
    table, columns = _ROLES[name]
    return load(spark, sf_dir, table).selectExpr(*[f"{sparked} AS {c}" for c, sparked, _ in columns])
