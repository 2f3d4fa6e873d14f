"""Registered sources, sinks and streams. Transcripts are written as files first, and read as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.sources import sinks as K
from recollect.sources import tail
from recollect.sources import transcripts as T
from recollect.sources.catalog import load, role, with_roles
from recollect.sources.store import new_path
from recollect.streaming import ingest as S

from .registry import register


#: Foreign keys of the store: table, column, and what they point to.
FOREIGN = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id")]


@register("a2_open_session", " UNION ALL ".join(f"SELECT '{t}.{c}' AS foreign_key, count(*) AS rows, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {u} p WHERE p.{k} = {t}.{c}) AND {c} IS NOT NULL) AS orphans FROM {t}" for t, c, u, k in FOREIGN))
def a2(spark: SparkSession, d: str) -> DataFrame:
    """Opens the store: the version must fit, and each foreign key is checked for rows that point to nothing."""
    from recollect.sources.session import SCHEMA_VERSION, check_schema_version

    check_schema_version(SCHEMA_VERSION)
    out = None
    for t, c, u, k in FOREIGN:
        j = load(spark, d, t).select(F.col(c).alias("_c")).join(load(spark, d, u).select(F.col(k).alias("_k")).distinct(), F.col("_c") == F.col("_k"), "left")
        one = j.agg(F.lit(f"{t}.{c}").alias("foreign_key"), F.count("*").alias("rows"), F.count_if(F.col("_k").isNull() & F.col("_c").isNotNull()).alias("orphans"))
        out = one if out is None else out.unionByName(one)
    return out


def transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """file, place and line of agent transcripts: a third of the sessions lie as a subagent's; some lines are noise and some are broken off."""
    c, n = F.col("conv_id"), F.col("conv_id").cast("string")
    folder = F.concat(F.lit("proj"), (c % 5).cast("string"), F.lit("/s"), n)
    path = F.when(c % 3 == 0, F.concat(folder, F.lit("/subagents/agent"), n, F.lit(".jsonl"))).otherwise(F.concat(folder, F.lit(".jsonl")))
    body = F.to_json(F.struct(F.when(F.col("turn") % 4 == 3, "progress").otherwise(F.col("role")).alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.struct(F.col("role"), F.col("text").alias("content")).alias("message")))
    return role(spark, d, "turns").select("conv_id", path.alias("file"), F.col("turn").alias("place"), F.when((c + F.col("turn")) % 10 == 0, F.substring(body, 1, 12)).otherwise(body).alias("line"))


_written: dict[tuple[str, str], str] = {}


def transcript_folder(spark: SparkSession, d: str) -> str:
    """The conversations as files of lines in the shared folder, written once in an application."""
    key = spark.sparkContext.applicationId, d
    if key not in _written:
        folder = new_path(spark, "transcripts")
        tail.write_files(transcript_lines(spark, d), folder).count()
        _written[key] = folder
    return _written[key]


def _conversation(path: str) -> Column:
    return F.regexp_extract(path, r"(\d+)\.jsonl$", 1).cast("bigint")


@register("a3_session_paths", with_roles("turns", "SELECT DISTINCT conv_id, 'proj' || CAST(conv_id % 5 AS VARCHAR) AS project_dir, CASE WHEN conv_id % 3 = 0 THEN 'agent' || CAST(conv_id AS VARCHAR) ELSE 's' || CAST(conv_id AS VARCHAR) END AS session_id, conv_id % 3 = 0 AS is_subagent, CASE WHEN conv_id % 3 = 0 THEN 's' || CAST(conv_id AS VARCHAR) END AS parent FROM turns"))
def a3(spark: SparkSession, d: str) -> DataFrame:
    found = T.discover(spark, transcript_folder(spark, d))
    return found.select(_conversation("path").alias("conv_id"), T.session_of_path(F.col("path")).alias("s")).select("conv_id", "s.*")


@register("a4_tolerant_lines", with_roles("turns", "SELECT conv_id, turn, md5(text) AS digest FROM turns WHERE turn % 4 <> 3 AND (conv_id + turn) % 10 <> 0"))
def a4(spark: SparkSession, d: str) -> DataFrame:
    """Every file is read as lines; a conversation's turns are its lines, from 0."""
    entries = T.tolerant_entries(T.read_lines(spark, transcript_folder(spark, d)))
    return entries.select(_conversation("path").alias("conv_id"), (F.col("line_no") - 1).cast("bigint").alias("turn"), F.md5(F.col("entry.message.content").cast("binary")).alias("digest"))


_K9 = "SELECT conv_id AS id, count(*) * CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END AS lines, CAST(sum(length(CAST(turn AS VARCHAR)) + 33) * CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END + CASE WHEN conv_id % 5 = 0 THEN 6 * count(*) ELSE 0 END AS BIGINT) AS chars FROM turns GROUP BY conv_id"


@register("k9_offset_tailing", with_roles("turns", _K9))
def k9(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as growing files: half of their turns, then all, then every fifth file replaced. What the tail has given is counted by conversation."""
    base = new_path(spark, "tailed")
    turns = role(spark, d, "turns").select(F.col("conv_id"), F.col("turn").alias("place"), F.concat(F.lit("p/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("file"), F.concat(F.col("turn").cast("string"), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("line"))
    again = turns.filter("conv_id % 5 = 0").withColumn("line", F.concat(F.lit("again "), "line"))
    spark.dataSource.register(tail.TailSource)
    for delivered in (turns.filter("place <= 3"), turns, again):
        tail.write_files(delivered, f"{base}/in").count()
        stream = spark.readStream.format("line_tail").option("suffix", ".jsonl").load(f"{base}/in")
        q = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").start()  # from where the last one stopped
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{base}/rows")
    return rows.groupBy(_conversation("path").alias("id")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@register("a5_rollout_identity", with_roles("ev_user", "WITH f AS (SELECT session_id AS u, source_kind, min(timestamp * 100000 + id) AS pos FROM ev_user WHERE source_kind IN ('signup', 'purchase') AND session_id % 4 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY pos) AS n FROM f), p AS (SELECT DISTINCT session_id AS u FROM ev_user) SELECT '/x/rollout-' || CAST(p.u AS VARCHAR) || '.jsonl' AS path, coalesce(a.source_kind, 'rollout-' || CAST(p.u AS VARCHAR)) AS session_id, b.source_kind AS parent_id FROM p LEFT JOIN r a ON a.u = p.u AND a.n = 1 LEFT JOIN r b ON b.u = p.u AND b.n = 2"))
def a5(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "ev_user")
    path = F.concat(F.lit("/x/rollout-"), F.col("session_id").cast("string"), F.lit(".jsonl"))
    value = F.when(F.col("source_kind").isin("signup", "purchase") & (F.col("session_id") % 4 != 0), F.col("source_kind"))
    return T.rollout_identity(e.select(path.alias("path"), (F.col("timestamp") * 100_000 + F.col("id")).alias("at"), value.alias("v")), "path", "at", "v")


@register("a6_recovered_cwd", with_roles("ev", "SELECT id, CASE WHEN git_repo IS NOT NULL THEN '/home/my-' || source_kind || '/src' ELSE '/home/my/' || replace(source_kind, '-', '/') || '/src' END AS cwd FROM ev"))
def a6(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with a repository name a file in it, whose folder tells which signs of the slug are of names."""
    e = role(spark, d, "ev")
    cwd = F.concat(F.lit("/home/my-"), "source_kind", F.lit("/src"))
    other = F.concat(F.lit("/tmp/"), "command")
    paths = F.when(F.col("git_repo").isNotNull(), F.array(other, F.concat(cwd, F.lit("/"), "git_repo", F.lit("/a.rs")))).otherwise(F.array(other))
    return e.select("id", T.recovered_cwd(F.translate(F.substring(cwd, 2, 1000), "/", "-"), paths).alias("cwd"))


_A7 = """WITH m AS (SELECT o_orderkey AS message_id, o_custkey AS session_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 7 END AS tokens FROM orders),
    p AS (SELECT DISTINCT m.session_id, l_orderkey AS message_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'tool' ELSE 'step-finish' END AS kind, l_returnflag AS body, m.tokens FROM lineitem JOIN m ON m.message_id = l_orderkey)
    SELECT p.session_id, string_agg(body, chr(10) ORDER BY p.message_id, n, body) FILTER (kind = 'text') AS texts, sum(CASE WHEN kind = 'step-finish' AND coalesce(p.tokens, 0) = 0 THEN 3 ELSE 0 END)::BIGINT + max(t.s)::BIGINT AS tokens FROM p LEFT JOIN (SELECT session_id, sum(coalesce(tokens, 0)) AS s FROM m GROUP BY 1) t ON t.session_id = p.session_id GROUP BY p.session_id"""


@register("a7_session_context", _A7)
def a7(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the messages of a session, their lines as parts."""
    k, n, o = F.col("l_orderkey"), F.col("l_linenumber"), F.col("o_orderkey")
    kind = F.when(n % 3 == 0, "text").when(n % 3 == 1, "tool").otherwise("step-finish")
    m = load(spark, d, "orders").select(o.alias("message_id"), F.col("o_custkey").alias("session_id"), F.when(o % 5 > 0, o % 7).alias("tokens"))
    p = load(spark, d, "lineitem").select(k.alias("message_id"), k.alias("time"), n.alias("part_id"), kind.alias("kind"), F.col("l_returnflag").alias("body"), F.lit(3).cast("bigint").alias("tokens")).distinct()
    p = p.join(m.select("message_id", "session_id"), "message_id")
    return T.session_context(p, m).select("session_id", F.nullif("texts", F.lit("")).alias("texts"), "tokens")


@register("a8_ci_payloads", with_roles("runs jobs", "SELECT r.id AS run_id, r.repo, j.id AS job_id, j.name AS job, CASE WHEN j.id % 2 = 0 THEN j.message END AS message FROM runs r LEFT JOIN (SELECT DISTINCT run_id, id, name, message FROM jobs) j ON j.run_id = r.id"))
def a8(spark: SparkSession, d: str) -> DataFrame:
    j = role(spark, d, "jobs").select("run_id", "id", "name", "message").distinct()
    nested = j.groupBy("run_id").agg(F.collect_list(F.struct("id", "name", F.when(F.col("id") % 2 == 0, F.array("message")).otherwise(F.array().cast("array<string>")).alias("annotations"))).alias("jobs"))
    r = role(spark, d, "runs").join(nested, F.col("id") == F.col("run_id"), "left")
    payloads = r.select(F.to_json(F.array(F.struct("id", "repo", "jobs"))).alias("body"))
    return T.ci_rows(payloads, "body")


@register("a9_browser_messages", with_roles("visits", "SELECT 'visit' AS kind, domain, split_part(url, '?', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url, timestamp FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: split_part(p, '=', 1) <> 'ref'), '&') AS q FROM visits WHERE lower(domain) LIKE 'th%.example.com') UNION ALL SELECT 'heartbeat', NULL, NULL, timestamp + 1 FROM visits WHERE id % 10 = 0"))
def a9(spark: SparkSession, d: str) -> DataFrame:
    v = role(spark, d, "visits")
    mine = v.filter(F.lower("domain").like("th%.example.com"))
    beats = v.filter("id % 10 = 0").select((F.col("timestamp") + 1).alias("timestamp"))
    return T.browser_messages(mine, beats, ["example.com"], "probe.local", ["ref"]).drop("probe_tag")


@register("a10_bounded_buffer", with_roles("ev", "SELECT session_id % 8 AS shard, count(*) FILTER (n <= 40) AS kept, count(*) FILTER (n > 40) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY timestamp // 86400000 ORDER BY timestamp, id) AS n FROM ev) GROUP BY 1"))
def a10(spark: SparkSession, d: str) -> DataFrame:
    b = T.bounded_buffer(role(spark, d, "ev").select("id", "timestamp", "session_id"), F.floor(F.col("timestamp") / 86_400_000), ["timestamp", "id"], 40)
    return b.groupBy((F.col("session_id") % 8).alias("shard")).agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if(F.col("dropped")).alias("dropped"))


@register("a12_fallback_days", with_roles("ev", "SELECT strftime(to_timestamp(timestamp // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1"))
def a12(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev").groupBy(K.utc_day(F.col("timestamp")).alias("day")).agg(F.count("*").alias("n"))


@register("a13_training_export", with_roles("nodes outcomes", "SELECT id, CAST(to_json({'messages': [{'role': 'system', 'content': 'Summarise the activity.'}, {'role': 'user', 'content': prompt}, {'role': 'assistant', 'content': answer}]}) AS VARCHAR) AS messages, CASE WHEN h < 8 THEN 'train' WHEN h = 8 THEN 'valid' ELSE 'test' END AS split FROM (SELECT n.id, n.embed_text AS prompt, max(o.outcome) AS answer, CAST('0x' || substr(md5(CAST(n.id AS VARCHAR) || ':0'), 1, 8) AS BIGINT) % 10 AS h FROM nodes n JOIN outcomes o ON o.node_id = n.id WHERE n.embed_text IS NOT NULL GROUP BY n.id, n.embed_text)"))
def a13(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes").select("id", F.col("embed_text").alias("prompt")).filter("prompt IS NOT NULL")
    o = role(spark, d, "outcomes").groupBy(F.col("node_id").alias("id")).agg(F.max("outcome").alias("answer"))
    return K.chat_triples(n, o, "id")


@register("a15_file_integrity", with_roles("nodes", r"SELECT uuid AS name, CASE WHEN regexp_matches(content, '^\s*$') THEN 'missing' WHEN trim(regexp_replace(content, '\s+', ' ', 'g')) <> content THEN 'changed' ELSE 'ok' END AS status FROM nodes WHERE content IS NOT NULL"))
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Files of a store that keeps words alone: texts with other white space than single spaces come back changed, those without a word are missing."""
    n = role(spark, d, "nodes").filter("content IS NOT NULL")
    manifest = n.select(F.col("uuid").alias("name"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    files = n.filter(~F.rlike("content", F.lit(r"^\s*$"))).select(F.col("uuid").alias("name"), F.trim(F.regexp_replace("content", r"\s+", " ")).cast("binary").alias("content"))
    return K.verify_files(files, manifest)


@register("a16_result_ingest", "SELECT user_id AS item, event_type AS kind, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), event_id) AS k FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2")
def a16(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    whole = F.to_json(F.struct(F.col("user_id").alias("item"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("k")))
    line = F.when(F.col("event_id") % 7 == 0, F.substring(whole, 1, 8)).otherwise(whole)
    return K.ingest_results(e.select("event_id", line.alias("line")), "line", "item bigint, kind string, k bigint", ["item", "kind"], "event_id")


@register("a17_dashboard_export", with_roles("ev_user", """SELECT source_kind, '{"n":' || CAST(count(*) AS VARCHAR) || ',"last":' || CAST(max(timestamp) AS VARCHAR) || '}' AS json FROM ev_user GROUP BY 1"""))
def a17(spark: SparkSession, d: str) -> DataFrame:
    return K.dashboard(role(spark, d, "ev_user").groupBy("source_kind").agg(F.count("*").alias("n"), F.max("timestamp").alias("last")), "source_kind")


@register("a18_scorecard", with_roles("ev_user", "SELECT source_kind, '| ' || source_kind || ' | ' || CAST(count(*) AS VARCHAR) || ' | ' || CAST(max(timestamp) AS VARCHAR) || ' |' AS line FROM ev_user GROUP BY 1"))
def a18(spark: SparkSession, d: str) -> DataFrame:
    g = role(spark, d, "ev_user").groupBy("source_kind").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    return K.scorecard(g, ["source_kind", "n", "last"]).select("source_kind", "line")


@register("a19_api_surface", with_roles("ev_user", "SELECT 'shell' AS source, id, timestamp, command AS summary FROM ev_user WHERE command ILIKE '%purchase%' AND timestamp >= 1706000000000 ORDER BY timestamp DESC, id LIMIT 25"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    from recollect.api import Engine

    return Engine(spark, d, now_ms=1_706_000_000_000 + 86_400_000).search_events("purchase", "shell", "1d", 25)


@register("a20_routes", with_roles("queue", "SELECT source, status, count(*) AS n FROM queue GROUP BY 1, 2"))
def a20(spark: SparkSession, d: str) -> DataFrame:
    from recollect.api import Engine

    return Engine(spark, d).queue_depths().filter("n > 0")


def _drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    return S.drain(stream, new_path(spark, "drained"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return S.event_stream(spark, d, "events.parquet")


@register("k11_dedup_stream", with_roles("ev", "SELECT session_id AS user_id, count(DISTINCT source_kind || ':' || CAST(timestamp // 86400000 AS VARCHAR)) AS kept FROM ev GROUP BY 1"))
def k11(spark: SparkSession, d: str) -> DataFrame:
    s = _stream(spark, d).withColumn("day", F.floor(F.col("timestamp") / 86_400_000))
    kept = _drained(spark, S.deduplicated(s, ["user_id", "event_type", "day"], "40 days").select("user_id", "event_type", "day"))
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"))


_K13 = "WITH g AS (SELECT *, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, id), 0) AS gap FROM ev), r AS (SELECT *, sum(CAST(gap > 21600000 AS INTEGER)) OVER (PARTITION BY session_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT session_id AS user_id, min(timestamp) AS start_time, max(timestamp) AS end_time, count(*) AS n FROM r GROUP BY session_id, run) SELECT * FROM s WHERE end_time + 21600000 <= (SELECT max(timestamp) FROM ev) - 120000"


@register("k13_session_close_stream", with_roles("ev", _K13))
def k13(spark: SparkSession, d: str) -> DataFrame:
    return _drained(spark, S.closed_sessions(_stream(spark, d), "user_id", "6 hours"))


_K14 = """b AS (SELECT source_kind AS source, timestamp FROM ev), lim AS (SELECT (max(timestamp) - 120000) // 300000 * 300000 AS until FROM ev),
    ends AS (SELECT unnest(generate_series((SELECT min(timestamp) // 300000 * 300000 FROM ev), (SELECT until FROM lim), 300000)) AS window_end)
    SELECT window_end, source, count(*) AS n FROM ends JOIN b ON b.timestamp >= window_end - 86400000 AND b.timestamp < window_end GROUP BY window_end, source"""


@register("k14_rolling_stream", with_roles("ev", f"WITH {_K14}"))
def k14(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the last 24 hours by source, every five minutes."""
    panes = _drained(spark, S.pane_counts(_stream(spark, d)))
    last = role(spark, d, "ev").agg(F.max("timestamp").alias("t")).first().t
    return S.sliding_counts(panes, (last - 120_000) // 300_000 * 300_000 if last is not None else 0)


@register("k8_micro_batch_flush", with_roles("ev", "SELECT source_kind AS source, count(*) AS n, max(timestamp) AS last, count(*) AS health_events, 0 AS failures FROM ev GROUP BY 1"))
def k8(spark: SparkSession, d: str) -> DataFrame:
    base = new_path(spark, "flush")
    health = S.StoredHealth(spark, f"{base}/health")

    def store(rows: DataFrame, epoch: int) -> None:
        rows.select("event_id", "source", "timestamp").write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = S.flush(_stream(spark, d), store, health.load, health.save).option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    stored = spark.read.parquet(f"{base}/out").groupBy("source").agg(F.count("*").alias("n"))
    return stored.join(health.load(), "source").select("source", "n", F.col("last_event_ts").alias("last"), F.col("events").alias("health_events"), F.col("consecutive_failures").alias("failures"))
