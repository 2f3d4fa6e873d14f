"""Registered scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import predicates as P
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.plans.joins import category_of
from recollect.sources.catalog import load, role, with_roles

from .registry import register

_RULE_SQL = [p for _, p in T.RULES]


def _sql_redact(x: str, rules: list[str] = _RULE_SQL) -> str:
    for p in rules:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


def _sql_hits(x: str) -> str:
    return " + ".join(f"len(regexp_extract_all({_sql_redact(x, _RULE_SQL[:k])}, '{p}'))" for k, p in enumerate(_RULE_SQL))


@register("h1_redact", with_roles("nodes", f"SELECT id, md5({_sql_redact('content')}) AS digest FROM nodes"))
def h1(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id", F.md5(T.redact(F.col("content")).cast("binary")).alias("digest"))


@register("h2_redact_counted", with_roles("nodes", f"SELECT id, md5({_sql_redact('content')}) AS digest, {_sql_hits('content')} AS hits FROM nodes"))
def h2(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes").select("id", T.redact_counted(F.col("content")).alias("r"))
    return n.select("id", F.md5(F.col("r.text").cast("binary")).alias("digest"), F.when(F.col("r.text").isNotNull(), F.col("r.count")).alias("hits"))


@register("h3_matching_rules", with_roles("nodes", "SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN '{n}' END" for n, p in T.RULES) + ") AS rules FROM nodes"))
def h3(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id", T.matching_rules(F.col("content")).alias("rules"))


@register("h4_strip_params", with_roles("visits", r"SELECT id, CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) || CASE WHEN q <> '' THEN '?' || q ELSE '' END ELSE url END AS url FROM (SELECT *, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1)) NOT IN ('ref', 'token')), '&') AS q FROM visits)"))
def h4(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "visits").select("id", T.strip_params(F.col("url"), ["REF", "token"]).alias("url"))


@register("h5_dedup_bucket", with_roles("visits", "SELECT id, url || ':' || CAST((timestamp // 60000) // 5 AS VARCHAR) AS dedup_key FROM visits"))
def h5(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "visits").select("id", F.concat("url", F.lit(":"), F.floor(F.floor(F.col("timestamp") / 60_000) / 5).cast("string")).alias("dedup_key"))


@register(
    "h6_canonical_entities",
    with_roles(
        "entities ev",
        r"""WITH x AS (SELECT id, CASE id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'project' ELSE 'tool' END AS kind, cwd || '/.claude/worktrees/agent-' || CAST(id % 5 AS VARCHAR) || CASE WHEN id % 4 = 0 THEN '' ELSE '/Lib/X.rs/' END AS v FROM ev),
        y AS (SELECT id, kind, regexp_replace(lower(v), '/+$', '') AS v FROM x),
        z AS (SELECT id, kind, CASE WHEN kind = 'tool' THEN v ELSE regexp_replace(regexp_replace(v, '(^|/)\.claude/worktrees/[^/]+$', ''), '(^|/)\.claude/worktrees/[^/]+/', '\1', 'g') END AS v FROM y)
        SELECT id, CASE WHEN kind = 'tool' THEN v WHEN v = '/home/u3/src' THEN 'src' WHEN kind <> 'project' AND starts_with(v, '/home/u3/src/') THEN substr(v, 14) ELSE v END AS canonical FROM z""",
    ),
)
def h6(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    e = role(spark, d, "ev").select("id", F.when(n % 3 == 0, "file").when(n % 3 == 1, "project").otherwise("tool").alias("kind"), F.concat("cwd", F.lit("/.claude/worktrees/agent-"), (n % 5).cast("string"), F.when(n % 4 == 0, "").otherwise("/Lib/X.rs/")).alias("v"))
    return e.select("id", T.canonicalize(F.col("kind"), F.col("v"), "/home/me", ["/home/u3/src"]).alias("canonical"))


_REMOTE = "CASE id % 4 WHEN 0 THEN 'git@github.com:org/repo' || CAST(id % 9 AS VARCHAR) || '.git' WHEN 1 THEN 'https://user:pw@github.com/org/repo' || CAST(id % 9 AS VARCHAR) || '/' WHEN 2 THEN 'ssh://git@host:22/org/repo' ELSE 'not a url' END"


def remotes(df: DataFrame) -> DataFrame:
    n = F.col("id")
    k = (n % 9).cast("string")
    return df.select("id", F.when(n % 4 == 0, F.concat(F.lit("git@github.com:org/repo"), k, F.lit(".git"))).when(n % 4 == 1, F.concat(F.lit("https://user:pw@github.com/org/repo"), k, F.lit("/"))).when(n % 4 == 2, "ssh://git@host:22/org/repo").otherwise("not a url").alias("remote"))


@register("h7_owner_repo", with_roles("ev", "SELECT id, CASE id % 4 WHEN 3 THEN NULL WHEN 2 THEN 'org/repo' ELSE 'org/repo' || CAST(id % 9 AS VARCHAR) END AS owner_repo FROM ev"))
def h7(spark: SparkSession, d: str) -> DataFrame:
    return remotes(role(spark, d, "ev")).select("id", T.owner_repo(F.col("remote")).alias("owner_repo"))


@register("h8_repository_identity", with_roles("ev", f"SELECT id, regexp_replace(regexp_replace({_REMOTE}, '^([a-z+]+://)[^@/]+@', '\\1'), '(\\.git)?/?$', '') AS identity FROM ev"))
def h8(spark: SparkSession, d: str) -> DataFrame:
    return remotes(role(spark, d, "ev")).select("id", T.repository_identity(F.col("remote"), F.lit("/x")).alias("identity"))


@register("h9_parse_annotation", with_roles("jobs", r"SELECT DISTINCT id, CASE WHEN regexp_matches(message, 'error\[E\d{4}\]') THEN 'cargo' WHEN name = 'lint' AND regexp_matches(message, '\b[A-Z]{1,4}\d{3,4}\b') THEN 'ruff' END AS tool, CASE WHEN regexp_matches(message, 'error\[E\d{4}\]') THEN regexp_extract(message, 'error\[(E\d{4})\]', 1) WHEN name = 'lint' AND regexp_matches(message, '\b[A-Z]{1,4}\d{3,4}\b') THEN regexp_extract(message, '\b([A-Z]{1,4}\d{3,4})\b', 1) END AS rule_id FROM jobs"))
def h9(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "jobs").select("id", T.parse_annotation(F.col("name"), F.col("message")).alias("a")).select("id", "a.tool", "a.rule_id").distinct()


@register("h10_path_prefix", with_roles("visits", "SELECT id, array_to_string(list_slice(list_filter(string_split(url, '/'), lambda x: x <> ''), 1, 2), '/') || '/' AS prefix FROM visits"))
def h10(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "visits").select("id", T.path_prefix(F.col("url")).alias("prefix"))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOKENS = f"""SELECT id, question, list_filter(regexp_extract_all(question, '[A-Za-z0-9_][A-Za-z0-9_./@:-]*'), lambda w: length(w) >= 2 AND lower(w) NOT IN ({_STOP})) AS w FROM questions"""


#: Common table expressions over questions; `phr` has each one's distinct tokens k, which its text is searched with.
PHRASES = f"""phr_t AS ({_TOKENS}), phr AS (SELECT id, question, list_slice(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(list_transform(w, lambda x: lower(x)), lower(w[i])) = i), lambda i: w[i]), 1, 16) AS k FROM phr_t)"""


@register("h11_fts_query", with_roles("questions", f"""WITH {PHRASES} SELECT id, array_to_string(list_concat(['"' || trim(question) || '"'], list_transform(k, lambda x: '"' || x || '"')), ' OR ') AS fts FROM phr"""))
def h11(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "questions").select("id", T.fts_query(F.col("question")).alias("fts"))


@register("h12_json_fields", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def h12(spark: SparkSession, d: str) -> DataFrame:
    from recollect.sources.catalog import load

    e = load(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint, missing string").alias("j"))
    return e.select("id", "j.k", "j.missing")


@register("h13_json_repair", with_roles("ev", "SELECT id, CASE WHEN id % 3 <> 2 THEN props END AS fixed FROM (SELECT event_id AS id, props FROM events)"))
def h13(spark: SparkSession, d: str) -> DataFrame:
    """Stored JSON texts as replies: in fences, bare, or cut off before their end."""
    reply = F.when(F.col("id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("id") % 3 == 1, F.col("props")).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    return load(spark, d, "events").withColumnRenamed("event_id", "id").select("id", T.repair_json_udf(reply).alias("fixed"))


@register("h14_first_json_object", with_roles("ev", "SELECT event_id AS id, CASE WHEN event_id % 4 < 2 THEN props END AS found FROM events"))
def h14(spark: SparkSession, d: str) -> DataFrame:
    """Stored JSON texts in prose: alone, before another, behind a brace that closes nothing, and behind one that never closes."""
    n = F.col("event_id") % 4
    reply = F.concat(F.when(n == 2, "} ").when(n == 3, "{ ").otherwise("said: "), "event_type", F.lit(" "), "props", F.when(n == 1, ' and {"more": 1}').otherwise(" done"))
    return load(spark, d, "events").select(F.col("event_id").alias("id"), T.first_json_object_udf(reply).alias("found"))


_REPLY = "outcome string, summary string, entities map<string, array<string>>"


# replies as a model gives them: stored texts put between quotes as they are, so a line end or a quote in one breaks the reply
_REPLIES = """r AS (SELECT n.id, n.source, '{"outcome": "' || coalesce(o.outcome, n.source) || '", "summary": "' || substring(n.content, 1, 80) || '", "entities": {"files": ' || to_json(list_filter(string_split(substring(n.content, 1, 200), ' '), lambda w: contains(w, '.'))) || '}}' AS reply FROM nodes n LEFT JOIN outcomes o ON o.node_id = n.id WHERE n.content IS NOT NULL),
    v AS (SELECT *, CASE WHEN NOT json_valid(reply) THEN 'invalid json' WHEN json_extract_string(CASE WHEN json_valid(reply) THEN reply ELSE '{}' END, '$.outcome') NOT IN ('success', 'partial', 'failure', 'unknown') THEN 'bad outcome' WHEN trim(json_extract_string(CASE WHEN json_valid(reply) THEN reply ELSE '{}' END, '$.summary')) = '' THEN 'empty summary' ELSE 'ok' END AS verdict FROM r)"""


@register("h15_enrichment_schema", with_roles("nodes outcomes", f"WITH {_REPLIES} SELECT id, verdict, CASE WHEN verdict = 'ok' THEN CAST(json_array_length(reply, '$.entities.files') AS INTEGER) ELSE 0 END AS files FROM v"))
def h15(spark: SparkSession, d: str) -> DataFrame:
    return validate_enrichment(replies(spark, d), "reply").select("id", "verdict", "files")


def replies(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes").filter("content IS NOT NULL").join(role(spark, d, "outcomes").select(F.col("node_id").alias("id"), "outcome"), "id", "left")
    files = F.filter(F.split(F.substring("content", 1, 200), " "), lambda w: F.contains(w, F.lit(".")))
    return n.select("id", "source", F.concat(F.lit('{"outcome": "'), F.coalesce("outcome", "source"), F.lit('", "summary": "'), F.substring("content", 1, 80), F.lit('", "entities": {"files": '), F.to_json(files), F.lit("}}")).alias("reply"))


def validate_enrichment(df: DataFrame, reply: str) -> DataFrame:
    """Adds verdict (ok, invalid json, bad outcome, empty summary) and the number of files named in a valid reply."""
    j = F.from_json(reply, _REPLY, {"mode": "PERMISSIVE"})
    out = df.withColumn("_j", j)
    verdict = F.when(F.col("_j.outcome").isNull() & F.col("_j.summary").isNull() | F.try_parse_json(F.col(reply)).isNull(), "invalid json").when(~F.col("_j.outcome").isin("success", "partial", "failure", "unknown"), "bad outcome").when(F.length(F.trim(F.coalesce("_j.summary", F.lit("")))) == 0, "empty summary").otherwise("ok")
    return out.withColumn("verdict", verdict).withColumn("files", F.when(F.col("verdict") == "ok", F.size(F.coalesce(F.col("_j.entities")["files"], F.array().cast("array<string>")))).otherwise(0)).drop("_j")


@register("h16_schema_validity_rate", with_roles("nodes outcomes", f"WITH {_REPLIES} SELECT source, round(avg(CAST(verdict = 'ok' AS INTEGER)), 6) AS valid FROM v GROUP BY source"))
def h16(spark: SparkSession, d: str) -> DataFrame:
    return validate_enrichment(replies(spark, d), "reply").groupBy("source").agg(F.round(F.avg((F.col("verdict") == "ok").cast("int")), 6).alias("valid"))


@register("h17_output_pathologies", with_roles("turns", "SELECT conv_id, turn, regexp_matches(x, '(?i)\\bI''?m sorry\\b|\\bas an AI\\b') AS refusal, length(trim(text)) < 4 AS is_trivial FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN 'I''m SORRY, ' || text ELSE text END AS x FROM turns)"))
def h17(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("I'm SORRY, "), "text")).otherwise(F.col("text"))
    return role(spark, d, "turns").select("conv_id", "turn", T.is_refusal(x).alias("refusal"), (F.length(F.trim("text")) < 4).alias("is_trivial"))


@register("h18_entity_sanity", with_roles("entities", r"SELECT type, round(avg(CAST(CASE type WHEN 'file' THEN regexp_matches(name, '[/\\]|^\.\w+$|\.\w{1,8}$') WHEN 'tool' THEN length(name) <= 40 AND len(regexp_extract_all(name, '\s+')) + 1 <= 3 AND NOT regexp_matches(name, '[.!?]\s*$') WHEN 'project' THEN NOT regexp_matches(name, '\s') ELSE true END AS INTEGER)), 6) AS sane FROM entities GROUP BY type"))
def h18(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "entities").groupBy("type").agg(F.round(F.avg(T.entity_sanity(F.col("type"), F.col("name")).cast("int")), 6).alias("sane"))


@register("h19_cosine_scores", with_roles("vectors", "SELECT v.id, round(least(greatest(1 - (1 - list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[]))) / 2, 0), 1), 6) AS score FROM vectors v, (SELECT vector FROM vectors WHERE id = 3) q"))
def h19(spark: SparkSession, d: str) -> DataFrame:
    v = role(spark, d, "vectors")
    q = v.filter("id = 3").select(F.col("vector").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("id", F.round(V.distance_score(1 - V.cosine(F.col("vector"), F.col("q"))), 6).alias("score"))  # one row


@register("h20_fit_vector", with_roles("vectors", "SELECT id, 70 AS size, round(CAST(list_sum(CAST(vector AS DOUBLE[])) AS DOUBLE), 6) AS total FROM vectors"))
def h20(spark: SparkSession, d: str) -> DataFrame:
    v = role(spark, d, "vectors").select("id", V.fit(F.col("vector"), 70).alias("x"))
    return v.select("id", F.size("x").alias("size"), F.round(F.aggregate("x", F.lit(0.0), lambda s, y: s + y.cast("double")), 6).alias("total"))


@register("h21_recency", with_roles("nodes", "SELECT id, round(0.6 + 0.4 * pow(0.5, greatest(1710000000000 - created_at, 0) / (86400000.0 * 90)), 9) AS multiplier FROM nodes"))
def h21(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id", F.round(V.recency(F.col("created_at"), 1_710_000_000_000, 90, 0.6), 9).alias("multiplier"))


#: Identifiers of all kinds of evidence, and texts that are none.
_REFS = [("ev", "'shell-'", "id"), ("visits", "'browser-'", "id"), ("turns", "'claude-'", "conv_id"), ("runs", "'workflow-'", "id"), ("memdocs", "'memory-'", "id"), ("turns", "'opencode-'", "turn"), ("ev", "command", None), ("visits", "url", None)]
_REFS_SQL = "refs AS (" + " UNION ".join(f"SELECT {head}{f' || CAST({i} AS VARCHAR)' if i else ''} AS ref FROM {r}" for r, head, i in _REFS) + ")"
_REF_ROLES = "ev visits turns runs memdocs"


def refs(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, head, i in _REFS:
        one = role(spark, d, name).select(F.concat(F.expr(head), F.col(i).cast("string")).alias("ref") if i else F.col(head).alias("ref"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


@register("h22_source_kind", with_roles(_REF_ROLES, f"WITH {_REFS_SQL} SELECT ref, CASE split_part(ref, '-', 1) WHEN 'shell' THEN 'shell' WHEN 'browser' THEN 'browser' WHEN 'workflow' THEN 'workflow' WHEN 'claude' THEN 'agentic' WHEN 'opencode' THEN 'agentic' WHEN 'memory' THEN 'memory' END AS kind FROM refs WHERE ref IS NOT NULL"))
def h22(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).filter("ref IS NOT NULL").select("ref", T.source_kind_of(F.col("ref")).alias("kind"))


@register("h23_parse_ref", with_roles(_REF_ROLES, f"WITH {_REFS_SQL} SELECT ref, CASE WHEN ok THEN split_part(ref, '-', 1) END AS kind, CASE WHEN ok THEN CAST(split_part(ref, '-', 2) AS BIGINT) END AS ref_id FROM (SELECT ref, regexp_full_match(ref, '(shell|agentic|browser|workflow|memory)-[0-9]+') AS ok FROM refs WHERE ref IS NOT NULL)"))
def h23(spark: SparkSession, d: str) -> DataFrame:
    return refs(spark, d).filter("ref IS NOT NULL").select("ref", T.parse_ref(F.col("ref")).alias("r")).select("ref", "r.kind", F.col("r.id").alias("ref_id"))


def evidence_packets(events: DataFrame, visits: DataFrame) -> DataFrame:
    """ref, source_kind, captured_at, excerpt of shell and page evidence; excerpts of 500 characters at most."""
    e = events.select(F.concat(F.lit("shell-"), F.col("id").cast("string")).alias("ref"), F.lit("shell").alias("source_kind"), F.col("timestamp").alias("captured_at"), P.truncated(F.concat("command", F.lit(" (exit "), F.col("exit_code").cast("string"), F.lit(")")), 500).alias("excerpt"))
    v = visits.select(F.concat(F.lit("browser-"), F.col("id").cast("string")).alias("ref"), F.lit("browser").alias("source_kind"), F.col("timestamp").alias("captured_at"), P.truncated(F.concat_ws(" — ", F.nullif("title", F.lit("")), "url"), 500).alias("excerpt"))
    return e.unionByName(v)


@register("h24_evidence_packets", with_roles("ev_user visits_user", "SELECT 'shell-' || CAST(id AS VARCHAR) AS ref, 'shell' AS source_kind, timestamp AS captured_at, command || ' (exit ' || CAST(exit_code AS VARCHAR) || ')' AS excerpt FROM ev_user UNION ALL SELECT 'browser-' || CAST(id AS VARCHAR), 'browser', timestamp, CASE WHEN length(x) > 500 THEN substring(x, 1, 499) || '…' ELSE x END FROM (SELECT id, timestamp, concat_ws(' — ', nullif(title, ''), url) AS x FROM visits_user)"))
def h24(spark: SparkSession, d: str) -> DataFrame:
    return evidence_packets(role(spark, d, "ev_user"), role(spark, d, "visits_user"))


@register("h28_human_durations", with_roles("ev", "SELECT id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || 's' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age FROM (SELECT id, (1706659200000 - timestamp) // 1000 AS s FROM ev)"))
def h28(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev").select("id", T.human_duration(F.lit(1706659200000) - F.col("timestamp")).alias("age"))


_H29 = r"""WITH t AS (SELECT id, '### ' || source || chr(10) || content || chr(10) AS one, '## ' || node_type || chr(10) || uuid AS two FROM nodes WHERE content IS NOT NULL)
    SELECT id, 0 AS ordinal, source AS heading_path, regexp_replace(one, '\s+$', '') AS content, 0 AS "start", CAST(length(one) AS INTEGER) AS "end" FROM t JOIN (SELECT id, source FROM nodes) USING (id)
    UNION ALL SELECT id, 1, source || ' > ' || node_type, two, CAST(length(one) AS INTEGER), CAST(length(one) + length(two) AS INTEGER) FROM t JOIN (SELECT id, source, node_type FROM nodes) USING (id)"""


@register("h29_heading_chunks", with_roles("nodes", _H29))
def h29(spark: SparkSession, d: str) -> DataFrame:
    """Stored texts under a heading of the third level, then one of the second, which stands under the first title."""
    doc = F.concat(F.lit("### "), "source", F.lit("\n"), "content", F.lit("\n## "), "node_type", F.lit("\n"), "uuid")
    n = role(spark, d, "nodes").filter("content IS NOT NULL").select("id", doc.alias("doc"))
    return T.sections_of(n, "doc").drop("doc")


@register("h30_token_windows", with_roles("nodes", r"SELECT id, len(w) AS words, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(ceil((len(w) - 12) / 36.0) AS BIGINT)) END AS windows, array_to_string(list_slice(w, 37, 84), ' ') AS second FROM (SELECT id, list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '') AS w FROM nodes) WHERE len(w) > 60"))
def h30(spark: SparkSession, d: str) -> DataFrame:
    n = role(spark, d, "nodes").withColumn("w", F.size(F.filter(F.split("content", r"\s+"), lambda x: x != ""))).filter("w > 60")
    x = n.select("id", F.col("w").cast("bigint").alias("words"), T.token_windows(F.col("content")).alias("t"))
    return x.select("id", "words", F.size("t").cast("bigint").alias("windows"), F.element_at("t", 2).alias("second"))


_H31 = """WITH t AS (SELECT page_id AS id, regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\\2](\\1)', 'g') AS md FROM pages)
    SELECT id, unnest(regexp_extract_all(md, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 1)) AS label, unnest(regexp_extract_all(md, '\\[([^\\]]*)\\]\\(([^)]+)\\)', 2)) AS target FROM t"""


@register("h31_markdown_links", _H31)
def h31(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages, their anchors written the Markdown way."""
    from recollect.sources.catalog import load

    md = F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)")
    return load(spark, d, "pages").select(F.col("page_id").alias("id"), F.explode(T.markdown_links(md)).alias("l")).select("id", "l.label", "l.target")


def resolve_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds resolution: external, resolved, ambiguous, circular or unresolved. links: source_path, target; docs: source_path."""
    by_name = docs.select(F.element_at(F.split("source_path", "/"), -1).alias("_name"), F.col("source_path").alias("_path")).groupBy("_name").agg(F.count("*").alias("_n"), F.min("_path").alias("_path"))
    j = links.join(by_name, F.element_at(F.split("target", "/"), -1) == F.col("_name"), "left")
    status = F.when(F.rlike("target", F.lit("^[a-z]+:")), "external").when(F.col("_n") > 1, "ambiguous").when(F.col("_path") == F.col("source_path"), "circular").when(F.col("_n") == 1, "resolved").otherwise("unresolved")
    return j.withColumn("resolution", status).drop("_name", "_n", "_path")


@register("h32_link_resolution", with_roles("memdocs", "SELECT m.id, CASE WHEN m.id % 4 = 0 THEN 'external' WHEN m.id % 4 = 1 THEN 'circular' WHEN EXISTS (SELECT 1 FROM memdocs x WHERE x.source_path = 'memory/feedback_' || CAST(m.id + 5 AS VARCHAR) || '.md') THEN 'resolved' ELSE 'unresolved' END AS resolution FROM memdocs m"))
def h32(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs").select("id", "source_path")
    n = F.col("id")
    links = m.withColumn("target", F.when(n % 4 == 0, "https://e.org/a.md").when(n % 4 == 1, F.col("source_path")).otherwise(F.concat(F.lit("./feedback_"), (n + 5).cast("string"), F.lit(".md"))))
    return resolve_links(links, m).select("id", "resolution")


@register("h33_category", with_roles("memdocs", "SELECT id, CASE id % 5 WHEN 0 THEN 'feedback' WHEN 1 THEN 'project' WHEN 2 THEN 'reference' END AS category FROM memdocs"))
def h33(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "memdocs").select("id", category_of(F.col("source_path")).alias("category"))


_H34 = r"""WITH l AS (SELECT id, string_split(content, chr(10)) AS l FROM memdocs WHERE content IS NOT NULL), k AS (SELECT *, len(l) AS n, least(3, len(l)) AS c FROM l),
    x AS (SELECT id, '--- previous+++ current@@ -' || (n - c + 1) || ',' || (c + 1) || ' +' || (n - c + 1) || ',' || (c + 2) || ' @@' || array_to_string([' ' || y || chr(10) FOR y IN list_slice(l, n - c + 1, n)], '') || '-old ' || id || '+new ' || id || chr(10) || '+more' AS diff FROM k)
    SELECT id, '2 line(s) added, 1 line(s) removed' AS summary, CASE WHEN length(diff) > 16384 THEN substring(diff, 1, 16384) || chr(10) || '… (diff truncated)' || chr(10) ELSE diff END AS diff FROM x"""


@register("h34_diff_summary", with_roles("memdocs", _H34))
def h34(spark: SparkSession, d: str) -> DataFrame:
    """Stored texts with another end: one line goes, two come."""
    n = F.col("id").cast("string")
    old, new = F.concat("content", F.lit("\nold "), n), F.concat("content", F.lit("\nnew "), n, F.lit("\nmore"))
    return role(spark, d, "memdocs").filter("content IS NOT NULL").select("id", T.diff_summary_udf(old, new).alias("s")).select("id", "s.summary", "s.diff")


@register("h35_content_hash", with_roles("nodes", r"SELECT id, sha256(content) AS hash, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS words FROM nodes"))
def h35(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id", F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")).cast("bigint").alias("words"))


_H36 = """WITH l AS (SELECT id, unnest([1, 2, 3]) AS i, unnest([length(embed_text), length(content), length(source)]) AS n FROM nodes WHERE content IS NOT NULL), t AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS r FROM l),
    f AS (SELECT *, 600 * n // total AS c FROM t), g AS (SELECT *, c + CAST(r <= 600 - sum(c) OVER (PARTITION BY id) AS INTEGER) AS g FROM f),
    h AS (SELECT id, i, CASE WHEN g = 0 AND n > 0 THEN 1 WHEN r = 1 THEN g - count(*) FILTER (g = 0 AND n > 0) OVER (PARTITION BY id) ELSE g END AS g FROM g)
    SELECT id, CAST(max(g) FILTER (i = 1) AS INTEGER) AS embed, CAST(max(g) FILTER (i = 2) AS INTEGER) AS command, CAST(max(g) FILTER (i = 3) AS INTEGER) AS design FROM h GROUP BY id"""


@register("h36_payload_caps", with_roles("nodes", _H36))
def h36(spark: SparkSession, d: str) -> DataFrame:
    e = role(spark, d, "nodes").filter("content IS NOT NULL").select("id", F.array(F.length("embed_text"), F.length("content"), F.length("source")).alias("l"), F.lit(600).alias("b"))
    return e.select("id", T.payload_caps(F.col("l"), F.col("b")).alias("c")).select("id", F.col("c")[0].alias("embed"), F.col("c")[1].alias("command"), F.col("c")[2].alias("design"))


def entities_line(names, most: int = 500):
    """Names joined by commas, cut between names so that it and an ellipsis fit in `most` characters."""
    fold = F.aggregate(names, F.struct(F.lit("").alias("t"), F.lit(False).alias("cut")), lambda s, x: F.when(s["cut"], s).when(F.length(s["t"]) + F.length(x) + 5 > most, F.struct(F.concat(s["t"], F.lit(", …")).alias("t"), F.lit(True).alias("cut"))).otherwise(F.struct(F.when(s["t"] == "", x).otherwise(F.concat(s["t"], F.lit(", "), x)).alias("t"), F.lit(False).alias("cut"))), lambda s: s["t"])
    return fold


@register("h37_entities_line", with_roles("node_entities entities", "SELECT node_id, string_agg(name, ', ' ORDER BY name) AS line FROM (SELECT DISTINCT l.node_id, e.name FROM node_entities l JOIN entities e ON e.id = l.entity_id) GROUP BY node_id HAVING sum(length(name) + 2) < 450"))
def h37(spark: SparkSession, d: str) -> DataFrame:
    j = role(spark, d, "node_entities").join(role(spark, d, "entities").select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("node_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    short = j.filter(F.aggregate("names", F.lit(0), lambda s, x: s + F.length(x) + 2) < 450)
    return short.select("node_id", entities_line(F.col("names")).alias("line"))


@register("h38_context_lines", with_roles("nodes outcomes", "SELECT n.id, concat_ws(chr(10), '## ' || n.uuid, 'Type: ' || n.node_type, CASE WHEN o.outcome IS NOT NULL THEN 'Outcome: ' || o.outcome END, substring(n.embed_text, 1, 120)) AS block FROM nodes n LEFT JOIN (SELECT node_id, max(outcome) AS outcome FROM outcomes GROUP BY node_id) o ON o.node_id = n.id"))
def h38(spark: SparkSession, d: str) -> DataFrame:
    o = role(spark, d, "outcomes").groupBy("node_id").agg(F.max("outcome").alias("outcome"))
    n = role(spark, d, "nodes").join(o, F.col("id") == F.col("node_id"), "left")
    return n.select("id", context_block().alias("block"))


def context_block():
    return F.concat_ws("\n", F.concat(F.lit("## "), "uuid"), F.concat(F.lit("Type: "), "node_type"), F.concat(F.lit("Outcome: "), "outcome"), F.substring("embed_text", 1, 120))


_H39 = """WITH c AS (SELECT 'Bash' AS name, command AS arg FROM ev UNION SELECT 'Read', url FROM visits UNION SELECT 'Grep', text FROM turns UNION SELECT canonical, name FROM entities) SELECT CASE WHEN arg IS NULL THEN name ELSE name || ': ' || substring(arg, 1, 200) END AS summary, count(*) AS calls FROM c GROUP BY 1"""


@register("h39_tool_call_summary", with_roles("ev visits turns entities", _H39))
def h39(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose arguments are stored texts, as JSON; how many distinct calls each line stands for."""
    call = lambda r, name, key, value: role(spark, d, r).select(F.to_json(F.struct(name.alias("name"), F.struct(F.col(value).alias(key)).alias("input"))).alias("call"))
    calls = call("ev", F.lit("Bash"), "command", "command").unionByName(call("visits", F.lit("Read"), "file_path", "url")).unionByName(call("turns", F.lit("Grep"), "pattern", "text")).unionByName(call("entities", F.col("canonical"), "description", "name"))
    return calls.distinct().groupBy(tool_summary(F.col("call")).alias("summary")).agg(F.count("*").alias("calls"))


def tool_summary(call_json):
    """One line for a tool call: its name, and the path, command or pattern it was given."""
    j = F.from_json(call_json, "name string, input struct<file_path:string,command:string,pattern:string,description:string>")
    arg = F.coalesce(j["input"]["file_path"], j["input"]["command"], j["input"]["pattern"], j["input"]["description"])
    return F.when(arg.isNotNull(), F.concat(j["name"], F.lit(": "), F.substring(arg, 1, 200))).otherwise(j["name"])


@register("h40_actor_labels", with_roles("ev", "SELECT id, 'user ' || CAST(session_id AS VARCHAR) || ' @ ' || cwd AS actor, CAST(duration_ms AS VARCHAR) || 'ms' AS detail FROM ev"))
def h40(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "ev").select("id", F.concat(F.lit("user "), F.col("session_id").cast("string"), F.lit(" @ "), "cwd").alias("actor"), F.concat(F.col("duration_ms").cast("string"), F.lit("ms")).alias("detail"))


_H41 = """WITH s AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || CASE WHEN user_id % 2 = 0 THEN 'Z' ELSE '+00:00' END AS s FROM events UNION SELECT event_type FROM events UNION SELECT url FROM pages UNION SELECT substring(text, 1, 24) FROM conversations)
    SELECT s AS text, coalesce(epoch_ms(try_strptime(replace(s, '+00:00', 'Z'), '%Y-%m-%dT%H:%M:%S.%gZ')), 0) AS ms FROM s WHERE s IS NOT NULL"""


@register("h41_iso_parse", _H41)
def h41(spark: SparkSession, d: str) -> DataFrame:
    """Times of stored events, written both ways, among texts that are none."""
    from recollect.sources.catalog import load

    e = load(spark, d, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.when(F.col("user_id") % 2 == 0, "Z").otherwise("+00:00"))
    texts = e.select(iso.alias("text")).unionByName(e.select(F.col("event_type").alias("text"))).unionByName(load(spark, d, "pages").select(F.col("url").alias("text"))).unionByName(load(spark, d, "conversations").select(F.substring("text", 1, 24).alias("text")))
    return texts.distinct().filter("text IS NOT NULL").select("text", T.iso_ms(F.col("text")).alias("ms"))


@register("h42_retry_state", with_roles("queue", "SELECT id, CASE WHEN retry_count + 1 >= max_retries THEN 'failed' ELSE 'pending' END AS state FROM queue"))
def h42(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "queue").select("id", P.retry_state(F.col("retry_count"), F.col("max_retries")).alias("state"))


@register("h43_domain_allowed", with_roles("visits", "SELECT id, lower(domain) = 'example.com' OR ends_with(lower(domain), '.example.com') AS allowed FROM visits"))
def h43(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "visits").select("id", P.domain_allowed(F.col("domain"), ["Example.COM"]).alias("allowed"))


@register("h44_search_query", with_roles("visits", "SELECT id, CASE WHEN NOT contains(url, '?') AND length(domain) % 4 > 0 THEN nullif(trim(title), '') END AS query FROM visits"))
def h44(spark: SparkSession, d: str) -> DataFrame:
    """Referrers: stored addresses that have a query of their own, and result pages that were asked for a stored title."""
    engines = F.array(*[F.lit(x) for x in ("https://github.com/org?q=", "https://www.google.com/search?hl=en&q=", "https://duckduckgo.com/?q=", "https://github.com/search?q=")])
    made = F.concat(F.element_at(engines, F.length("domain") % 4 + 1), F.url_encode("title"))
    return role(spark, d, "visits").select("id", T.search_query(F.when(F.contains("url", F.lit("?")), F.col("url")).otherwise(made)).alias("query"))


@register("h45_page_text", r"SELECT page_id AS id, least(length(t), 51200) AS n, substring(t, 1, 51200) AS body FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<nav\b.*?</nav\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages) q")
def h45(spark: SparkSession, d: str) -> DataFrame:
    from recollect.sources.catalog import load

    p = load(spark, d, "pages").select(F.col("page_id").alias("id"), T.main_text(F.col("html")).alias("t"))
    return p.select("id", F.length("t").cast("bigint").alias("n"), F.col("t").alias("body"))


@register("h46_ordered_hash", with_roles("nodes outcomes", "SELECT id, sha256(concat_ws('|', uuid, node_type, embed_text)) AS hash FROM nodes"))
def h46(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "nodes").select("id", F.sha2(F.concat_ws("|", "uuid", "node_type", "embed_text").cast("binary"), 256).alias("hash"))


@register("h47_slug_decode", with_roles("ev", "SELECT id, replace(replace(cwd, '/', '-'), '-', '/') AS folder, false AS uuid_stem FROM ev"))
def h47(spark: SparkSession, d: str) -> DataFrame:
    slug = F.translate("cwd", "/", "-")
    return role(spark, d, "ev").select("id", T.project_of_slug(slug).alias("folder"), T.is_uuid(slug).alias("uuid_stem"))


_GLOB = "SELECT id, source_path FROM memdocs WHERE source_path LIKE 'memory/%.md' AND NOT regexp_matches(source_path, '^memory/notes_[^/]*$')"


@register("h48_globs", with_roles("memdocs", _GLOB))
def h48(spark: SparkSession, d: str) -> DataFrame:
    m = role(spark, d, "memdocs").select("id", "source_path")
    return m.filter(P.path_selected(F.col("source_path"), ["memory/*.md"], ["memory/notes_*"]))


@register("a11_root_discovery", with_roles("memdocs", f"SELECT DISTINCT 'memory' AS root, count(*) OVER () AS files FROM ({_GLOB})"))
def a11(spark: SparkSession, d: str) -> DataFrame:
    return h48(spark, d).groupBy(F.regexp_extract("source_path", "^(.*)/[^/]*$", 1).alias("root")).agg(F.count("*").alias("files"))
