"""Agent transcripts and other files as DataFrames: discovery by path, tolerant JSON lines, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NOISE = ("file-history-snapshot", "progress", "queue-operation", "summary")
ENTRY = "type string, timestamp string, cwd string, gitBranch string, message struct<role:string,content:string>"


def discover(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """path and length of the files under a folder, at any depth. No content is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of JSON-lines files. Line numbers come from one file's own rows: files are read whole lines at a time and numbered by offset order in the file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), F.col("value").alias("line"))
    w = Window.partitionBy("path").orderBy("_b", "_i")
    return lines.withColumn("line_no", F.row_number().over(w)).select("path", "line_no", "line")


def session_of_path(path: Column) -> Column:
    """Struct (project_dir, session_id, is_subagent, parent): `<project>/<session>.jsonl`, or `<project>/<session>/subagents/<agent>.jsonl`."""
    sub = r"([^/]+)/([^/]+)/subagents/([^/]+)\.jsonl$"
    main = r"([^/]+)/([^/]+)\.jsonl$"
    is_sub = F.rlike(path, F.lit(sub))
    pick = lambda p, g: F.regexp_extract(path, p, g)
    return F.struct(
        F.when(is_sub, pick(sub, 1)).otherwise(pick(main, 1)).alias("project_dir"),
        F.when(is_sub, pick(sub, 3)).otherwise(pick(main, 2)).alias("session_id"),
        is_sub.alias("is_subagent"),
        F.when(is_sub, pick(sub, 2)).alias("parent"),
    )


def tolerant_entries(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of the lines that are JSON objects with a type that is no noise; other lines are left out."""
    j = lines.withColumn("entry", F.from_json(line, ENTRY)).filter(F.col("entry.type").isNotNull())
    return j.filter(~F.col("entry.type").isin(*NOISE)).drop(line)


def rollout_identity(metas: DataFrame, path: str, order: str, value: str) -> DataFrame:
    """path, session_id, parent_id: the first and second distinct id of a file; without any, the file's stem, or its UUID ending."""
    seen = metas.filter(F.col(value).isNotNull()).groupBy(path, value).agg(F.min(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(path).orderBy("_o", value))
    nth = lambda n: F.max(F.when(F.col("_n") == n, F.col(value))).alias(f"_{n}")
    ids = metas.select(path).distinct().join(seen.withColumn("_n", rank).filter("_n <= 2").groupBy(path).agg(nth(1), nth(2)), path, "left")
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.jsonl)?$", 1)
    tail = F.regexp_extract(stem, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$", 1)
    fallback = F.when(tail != "", tail).otherwise(stem)
    return ids.select(path, F.coalesce("_1", fallback).alias("session_id"), F.col("_2").alias("parent_id"))


def recovered_cwd(slug: Column, paths: Column) -> Column:
    """The first ancestor of a tool's path whose `/` to `-` form is the slug; without one, the slug decoded plainly."""
    ancestors = F.flatten(F.transform(paths, lambda p: F.transform(F.sequence(F.lit(2), F.greatest(F.size(F.split(p, "/")), F.lit(2))), lambda n: F.array_join(F.slice(F.split(p, "/"), F.lit(1), n), "/"))))
    hit = F.filter(ancestors, lambda a: F.regexp_replace(F.translate(a, "/", "-"), "^-", "") == F.regexp_replace(slug, "^-", ""))
    return F.coalesce(F.get(hit, F.lit(0)), F.concat(F.lit("/"), F.translate(F.regexp_replace(slug, "^-", ""), "-", "/")))


def session_context(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, texts, tools, tokens: parts joined to their message, in order of time and id; repeated tools once; step tokens count only where the message has none."""
    j = parts.join(messages.select("message_id", F.col("tokens").alias("_mt")), "message_id", "left")
    at = F.struct("time", "part_id")
    g = j.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct(at.alias("at"), F.col("body").alias("v"))))).alias("_t"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "tool", F.struct(at.alias("at"), F.col("body").alias("v"))))).alias("_k"),
        F.sum(F.when(F.col("kind") == "step-finish", F.when(F.coalesce("_mt", F.lit(0)) == 0, F.col("tokens")).otherwise(0)).otherwise(0)).alias("_s"),
    )
    m = messages.groupBy("session_id").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("_m"))
    value = lambda c: F.transform(c, lambda s: s["v"])
    return g.join(m, "session_id", "left").select("session_id", F.array_join(value("_t"), "\n").alias("texts"), F.array_join(F.array_distinct(value("_k")), ",").alias("tools"), (F.col("_s") + F.coalesce("_m", F.lit(0))).alias("tokens"))


CI = "array<struct<id:bigint,repo:string,jobs:array<struct<id:bigint,name:string,annotations:array<string>>>>>"


def ci_rows(payloads: DataFrame, column: str) -> DataFrame:
    """run_id, repo, job_id, job, message of CI payloads (runs, jobs, annotations nested); runs and jobs without children stay."""
    runs = payloads.select(F.explode(F.from_json(column, CI)).alias("r"))
    jobs = runs.select(F.col("r.id").alias("run_id"), "r.repo", F.explode_outer("r.jobs").alias("j"))
    return jobs.select("run_id", "repo", F.col("j.id").alias("job_id"), F.col("j.name").alias("job"), F.explode_outer("j.annotations").alias("message"))


def browser_messages(visits: DataFrame, heartbeats: DataFrame, allowed: list[str], probe_domain: str, params: list[str]) -> DataFrame:
    """kind, domain, url, timestamp, probe_tag: visits of allowed domains (the probe's always) with parameters stripped, and heartbeats. A probe tag counts on the probe's domain alone."""
    from recollect.functions.predicates import domain_allowed
    from recollect.functions.text import strip_params

    v = visits.filter(domain_allowed(F.col("domain"), allowed) | (F.col("domain") == probe_domain))
    v = v.select(F.lit("visit").alias("kind"), "domain", strip_params(F.col("url"), params).alias("url"), "timestamp", F.when(F.col("domain") == probe_domain, F.col("probe_tag")).alias("probe_tag"))
    none = F.lit(None).cast("string")
    return v.unionByName(heartbeats.select(F.lit("heartbeat").alias("kind"), none.alias("domain"), none.alias("url"), "timestamp", none.alias("probe_tag")))


def bounded_buffer(events: DataFrame, bucket: Column, order: list[str], cap: int) -> DataFrame:
    """Rows with `dropped`: of each flush interval only the first `cap` fit in the buffer."""
    w = Window.partitionBy("_bucket").orderBy(*order)
    return events.withColumn("_bucket", bucket).withColumn("dropped", F.row_number().over(w) > cap).drop("_bucket")
