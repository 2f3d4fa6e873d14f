"""Upserts, merges and lifecycles as pure functions from state and changes to state: immutable tables, explicit now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.text import PATH_TYPES


def latest_wins(rows: DataFrame, keys: list[str], order: list[str], frozen: list[str], fresh: list[str]) -> DataFrame:
    """One row for each key: `frozen` columns of the earliest row, `fresh` ones of the latest, by one aggregate with map-side combining."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(*[F.min_by(c, at).alias(c) for c in frozen], *[F.max_by(c, at).alias(c) for c in fresh])


def insert_or_ignore(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key stays. A window keeps whole rows; its limit is applied before the shuffle."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """type, canonical, name, first_seen, last_seen from mentions (type, canonical, name, seen_at). A name with a worktree path is polluted: the first clean one is shown if there is any."""
    dirty = F.col("name").contains(".claude/worktrees/") & F.col("type").isin(*PATH_TYPES)
    return mentions.groupBy("type", "canonical").agg(F.min_by("name", F.struct(dirty, "seen_at", "name")).alias("name"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


def survivors(rows: DataFrame, key: str, identity: list[str | Column], order: list[str] | None = None) -> DataFrame:
    """Map (loser, survivor) of rows of equal identity (nulls equal): the first by `order`, or the smallest key, survives. The survivor of a group is found by an aggregate, and rows are joined to it by a hash of the identity and the identity itself."""
    parts = [F.col(c) if isinstance(c, str) else c for c in identity]
    keyed = rows.select(key, *(order or []), F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).alias("_id"))
    first = keyed.groupBy("_id").agg(F.min_by(key, F.struct(*(order or []), key)).alias("survivor"), F.count("*").alias("_n")).filter("_n > 1")
    return keyed.join(first, keyed["_id"].eqNullSafe(first["_id"])).filter(F.col(key) != F.col("survivor")).select(F.col(key).alias("loser"), "survivor")


def remap_edges(edges: DataFrame, losers: DataFrame, node: str) -> DataFrame:
    """Edges with losers replaced by their survivors, without repeats."""
    j = edges.join(losers, edges[node] == losers["loser"], "left")
    return j.withColumn(node, F.coalesce("survivor", node)).drop("loser", "survivor").distinct()


def drop_losers(rows: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    return rows.join(losers.select(F.col("loser").alias(key)), key, "left_anti")


def replace_prior(nodes: DataFrame, links: DataFrame, sessions: DataFrame, node: str, session: str) -> DataFrame:
    """Nodes without those that hang solely on the given sessions."""
    from .joins import solely_linked

    return nodes.join(solely_linked(links, sessions, node, session), node, "left_anti")


def backfill(rows: DataFrame, mapping: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls of a column filled from a map of distinct keys."""
    return rows.join(mapping.select(key, F.col(column).alias("_m")), key, "left").withColumn(column, F.coalesce(column, "_m")).drop("_m")


def merge_health(rows: DataFrame) -> DataFrame:
    """One row for each source from legacy and canonical rows: largest times, probe fields of the later run (ties to the canonical row), message of the later error."""
    run = F.struct(F.coalesce("probe_last_run_ts", F.lit(-1)), "canonical", F.coalesce("probe_lag_ms", F.lit(-1)))  # the last key settles ties
    err = F.struct(F.coalesce("last_error_ts", F.lit(-1)), "canonical", F.coalesce("last_error_msg", F.lit("")))
    return rows.groupBy("source").agg(
        F.max("last_event_ts").alias("last_event_ts"),
        F.max("last_error_ts").alias("last_error_ts"),
        F.max_by(F.struct("probe_ok", "probe_lag_ms", "probe_last_run_ts"), run).alias("_p"),
        F.max_by("last_error_msg", err).alias("last_error_msg"),
    ).select("source", "last_event_ts", "last_error_ts", "_p.probe_ok", "_p.probe_lag_ms", "_p.probe_last_run_ts", "last_error_msg")


def detect_renames(gone: DataFrame, present: DataFrame) -> DataFrame:
    """old_path, new_path where exactly one present document of the repository has the vanished one's hash. Both: repository, path, hash."""
    a = gone.select("repository", F.col("path").alias("old_path"), "hash")
    one = present.groupBy("repository", "hash").agg(F.count("*").alias("_n"), F.min("path").alias("new_path")).filter("_n = 1")
    return a.join(one, ["repository", "hash"]).select("repository", "old_path", "new_path")


def ingest_snapshot(stored: DataFrame, files: DataFrame, now_ms: int) -> DataFrame:
    """repository, path, action (unchanged, new_revision, new_document, absent), revision_number after ingest. stored: repository, path, hash, revision_number; files: repository, path, hash."""
    s = stored.select("repository", "path", F.col("hash").alias("_old"), F.col("revision_number").alias("_rev"))
    j = s.join(files.select("repository", "path", F.col("hash").alias("_new")), ["repository", "path"], "full")
    action = F.when(F.col("_new").isNull(), "absent").when(F.col("_old").isNull(), "new_document").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("new_revision")
    number = F.coalesce("_rev", F.lit(0)) + action.isin("new_document", "new_revision").cast("int")
    return j.select("repository", "path", action.alias("action"), number.cast("bigint").alias("revision_number"), F.lit(now_ms).alias("observed_at"))


def tombstone(state: Column, absent_polls: Column, seen: Column, polls: int = 3) -> Column:
    """Next state of a document after a poll: seen is active; absent goes to unavailable, and after `polls` absences to tombstoned."""
    return F.when(seen, "active").when(state == "tombstoned", "tombstoned").when(absent_polls + 1 >= polls, "tombstoned").otherwise("unavailable")


def publishable(projection: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds action: publish if the projected revision is still current, else retire."""
    j = projection.join(documents.select(F.col("id").alias("document_id"), "current_revision"), "document_id")
    return j.withColumn("action", F.when(F.col("revision_id") == F.col("current_revision"), "publish").otherwise("retire")).drop("current_revision")


def replace_categories(old: DataFrame, new: DataFrame, doc: str, allowed: list[str]) -> DataFrame:
    """Categories of documents, those in `new` overwritten; values outside the closed set, and `index`, are left out."""
    ok = F.col("category").isin(*[c for c in allowed if c != "index"])
    return old.join(new.select(doc).distinct(), doc, "left_anti").unionByName(new.filter(ok).select(*old.columns).distinct())


def watchlist(rows: DataFrame, now_ms: int) -> DataFrame:
    """sha, expires_at, state of the latest entry of each sha: active, pending_notify or expired. rows: sha, added_at, expires_at, finished, notified."""
    w = latest_wins(rows, ["sha"], ["added_at"], [], ["expires_at", "finished", "notified"])
    return w.withColumn("state", F.when(F.col("expires_at") <= now_ms, "expired").when(F.col("finished") & ~F.col("notified"), "pending_notify").otherwise("active"))
