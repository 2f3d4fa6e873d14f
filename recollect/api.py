"""The public surface: one function for each tool or route, returning DataFrames. Limits are clamped; times are parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import predicates as P
from recollect.functions import text as T
from recollect.operators import retrieval as R
from recollect.plans import joins as PJ
from recollect.plans import listings as PL
from recollect.plans import search as PS
from recollect.sources.catalog import NOW, role


class Engine:
    """Queries over the tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str, now_ms: int = NOW, tuning: R.Tuning | None = None):
        self.spark, self.folder, self.now_ms, self.tuning = spark, folder, now_ms, tuning or R.Tuning()

    def table(self, name: str) -> DataFrame:
        return role(self.spark, self.folder, name)

    def search_events(self, query: str | None = None, source: str = "all", since: str = "", limit: int | None = None) -> DataFrame:
        n = P.clamp_limit(limit)
        parts = {"shell": (self.table("ev_user"), "command"), "agent": (self.table("sessions_user").withColumnRenamed("start_time", "timestamp"), "summary_text"), "browser": (self.table("visits_user"), "url")}
        if source not in ("all", *parts):
            raise ValueError(f"unknown source: {source}")
        start = P.parse_since(since, self.now_ms)
        out = None
        for name, (df, column) in parts.items():
            if source in ("all", name):
                hit = df.filter(P.all_of(P.contains(F.col(column), query), P.since(F.col("timestamp"), start)))
                one = hit.select(F.lit(name).alias("source"), "id", "timestamp", F.col(column).alias("summary")).orderBy(F.desc("timestamp"), "id").limit(n)
                out = one if out is None else out.unionByName(one)
        return out.orderBy(F.desc("timestamp"), "source", "id").limit(n) if source == "all" else out

    def search_knowledge(self, query: str, limit: int | None = None, source: str | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(0, query)], "query_id int, query string").select("query_id", T.fts_query(F.col("query")).alias("match"))
        nodes = self.table("nodes")
        if source:
            nodes = PJ.source_filter(self.spark, self.folder, nodes.withColumnRenamed("id", "node_id"), source).withColumnRenamed("node_id", "id")
        hits = PS.text_index(self.spark, self.folder).search(q).join(nodes.select("id"), "id", "left_semi")
        return R.ranked(hits, [F.desc("bm25"), F.col("id")], P.clamp_limit(limit)).join(nodes.select("id", "uuid"), "id").select("rank", "id", "uuid", "bm25")

    def search_hybrid(self, limit: int | None = None, mmr: bool = True) -> DataFrame:
        """The stored questions' hybrid hits; diversified if asked."""
        scored = PS.fused(self.spark, self.folder)
        n = P.clamp_limit(limit)
        return R.mmr(scored, self.table("vectors").select("id", "vector"), n, self.tuning.mmr_lambda) if mmr else R.ranked(scored, [F.desc("score"), F.col("id")], n)

    def ask(self, answer: Callable[[Column], Column] | None = None, limit: int = 3) -> DataFrame:
        return PS.ask(self.spark, self.folder, answer, limit)

    def get_entities(self, kind: str | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
        e = self.table("entities").filter(P.all_of(P.equals(F.col("type"), kind), P.contains(F.col("name"), query)))
        return e.orderBy(F.desc("last_seen"), "id").limit(P.clamp_limit(limit))

    def get_ci_status(self, repo: str, branch: str) -> DataFrame:
        return PL.ci_status(self.table("runs"), self.table("jobs"), repo, branch)

    def get_lessons(self, least: int = 2, limit: int | None = None) -> DataFrame:
        from recollect.operators.aggregates import promote

        p = promote(self.table("ev_user"), ["git_repo", "source_kind", "cwd"], "timestamp", least).filter("state = 'lesson'")
        return p.orderBy(F.desc("occurrences"), F.desc("last_seen"), "git_repo", "source_kind", "cwd").limit(P.clamp_limit(limit))

    def get_context(self, limit: int | None = None) -> DataFrame:
        o = self.table("outcomes").groupBy("node_id").agg(F.max("outcome").alias("outcome"))
        from recollect.plans.scalars import context_block

        n = self.table("nodes").orderBy(F.desc("created_at"), "id").limit(P.clamp_limit(limit)).join(o, F.col("id") == F.col("node_id"), "left")
        return n.select("id", context_block().alias("block"))

    def query_memory(self, repository: str, limit: int | None = None) -> DataFrame:
        m = self.table("memdocs").filter((F.col("state") == "active") & (F.col("repository") == repository) & (F.col("active_revision") == F.col("current_revision")))
        return m.orderBy("source_path").limit(P.clamp_limit(limit) + 1)

    def query_memory_history(self, document_id: int, limit: int | None = None) -> DataFrame:
        r = self.table("revisions").filter(F.col("document_id") == document_id).distinct()
        return r.orderBy(F.desc("observed_at"), "id").limit(P.clamp_limit(limit))

    def list_projects(self) -> DataFrame:
        return PL.project_list(self.table("ev_user"), self.table("sessions_user"))

    def inspect_evidence(self, ref: str) -> DataFrame:
        return PS.inspect_evidence(self.spark, self.folder, ref)

    def queue_depths(self) -> DataFrame:
        return PL.queue_depths(self.table("queue"))
