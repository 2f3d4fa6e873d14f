"""Source health: roll-ups, status classifiers and invariants over one row for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
# Soft and hard staleness by source.
THRESHOLDS = {
    "shell": (24 * HOUR, 7 * DAY),
    "claude-tool": (24 * HOUR, 7 * DAY),
    "agentic-session-claude": (12 * HOUR, 7 * DAY),
    "browser": (48 * HOUR, 14 * DAY),
    "workflow": (3 * DAY, 30 * DAY),
    "agentic-session-opencode": (3 * DAY, 30 * DAY),
    "agentic-session-codex": (3 * DAY, 30 * DAY),
    "agentic-session-cursor": (3 * DAY, 30 * DAY),
    "claude-auto-memory": (7 * DAY, 30 * DAY),
}
BURSTY = ("agentic-session-opencode", "agentic-session-codex", "agentic-session-cursor")
FAILURES = 3
SHELL_STALE_MS = BROWSER_STALE_MS = 300_000 + 120_000
PROBE_STALE_MS, HEARTBEAT_MS, WATCHER_STALE_MS = 900_000, 420_000, 900_000


def capture_status(now_ms: int) -> Column:
    """Status of a source from columns source, has_health, row_count, max_event_ts, alarms, consecutive_failures, last_error_ts, probe_ok, probe_last_run_ts, events_last_24h, last_event_ts. The first rule that holds decides."""
    c = F.col
    soft = F.coalesce(*[F.when(c("source") == s, F.lit(a)) for s, (a, _) in THRESHOLDS.items()], F.lit(DAY))
    fails = F.coalesce("consecutive_failures", F.lit(0))
    ref = F.coalesce("last_event_ts", "max_event_ts")
    age = F.greatest(F.lit(now_ms) - ref, F.lit(0))
    return (
        F.when((c("row_count") == 0) & ~c("has_health"), "expected_absent")
        .when(c("alarms") > 0, "failing")
        .when(~c("has_health"), "unknown")
        .when(c("source").isin(*BURSTY) & (fails > FAILURES), "failing")
        .when((fails > 0) & (F.lit(now_ms) - c("last_error_ts") < DAY), "failing")
        .when((c("probe_ok") == 0) & c("probe_last_run_ts").isNotNull(), "failing")
        .when(c("row_count") == 0, "expected_absent")
        .when(ref.isNull(), "unknown")
        .when(age <= soft, "fresh")
        .when((F.coalesce("events_last_24h", F.lit(0)) == 0) & (c("source").isin(*BURSTY) | (c("source") == "browser")), "suppressed_idle")
        .otherwise("stale")
    )


def staleness(age_ms: Column, warn_ms: int, fail_ms: int, suppressed: Column, backstop_ms: int = DAY) -> Column:
    """ok, warn, fail or suppressed; suppression ends at the backstop."""
    return F.when(age_ms.isNull(), "never").when(age_ms <= warn_ms, "ok").when(suppressed & (age_ms < backstop_ms), "suppressed").when(age_ms > fail_ms, "fail").otherwise("warn")


def invariants(health: DataFrame, now_ms: int, shell_active: bool, browser_running: bool) -> DataFrame:
    """invariant_id, source, since_ms of violations, in one pass over the rows: every rule is a conditional struct of an array that is exploded."""
    c = F.col
    age = F.lit(now_ms) - c("last_event_ts")
    probe = F.lit(now_ms) - c("probe_last_run_ts")
    named = lambda s: c("source") == s
    seen = c("last_event_ts").isNotNull()
    proxy = F.greatest(F.lit(now_ms) - F.coalesce("last_event_ts", "updated_at"), F.lit(0))
    idle = F.lit(not shell_active)
    rules = [
        ("I-1", named("shell") & seen & (c("probe_ok") == 1) & ~(idle & (age < DAY)) & (age > SHELL_STALE_MS), age),
        ("I-2", named("agentic-session-claude") & seen & (c("consecutive_failures") > FAILURES), age),
        ("I-4", named("browser") & F.lit(browser_running) & seen & (F.lit(now_ms) - c("last_heartbeat_ts") <= HEARTBEAT_MS) & (age > BROWSER_STALE_MS), age),
        ("I-8", c("probe_last_run_ts").isNotNull() & ((probe > PROBE_STALE_MS) | F.coalesce(c("probe_ok") == 0, F.lit(False))) & ~(named("shell") & (probe > PROBE_STALE_MS) & ~F.coalesce(c("probe_ok") == 0, F.lit(False)) & idle & (probe < DAY)), probe),
        *[(i, named(f"agentic-session-{s}") & (c("consecutive_failures") > FAILURES), proxy) for i, s in (("I-11", "opencode"), ("I-13", "codex"), ("I-15", "cursor"))],
        ("I-12", named("brain-preflight") & (c("consecutive_failures") > 12), F.lit(now_ms) - F.coalesce("last_event_ts", "last_success_ts", F.lit(now_ms))),
        ("I-18", named("claude-auto-memory") & (c("consecutive_failures") > FAILURES), F.lit(now_ms) - F.coalesce("last_error_ts", "last_event_ts", F.lit(now_ms))),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(i).alias("invariant_id"), since.cast("bigint").alias("since_ms"))) for i, bad, since in rules]))
    one = health.select("source", F.explode(found).alias("v")).select("v.invariant_id", "source", "v.since_ms")
    # I-17 looks at two sources
    pair = health.agg(F.max(F.when(named("claude-auto-memory"), c("last_event_ts"))).alias("ingest"), F.max(F.when(named("auto-memory-watcher"), F.coalesce("last_heartbeat_ts", "last_success_ts"))).alias("beat"))
    i17 = pair.filter((F.lit(now_ms) - c("ingest") <= 4 * WATCHER_STALE_MS) & (F.lit(now_ms) - c("beat") > WATCHER_STALE_MS)).select(F.lit("I-17").alias("invariant_id"), F.lit("auto-memory-watcher").alias("source"), (F.lit(now_ms) - c("beat")).alias("since_ms"))
    return one.unionByName(i17)


def update_health(old: DataFrame, batch: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Health after a batch: newest event, counters, failures reset on success or one more on error. old: source, last_event_ts, events, consecutive_failures, last_error_msg; batch: source, timestamp; failed: source, message."""
    news = batch.groupBy("source").agg(F.max("timestamp").alias("_t"), F.count("*").alias("_n"))
    j = old.join(news, "source", "full")
    if failed is not None:
        j = j.join(failed.groupBy("source").agg(F.min(F.substring("message", 1, 512)).alias("_e")), "source", "full")
    else:
        j = j.withColumn("_e", F.lit(None).cast("string"))
    bad = F.col("_e").isNotNull()
    return j.select(
        "source",
        F.greatest("last_event_ts", "_t").alias("last_event_ts"),
        (F.coalesce("events", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("events"),
        F.when(bad, F.coalesce("consecutive_failures", F.lit(0)) + 1).when(F.col("_n") > 0, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0))).cast("int").alias("consecutive_failures"),
        F.coalesce("_e", "last_error_msg").alias("last_error_msg"),
    )
