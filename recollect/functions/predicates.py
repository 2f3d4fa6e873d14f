"""Column builders for filters: optional parameters, ASCII-case-insensitive LIKE, eligibility, durations and dates."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LIMIT = 100
SETTLE_MS = 90_000
BROWSER_MIN_DWELL_MS = 1000
# Commands that carry no knowledge.
TRIVIAL_COMMANDS = ("", "clear", "exit", "exec zsh", "exec bash", "exec fish", "exec sh", "true", ":")
TRIVIAL_PATTERN = r"^exec\s+[\w/.\-]+$"


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are set: filters left out take no plan node."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def contains(column: Column, query: str | None) -> Column | None:
    """LIKE '%q%', in either case; % and _ in the query stay wildcards."""
    return None if query is None else column.ilike(f"%{query}%")


def equals(column: Column, value: object | None) -> Column | None:
    return None if value is None else column == value


def since(column: Column, ms: int | None, strict: bool = False) -> Column | None:
    if ms is None:
        return None
    return column > ms if strict else column >= ms


def starts_with_column(value: str, prefix: Column) -> Column:
    """The argument starts with the stored prefix."""
    return F.lit(value).startswith(prefix)


_UNITS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def parse_since(text: str, now_ms: int) -> int:
    """Epoch threshold of `30m`, `24h` or `7d` ago; 0 if it is none of these."""
    m = re.fullmatch(r"(\d+)([hdm])", text.strip())
    return now_ms - int(m[1]) * _UNITS[m[2]] if m else 0


def parse_duration(text: str, now_ms: int) -> int | None:
    """As parse_since, with weeks, and None for other texts."""
    m = re.fullmatch(r"(\d+)([mhdw])", text.strip())
    return now_ms - int(m[1]) * _UNITS[m[2]] if m else None


def parse_since_date(text: str) -> int | None:
    """Epoch milliseconds of a `YYYY-MM-DD` midnight in UTC; None for other texts."""
    try:
        day = dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.UTC)
    except ValueError:
        return None
    return int(day.timestamp() * 1000)


def agentic_eligible(now_ms: int, include_excluded: bool = False) -> Column:
    """No probe, no workflow journal, not an empty stub, and settled."""
    if include_excluded:
        return F.lit(True)
    filled = (F.col("message_count") > 0) | (F.length(F.trim(F.coalesce("summary_text", F.lit("")))) > 0)
    return F.col("probe_tag").isNull() & ~F.col("source_file").like("%/subagents/workflows/%journal.jsonl") & filled & (F.col("end_time") + SETTLE_MS <= now_ms)


def workflow_eligible() -> Column:
    return F.col("conclusion").isNotNull() | (F.lower("status") == "completed")


def probe_free() -> Column:
    return F.col("probe_tag").isNull()


def clamp_limit(n: int | None, default: int = 10) -> int:
    return max(1, min(MAX_LIMIT, default if n is None else n))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


# The messages.
def enrichment_reason(source: Column) -> Column:
    """Why a row is not worth enriching; null if it is. Columns: command, output_chars, duration_ms, message_count, tool_count, change_count, dwell_ms."""
    command, took = F.trim(F.coalesce("command", F.lit(""))), F.coalesce("duration_ms", F.lit(0))
    trivial = (command.isin(*TRIVIAL_COMMANDS) | F.rlike(command, F.lit(TRIVIAL_PATTERN))) & (F.coalesce("output_chars", F.lit(0)) == 0) & (took < 100)
    return (
        F.when((source == "shell") & trivial, F.concat(F.lit("trivial shell command ('"), command, F.lit("') with no output and "), took.cast("string"), F.lit("ms duration")))
        .when((source == "claude") & (F.col("message_count") < 3) & (F.col("tool_count") == 0), F.format_string("claude session message_count=%d < 3 and no tool_calls", "message_count"))
        .when((source == "opencode") & (F.col("message_count") < 3) & (F.col("change_count") == 0), F.format_string("opencode session message_count=%d < 3, no diffs, no commits", "message_count"))
        .when((source == "browser") & (F.coalesce("dwell_ms", F.lit(0)) < BROWSER_MIN_DWELL_MS), F.format_string("browser dwell_ms=%d < 1000", F.coalesce("dwell_ms", F.lit(0))))
    )


def low_engagement(scroll: Column, query: Column, dwell_ms: Column) -> Column:
    return (F.coalesce(scroll, F.lit(0.0)) < 0.15) & query.isNull() & (F.coalesce(dwell_ms, F.lit(0)) < 120_000)


def domain_allowed(domain: Column, allowed: list[str]) -> Column:
    """Equal, or under one of the allowed domains, in either case."""
    d = F.lower(domain)
    return reduce(lambda a, b: a | b, [(d == a.lower()) | d.endswith("." + a.lower()) for a in allowed], F.lit(False))


def glob_to_regex(glob: str) -> str:
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"


def path_selected(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusion wins; without inclusions all paths are in."""
    hit = lambda globs: reduce(lambda a, b: a | b, [F.rlike(path, F.lit(glob_to_regex(g))) for g in globs], F.lit(False))
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def retry_state(retries: Column, most: Column) -> Column:
    return F.when(retries + 1 >= most, "failed").otherwise("pending")
