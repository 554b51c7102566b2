"""The report's lists in their orders (T01-T11) and the tables shown of them.

Every order ends with a name, so reports are reproducible.  ``top`` rows are kept, all with 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.levels import level_lower, level_name
from logscope.operators import tables, timeline
from logscope.operators.analysis import Analysis

# Of each list its table, the columns that fall, and the names that rise.
LISTS = {
    "channels": (tables.channels, ("count",), ("channel",)),
    "errors": (tables.errors, ("count",), ("signature",)),
    "deprecations": (tables.deprecations, ("count",), ("signature", "origin_key")),
    "endpoints": (tables.endpoints, ("p95",), ("endpoint",)),
    "nplus1": (tables.nplus1, ("max_count", "runs"), ("subject", "sql")),
    "commands": (tables.commands, ("failed", "runs"), ("name",)),
    "cache_keys": (tables.cache_keys, ("misses",), ("key",)),
    "messages": (tables.messages, ("dispatched", "waiting"), ("class",)),
    "http_calls": (tables.outbound, ("p95", "calls"), ("shape",)),
}
# The orders of endpoints that can be asked for.
ENDPOINT_SORTS = {"p95": "p95", "max": "max_ms", "requests": "requests", "errors": "errors"}


def order_of(what: str, by: str | None = None) -> list[Column]:
    _, falls, rises = LISTS[what]
    # rows that were never timed count as 0, after all others
    return [*(F.coalesce(F.col(c), F.lit(0)).desc() for c in ((by,) if by else falls)), *map(F.asc, rises)]


def keep_top(df: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first rows in the order, without a sort of the whole table (T10); all with 0."""
    ordered = df.orderBy(*order)
    return ordered.limit(top) if top else ordered


def listed(a: Analysis, what: str, top: int | None = None, by: str | None = None) -> DataFrame:
    """A list of the report (T01-T09); as many channels as their ceiling unless ``top`` is given."""
    if top is None:
        top = tables.CEILINGS["channels"] if what == "channels" else a.options.top
    return keep_top(a.admit(what, LISTS[what][0](a)), order_of(what, by), top)


def ranked(a: Analysis, what: str, top: int | None = None, by: str | None = None) -> DataFrame:
    """The list with its places; only the rows that are kept are numbered."""
    rows = listed(a, what, top, by)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order_of(what, by))))


def severity(value: Column, *steps: float) -> Column:
    """How many of the rising steps the value reaches."""
    return sum(((value >= s).cast("int") for s in steps), F.lit(0))


def errors(a: Analysis, top: int = 300) -> DataFrame:
    """The gravest of equally frequent errors first."""
    rows = keep_top(tables.errors(a), [F.desc("count"), F.desc("level"), F.asc("signature")], top)
    return rows.select("count", level_name(F.col("level")).alias("level"), "channel", "last_ms", "signature")


def endpoints(a: Analysis, sort: str = "p95", top: int = 300) -> DataFrame:
    """A timed endpoint without a matched line counts its timed lines as requests."""
    rows = listed(a, "endpoints", top, ENDPOINT_SORTS[sort])
    shown = rows.withColumn("requests", F.greatest("requests", F.coalesce("timed", F.lit(0))))
    return shown.select("endpoint", "requests", "queries_avg", "calls_avg", "p50", "p95", "max_ms", "status_5xx", "error_rate", severity(F.col("p95"), 300, 1000).alias("slow"))


def commands(a: Analysis, top: int = 300) -> DataFrame:
    """V04."""
    return listed(a, "commands", top).select("name", "runs", "failed", "queries_avg", "calls_avg", "last_code", "p95", "last_ms")


def nplus1(a: Analysis, top: int = 300) -> DataFrame:
    """V05."""
    return listed(a, "nplus1", top).select("subject", "max_count", "avg_count", "runs", "sql", severity(F.col("max_count"), 20, 50).alias("grave"))


def outbound(a: Analysis, top: int = 300) -> DataFrame:
    """V06."""
    return listed(a, "http_calls", top).select("shape", "calls", "max_per_run", "p50", "p95", "max_ms", "status_4xx", "status_5xx", severity(F.col("max_per_run"), 2, 4, 10).alias("repeated"))


def messenger(a: Analysis, top: int = 300) -> DataFrame:
    """Lag, the most of one run and the subject of that run."""
    piling = F.col("waiting") * 2 > F.col("dispatched")
    return listed(a, "messages", top).select("class", "dispatched", "handled", "waiting", "failed", F.col("p95").alias("lag_p95"), "max_per_run", F.col("worst_subject").alias("from"), piling.alias("piling_up"))


def deprecations(a: Analysis, top: int = 300) -> DataFrame:
    """V08."""
    return listed(a, "deprecations", top).select("count", "last_ms", F.col("endpoint").alias("route"), "message")


def stream(a: Analysis, offset: int = 0, limit: int = 300, **filters) -> DataFrame:
    """The newest entries first, from an offset on."""
    rows = tables.stream(a, **filters).offset(offset).limit(limit)
    return rows.select("ord", "ts", level_name(F.col("level")).alias("level"), "channel", F.substring_index("message", "\n", 1).alias("line"))


def overview(a: Analysis, seconds: int = 600) -> dict[str, DataFrame]:
    """The frames of the first screen."""
    return {
        "series": timeline.series(timeline.seconds(a.lines), seconds), "levels": tables.levels(a), "channels": listed(a, "channels", 10), "status": tables.status_classes(a),
        "cache_keys": listed(a, "cache_keys", 10), "errors": listed(a, "errors", 10).select(level_lower(F.col("level")).alias("level"), "count", "signature"),
    }


def followed(a: Analysis, what: str, subject: str) -> DataFrame:
    """The errors or deprecations that a subject has raised (W03), among others or alone: asked of
    all their lines, not of the sixteen names that are shown."""
    kind, (_, _, keys) = {"errors": "is_error", "deprecations": "depr is not null"}[what], LISTS[what]
    rows = a.enriched.where(kind).where(F.coalesce("subject.name", "claimed") == subject)
    own = rows.select("signature") if what == "errors" else rows.select(F.col("depr.message").alias("signature"), "depr.origin_key")
    return LISTS[what][0](a).join(own.distinct(), list(keys), "left_semi")


def endpoint_patterns(a: Analysis, endpoint: str) -> DataFrame:
    """An endpoint's repeated queries (J08), the worst first."""
    return keep_top(tables.nplus1(a).where(F.col("subject") == endpoint), order_of("nplus1"), 0)


def admitted_rows(a: Analysis, what: str, most: int | None = None) -> DataFrame:
    """A table under its ceiling (A25): only keys among the first by arrival."""
    key = {"endpoints": "endpoint", "errors": "signature", "channels": "channel"}[what]
    a = a.over(*tables.ERRORS) if what == "errors" else a
    ceiling = {"endpoints": "routes"}.get(what, what)
    first = tables.admitted(a.enriched.select(key, "ord"), key, tables.CEILINGS[ceiling] if most is None else most)
    return LISTS[what][0](a).join(first.select(key), key, "left_semi")


def duration_source(a: Analysis) -> dict:
    """kind and key of what requests are timed by."""
    duration, token = a.keys
    if duration is not None:
        return {"kind": "field", "key": duration}
    if token is not None and not a.runs.where("kind = 'endpoint'").isEmpty():
        return {"kind": "correlation", "key": token}
    return {"kind": "none"}


def shape_counts(a: Analysis) -> dict[str, int]:
    """Distinct statements, calls, commands, cache keys and classes."""
    return a.lines.agg(F.count_distinct("sql").alias("sql"), F.count_distinct("http.shape").alias("http"), F.count_distinct("cmd.name").alias("commands"), F.count_distinct("cache.key").alias("cache"), F.count_distinct("msg.class").alias("classes")).first().asDict()
