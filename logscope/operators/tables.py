"""The report's tables (A01-A19, A23-A29, J03-J08, T01-T10), one function each, of an ``Analysis``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.levels import NAMES
from logscope.functions.quantile import quantiles
from logscope.functions.text import one_line_sql
from logscope.operators.analysis import RUNS, Analysis
from logscope.operators.scan import previous

# Most keys of each table when ceilings are asked for, and subjects of a key.
CEILINGS = {"routes": 4096, "errors": 4096, "deprecations": 4096, "channels": 512, "open_requests": 20000, "sql": 2048, "http": 2048, "messages": 2048, "open_messages": 20000, "commands": 512, "cache": 2048, "nplus1": 1024}
SUBJECTS = 16
# What tables read of the lines (see ``Analysis.over``).
ERRORS = ("own", "cmd", "is_error", "signature", "level", "channel", "exception", "message", "context_json", "method")
SCALARS = ("is_error", "off_request", "depr", "cmd", "cache", "sql", "msg", "http", "status")


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _dated() -> Column:
    """The place of a line with a date: first and last are by arrival."""
    return F.when(F.col("ts").isNotNull(), F.col("ord"))


def levels(a: Analysis) -> DataFrame:
    """level, count for all eight levels."""
    every = a.shared.entries.sparkSession.range(8).select(F.col("id").cast("tinyint").alias("level"))
    seen = a.narrow("level").groupBy("level").agg(F.count("*").alias("n"))
    name = F.element_at(F.array(*(F.lit(x.lower()) for x in NAMES)), F.col("level").cast("int") + 1)
    return every.join(seen, "level", "left").select(name.alias("level"), F.coalesce("n", F.lit(0)).alias("count"))


def status_classes(a: Analysis) -> DataFrame:
    return a.narrow("status").where("status is not null").groupBy((F.floor(F.col("status") / 100)).cast("int").alias("class")).agg(F.count("*").alias("count"))


def channels(a: Analysis) -> DataFrame:
    return a.narrow("channel", "is_error").groupBy("channel").agg(F.count("*").alias("count"), _n(F.col("is_error")).alias("errors"))


def totals(a: Analysis) -> DataFrame:
    """One row of the report's scalars."""
    a = a.over(*SCALARS)
    request = a.counts_as_request()
    d = a.lines.agg(
        F.count("*").alias("entries"), _n(F.col("is_error")).alias("errors"), _n(F.col("is_error") & F.col("off_request")).alias("errors_off_request"),
        _n(request).alias("requests"), F.count("duration_ms").alias("timed"), F.count("depr").alias("deprecations"),
        F.count("cmd").alias("command_lines"), F.count("cache").alias("cache_misses"), F.count("sql").alias("statements"), F.count("msg").alias("messenger_lines"),
        F.count("http").alias("http_calls"), F.count("http.ms").alias("http_timed"), F.count("status").alias("responses"), _n(F.col("status") >= 500).alias("status_5xx"),
        F.min_by("ts_ms", F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("first_ms"), F.max_by("ts_ms", F.when(F.col("ts").isNotNull(), F.col("ord"))).alias("last_ms"),
    )
    rates = {
        "request_errors": F.col("errors") - F.col("errors_off_request"),
        "error_rate": F.coalesce(F.try_divide("errors", "entries"), F.lit(0.0)),
        "request_error_rate": F.try_divide(F.col("errors") - F.col("errors_off_request"), F.col("requests")),
        "rate_5xx": F.try_divide("status_5xx", "responses"),
    }
    return d.withColumns(rates)


def out_of_window(a: Analysis) -> DataFrame:
    return a.all.agg(_n(~a.inside).alias("out_of_window"))


def subjects(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, raised_by, raised_by_capped: the first sixteen names of a key, sorted."""
    firsts = pairs.where("subject is not null").groupBy(*keys, F.col("subject.name").alias("name")).agg(F.min("ord").alias("ord"))
    w = Window.partitionBy(*keys).orderBy("ord", "name")
    ranked = firsts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SUBJECTS + 1)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("r") <= SUBJECTS, F.col("name")))).alias("raised_by"), (F.max("r") > SUBJECTS).alias("raised_by_capped"))


def _endpoint() -> Column:
    """The last subject that lines of a group had when they came; without one, that of the
    command whose exit was the first to claim a line (J02)."""
    named = F.max_by("subject.name", F.when(F.col("subject").isNotNull(), F.col("ord")))
    return F.coalesce(named, F.min_by("claimed", "claimed_at"))


def raised_by(groups: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with raised_by and raised_by_capped of ``rows``: subjects by arrival, those of
    claims when the command exits; an empty list where there is none."""
    claim = F.when(F.col("claimed").isNotNull(), F.struct(F.lit("command").alias("kind"), F.col("claimed").alias("name")))
    also = rows.withColumns({"subject": F.coalesce("subject", claim), "ord": F.coalesce("claimed_at", "ord")})
    none = F.array().cast("array<string>")
    return groups.join(subjects(also, keys), keys, "left").withColumns({"raised_by": F.coalesce("raised_by", none), "raised_by_capped": F.coalesce("raised_by_capped", F.lit(False))})


def errors(a: Analysis) -> DataFrame:
    """One row a signature; first and last by arrival."""
    e = a.over(*ERRORS).enriched.where("is_error")
    named = F.when(F.col("subject").isNotNull(), F.col("ord"))
    g = e.groupBy("signature").agg(
        F.count("*").alias("count"), F.max("level").alias("level"), F.min_by("channel", "ord").alias("channel"), F.min_by("exception", "ord").alias("exception"),
        F.max_by("message", "ord").alias("message"), F.max_by("context_json", "ord").alias("context"), F.min_by("ts_ms", _dated()).alias("first_ms"), F.max_by("ts_ms", _dated()).alias("last_ms"),
        _endpoint().alias("endpoint"), F.max_by("method", named).alias("method"),
    )
    return raised_by(g, e, ["signature"])


def deprecations(a: Analysis) -> DataFrame:
    d = a.enriched.where("depr is not null").withColumns({"signature": F.col("depr.message"), "origin_key": F.col("depr.origin_key")})
    keys = ["signature", "origin_key"]
    g = d.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min_by("channel", "ord").alias("channel"), F.max_by("message", "ord").alias("message"),
        F.min_by("ts_ms", _dated()).alias("first_ms"), F.max_by("ts_ms", _dated()).alias("last_ms"),
        F.max_by("depr.origin", F.when(F.col("depr.origin").isNotNull(), F.col("ord"))).alias("origin"), _endpoint().alias("endpoint"),
    )
    return raised_by(g.withColumn("message", F.substring_index("message", "\n", 1)), d, keys)


def endpoints(a: Analysis) -> DataFrame:
    """Line part, run part, quantiles and rates of each endpoint."""
    request = a.counts_as_request()
    e = a.enriched.where("endpoint is not null").withColumn("request", request)
    e = e.where("request or is_error or duration_ms is not null or status is not null")
    by_line = e.groupBy("endpoint").agg(
        _n(F.col("request")).alias("requests"), _n(F.col("is_error")).alias("errors"), F.count("duration_ms").alias("timed"), F.sum("duration_ms").alias("sum_ms"),
        F.max(F.col("duration_ms").cast("float")).alias("max_ms"), F.count("status").alias("responses"), _n((F.col("status") >= 400) & (F.col("status") < 500)).alias("status_4xx"), _n(F.col("status") >= 500).alias("status_5xx"),
    )
    r = a.runs.where("kind = 'endpoint'")
    by_run = r.groupBy(F.col("name").alias("endpoint")).agg(F.count("*").alias("closed_requests"), F.sum("queries").alias("queries_total"), F.max("queries").alias("queries_max"), F.sum("calls").alias("calls_total"), F.max("calls").alias("calls_max"))
    timed = e.where("duration_ms is not null").select("endpoint", F.col("duration_ms").alias("ms"))
    if a.keys[0] is None:  # no duration in the log: the run's length stands for it
        timed = r.select(F.col("name").alias("endpoint"), F.col("ms").cast("double").alias("ms"))
        lengths = timed.groupBy("endpoint").agg(F.count("*").alias("_t"), F.sum("ms").alias("_s"), F.max(F.col("ms").cast("float")).alias("_m"))
        by_run = by_run.join(lengths, "endpoint")
    joined = by_line.join(by_run, "endpoint", "full_outer").join(quantiles(timed, ["endpoint"]), "endpoint", "left")
    if a.keys[0] is None:
        joined = joined.withColumns({"timed": F.col("_t"), "sum_ms": F.col("_s"), "max_ms": F.col("_m")}).drop("_t", "_s", "_m")
    counts = ["requests", "errors", "timed", "responses", "status_4xx", "status_5xx", "closed_requests", "queries_total", "queries_max", "calls_total", "calls_max"]
    joined = joined.na.fill(0, counts)
    return joined.withColumns({
        "avg_ms": F.try_divide("sum_ms", "timed"), "error_rate": F.coalesce(F.try_divide("errors", "requests"), F.lit(0.0)), "rate_5xx": F.try_divide("status_5xx", "responses"),
        "queries_avg": F.coalesce(F.try_divide("queries_total", "closed_requests"), F.lit(0.0)), "calls_avg": F.coalesce(F.try_divide("calls_total", "closed_requests"), F.lit(0.0)),
    })


def slowest(a: Analysis) -> DataFrame:
    """T04 over timed endpoints."""
    return endpoints(a).where("timed > 0").orderBy(F.desc("p95"), "endpoint")


def nplus1(a: Analysis) -> DataFrame:
    """A10: one query repeated within a run, at least as often as the threshold."""
    hits = a.repeated("sql").where((F.col("n") >= max(1, a.options.nplus1)) & F.lit(a.options.nplus1 > 0))
    g = hits.groupBy("name", "shape").agg(F.count("*").alias("runs"), F.max("n").alias("max_count"), F.sum("n").alias("total_count"), F.max("last_ms").alias("last_ms"))
    return g.select(F.col("name").alias("subject"), one_line_sql(F.col("shape")).alias("sql"), "runs", "max_count", "total_count", F.try_divide("total_count", "runs").alias("avg_count"), "last_ms")


def repetition(a: Analysis, what: str) -> DataFrame:
    """Shape, runs affected, total, most in a run, and the subject of that run."""
    s = a.repeated(what)
    return s.groupBy("shape").agg(F.count("*").alias("runs"), F.sum("n").alias("in_runs"), F.max("n").alias("max_per_run"), F.min(F.struct((-F.col("n")).alias("k"), "name"))["name"].alias("worst_subject"))


def outbound(a: Analysis, in_runs: bool = True) -> DataFrame:
    """A11 with A12: one row an outbound shape.  Without ``in_runs`` what it is of runs is left
    out, so lines aren't cut into runs; commands, cache keys and messages likewise."""
    a = a.over(*(RUNS if in_runs else ("http",)))
    c = a.lines.where("http is not null").select("http.*", "ts", "ts_ms", "ord")
    g = c.groupBy("shape").agg(F.count("*").alias("calls"), F.max_by("ts_ms", _dated()).alias("last_ms"), F.count("ms").alias("timed"), F.sum("ms").alias("sum_ms"), F.max(F.col("ms").cast("float")).alias("max_ms"), F.count("status").alias("responses"), _n((F.col("status") >= 400) & (F.col("status") < 500)).alias("status_4xx"), _n(F.col("status") >= 500).alias("status_5xx"))
    g = g.join(quantiles(c.where("ms is not null"), ["shape"]), "shape", "left")
    g = g.join(repetition(a, "call"), "shape", "left") if in_runs else g
    return g.withColumn("avg_ms", F.try_divide("sum_ms", "timed"))


def commands(a: Analysis, in_runs: bool = True) -> DataFrame:
    """One row a console command."""
    a = a.over(*(RUNS if in_runs else ("cmd",)))
    c = (a.enriched if in_runs else a.lines).where("cmd is not null").withColumns({"name": F.col("cmd.name"), "code": F.col("cmd.code")})
    counts = {"first_ms": F.min_by("ts_ms", _dated()), "last_ms": F.max_by("ts_ms", _dated()), "runs": F.count("code"), "failed": _n(F.col("code") != 0), "threw": _n(F.col("cmd.threw")), "last_code": F.max_by("code", F.when(F.col("code").isNotNull(), F.col("ord")))}
    counts = [v.alias(name) for name, v in counts.items()]
    rate = F.try_divide("failed", "runs").alias("failure_rate")
    if not in_runs:
        return c.groupBy("name").agg(*counts).select("*", rate)
    took = F.when(F.col("code").isNotNull() & (F.col("ts_ms") > F.col("run_first_ms")), (F.col("ts_ms") - F.col("run_first_ms")).cast("double"))
    c = c.withColumn("ms", took)
    g = c.groupBy("name").agg(*counts, F.count("ms").alias("timed"), F.sum("ms").alias("sum_ms"), F.max("ms").alias("max_ms"))
    per = a.runs.where("kind = 'command'").groupBy("name").agg(F.count("*").alias("closed_runs"), F.sum("queries").alias("queries_total"), F.max("queries").alias("queries_max"), F.sum("calls").alias("calls_total"), F.max("calls").alias("calls_max"))
    g = g.join(quantiles(c.where("ms is not null"), ["name"]), "name", "left").join(per, "name", "left").na.fill(0, ["closed_runs", "queries_total", "queries_max", "calls_total", "calls_max"])
    return g.withColumns({"failure_rate": rate, "avg_ms": F.try_divide("sum_ms", "timed"), "queries_avg": F.coalesce(F.try_divide("queries_total", "closed_runs"), F.lit(0.0)), "calls_avg": F.coalesce(F.try_divide("calls_total", "closed_runs"), F.lit(0.0))})


def cache_keys(a: Analysis, in_runs: bool = True) -> DataFrame:
    a = a.over(*(RUNS if in_runs else ("cache",)))
    c = a.lines.where("cache is not null")
    g = c.groupBy(F.col("cache.key").alias("key")).agg(_n(F.col("cache.event") == "computed").alias("computed"), _n(F.col("cache.event") == "contended").alias("contended"), F.count("*").alias("misses"), F.max_by("ts_ms", _dated()).alias("last_ms"))
    return g.join(repetition(a, "cache").withColumnRenamed("shape", "key"), "key", "left") if in_runs else g


def lags(a: Analysis) -> DataFrame:
    """class, ms of handled messages whose line before, of the same id, dispatched them."""
    m = a.over("msg").lines.where("msg.id is not null and msg.event in ('dispatched', 'handled')").select("msg.id", "msg.event", "msg.class", "ts_ms", "ord")
    m = previous(m, "id", "ord", F.struct("event", "class", "ts_ms"), "was")
    return m.where("event = 'handled' and was.event = 'dispatched' and was.class = class").select("class", F.greatest(F.col("ts_ms") - F.col("was.ts_ms"), F.lit(0)).cast("double").alias("ms"))


def messages(a: Analysis, in_runs: bool = True) -> DataFrame:
    """The two vocabularies are not added, the larger counts."""
    a = a.over(*(RUNS if in_runs else ("msg",)))
    m = a.lines.where("msg is not null").select("msg.*", "ts", "ts_ms", "ord")
    n = lambda event, audited: _n((F.col("event") == event) & (F.col("audited") == audited))
    g = m.groupBy("class").agg(F.greatest(n("dispatched", False), n("dispatched", True)).alias("dispatched"), F.greatest(n("handled", False), n("handled", True)).alias("handled"), *(_n(F.col("event") == e).alias(e) for e in ("ran", "no_handler", "retried", "failed")), F.max_by("ts_ms", _dated()).alias("last_ms"))
    lag = lags(a)
    g = g.withColumn("waiting", F.greatest(F.col("dispatched") - F.col("handled"), F.lit(0)))
    stats = lag.groupBy("class").agg(F.count("*").alias("paired"), F.max("ms").alias("max_lag_ms"))
    g = g.join(stats, "class", "left").join(quantiles(lag, ["class"]), "class", "left")
    g = g.join(repetition(a, "message").withColumnRenamed("shape", "class"), "class", "left") if in_runs else g
    return g.na.fill(0, ["paired"])


def message_totals(a: Analysis) -> DataFrame:
    """Waiting is the difference of the sums, not the sum of the differences."""
    t = messages(a, in_runs=False).agg(F.coalesce(F.sum("dispatched"), F.lit(0)).alias("dispatched"), F.coalesce(F.sum("handled"), F.lit(0)).alias("handled"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"))
    return t.withColumn("waiting", F.greatest(F.col("dispatched") - F.col("handled"), F.lit(0)))


def admitted(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` keys by arrival (A25): a top-k of each key's first ``ord``, no global sort."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("first_ord")).orderBy("first_ord", key).limit(most)


def key_places(a: Analysis) -> DataFrame:
    """name, key, at: where each key of each table comes first; one aggregate for all tables."""
    of = {
        "routes": F.col("endpoint"), "errors": F.col("signature"), "deprecations": F.when(F.col("depr").isNotNull(), F.concat_ws("\0", "depr.message", "depr.origin_key")), "channels": F.col("channel"),
        "sql": F.col("sql"), "http": F.col("http.shape"), "messages": F.col("msg.class"), "commands": F.col("cmd.name"), "cache": F.col("cache.key"),
    }
    each = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("name"), c.alias("key"))) for n, c in of.items())))
    return a.enriched.select("ord", F.inline(each)).groupBy("name", "key").agg(F.min("ord").alias("at"))


def capped(a: Analysis) -> DataFrame:
    """name, keys, capped of the tables by lines, whether or not ceilings are asked for."""
    names = ("routes", "errors", "deprecations", "channels", "sql", "http", "messages", "commands", "cache")
    seen = key_places(a).groupBy("name").agg(F.count("*").alias("keys"))
    every = seen.sparkSession.createDataFrame([(n, CEILINGS[n]) for n in names], "name string, most long")
    keys = F.coalesce("keys", F.lit(0))
    return every.join(seen, "name", "left").select("name", keys.alias("keys"), (keys > F.col("most")).alias("capped"))


def stream(a: Analysis, min_level: int = 0, subject: str | None = None, search: str | None = None, limit: int | None = None) -> DataFrame:
    """The newest entries first, filtered."""
    name = F.coalesce("subject.name", "claimed")
    d = a.enriched.where(F.col("level") >= min_level)
    if subject is not None:
        d = d.where(name == subject)
    if search:
        d = d.where(F.exists(F.array("message", "channel", "own_endpoint", "uri", name), lambda x: F.coalesce(F.lower(x).contains(search.lower()), F.lit(False))))
    d = d.select("ord", "ts", "level", "channel", "message", name.alias("subject")).orderBy(F.desc("ord"))
    return d.limit(limit) if limit else d
