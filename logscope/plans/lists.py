"""Registered queries of the report's lists by their places, its views and ceilings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from logscope.operators import tables, views
from logscope.operators.analysis import Options
from logscope.operators.ceilings import Ceiled
from logscope.plans.queries import BASE, OPTIONS, _ms, analysis
from logscope.plans.queries import ORACLE as TABLES

#: Runs as long as a token's day, so that statements recur in them.
LONG_RUNS = Options(timeout_ms=86_400_000, nplus1=2, duration_key="duration_ms", correlate_key="token")


def _places(spark, sf, what, *shown, options=OPTIONS, top=25):
    return views.ranked(analysis(spark, sf, options), what, top).select("rank", *shown)


def top_channels(spark, sf):
    return _places(spark, sf, "channels", "channel", "count", "errors", top=0)


def top_errors(spark, sf):
    return _places(spark, sf, "errors", "signature", "count", top=3)


def top_deprecations(spark, sf):
    return _places(spark, sf, "deprecations", "signature", "origin_key", "count", "first_ms", "last_ms", F.col("endpoint").alias("route"))


def top_endpoints(spark, sf):
    return _places(spark, sf, "endpoints", "endpoint", _ms("p95"), top=5)


def top_nplus1(spark, sf):
    return _places(spark, sf, "nplus1", "subject", "sql", "max_count", "runs", options=LONG_RUNS)


def top_commands(spark, sf):
    return _places(spark, sf, "commands", "name", "failed", "runs", "first_ms", "last_ms", top=2)


def top_cache_keys(spark, sf):
    return _places(spark, sf, "cache_keys", "key", "misses", "last_ms")


def top_messages(spark, sf):
    return _places(spark, sf, "messages", "class", "dispatched", "waiting", "last_ms", top=3)


def top_outbound(spark, sf):
    return _places(spark, sf, "http_calls", "shape", "calls", _ms("p95"), "last_ms")


def endpoint_rates(spark, sf):
    e = tables.endpoints(analysis(spark, sf))
    return e.select("endpoint", *(F.round(c, 6).alias(c) for c in ("error_rate", "rate_5xx", "queries_avg", "calls_avg")))


def endpoint_view(spark, sf):
    v = views.endpoints(analysis(spark, sf), "requests").where("p95 is not null")
    return v.select("endpoint", "requests", F.round("queries_avg", 6).alias("queries_avg"), _ms("p50"), _ms("p95"), _ms("max_ms"), "status_5xx", "slow")


def recent_stream(spark, sf):
    v = views.stream(analysis(spark, sf), offset=50, limit=100)
    return v.select(F.col("ord").alias("event_id"), "level", "channel")


def capped_keys(spark, sf):
    return tables.capped(analysis(spark, sf))


#: Ceilings that the log passes, for three tables by a single key.
LOW = {"routes": 4, "errors": 2, "channels": 5, "cache": 1, "sql": 5, "commands": 2, "http": 3, "messages": 3, "deprecations": 1}
_ceiled: dict[tuple, Ceiled] = {}


def ceiled(spark, sf) -> Ceiled:
    a = analysis(spark, sf)
    if (a, "low") not in _ceiled:
        _ceiled.clear()
        _ceiled[a, "low"] = Ceiled(a, LOW)
    return _ceiled[a, "low"]


def ceilings(spark, sf):
    """Which tables have refused keys, under low ceilings."""
    return ceiled(spark, sf).capped().where(F.col("name").isin("routes", "errors", "channels", "cache keys", "sql shapes", "commands", "outbound calls", "message classes", "deprecations"))


def ceiled_lists(spark, sf):
    """The keys that lists detail under low ceilings: the first that came."""
    c = ceiled(spark, sf)
    of = {"endpoints": "endpoint", "errors": "signature", "channels": "channel", "messages": "class"}
    rows = [views.listed(c, what, 0).select(F.lit(what).alias("list"), F.col(key).alias("key")) for what, key in of.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def ceiled_runs(spark, sf):
    """Runs under low ceilings: a refused class doesn't reach them, a refused call does."""
    return ceiled(spark, sf).runs.select("token", "name", "first_ms", "calls", "messages", "misses")


def admitted_errors(spark, sf):
    return views.admitted_rows(analysis(spark, sf), "errors", 2).select("signature", "count")


def _numbered(rows: str, order: str, *shown: str, top: int = 25) -> str:
    """The rows of a statement by their places."""
    kept = f" WHERE rank <= {top}" if top else ""
    return f"SELECT CAST(rank AS INTEGER) AS rank, {', '.join(shown)} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({rows})){kept}"


_SPAN = "arg_min(ts_ms, event_id) AS first_ms, arg_max(ts_ms, event_id) AS last_ms"
_LONG = BASE.replace("1800000", "86400000")

ORACLE = {
    "top_channels": _numbered(TABLES["channel_counts"], "count DESC, channel", "channel", "count", "errors", top=0),
    "top_errors": _numbered(TABLES["error_signatures"], "count DESC, signature", "signature", "count", top=3),
    "top_deprecations": BASE + f"""SELECT CAST(1 AS INTEGER) AS rank, 'Call number # of old# is deprecated' AS signature, '' AS origin_key, count(*) AS count, {_SPAN}, coalesce(arg_max(name, CASE WHEN name IS NOT NULL THEN event_id END), arg_min(claimed, claimed_at)) AS route
FROM x WHERE kind = 'deprecation' HAVING count(*) > 0""",
    "top_endpoints": _numbered(TABLES["slowest_endpoints"], "p95 DESC, endpoint", "endpoint", "p95", top=5),
    "top_nplus1": _numbered(_LONG + "SELECT name AS subject, shape AS sql, count(*) AS runs, max(n) AS max_count FROM sh WHERE what = 'sql' AND n >= 2 GROUP BY ALL", "max_count DESC, runs DESC, subject, sql", "subject", "sql", "max_count", "runs"),
    "top_commands": _numbered(BASE + f"SELECT own AS name, count(*) FILTER (k % 2 <> 0) AS failed, count(*) AS runs, {_SPAN} FROM x WHERE kind = 'command' GROUP BY own", "failed DESC, runs DESC, name", "name", "failed", "runs", "first_ms", "last_ms", top=2),
    "top_cache_keys": BASE + "SELECT CAST(1 AS INTEGER) AS rank, any_value('item_#_view') AS key, count(*) AS misses, arg_max(ts_ms, event_id) AS last_ms FROM l WHERE kind = 'cache' HAVING count(*) > 0",
    "top_messages": _numbered(BASE + f"SELECT 'App\\Message\\M' || (k % 4) AS class, count(*) FILTER (kind = 'sent') AS dispatched, greatest(count(*) FILTER (kind = 'sent') - count(*) FILTER (kind = 'handled'), 0) AS waiting, {_SPAN} FROM l WHERE kind IN ('sent', 'handled') GROUP BY 1", "dispatched DESC, waiting DESC, class", "class", "dispatched", "waiting", "last_ms", top=3),
    "top_outbound": "SELECT CAST(rank AS INTEGER) AS rank, shape, calls, p95, last_ms FROM (SELECT *, row_number() OVER (ORDER BY p95 DESC, calls DESC, shape) AS rank FROM (" + TABLES["outbound_shapes"] + ")) JOIN (" + BASE + "SELECT 'GET api.p' || (k % 3) || '.test/v1/items/#' AS shape, arg_max(ts_ms, event_id) AS last_ms FROM l WHERE kind = 'http' GROUP BY 1) USING (shape)",
    "endpoint_rates": BASE + """, q AS (SELECT name AS endpoint, sum(queries) / count(*) AS qa, sum(calls) / count(*) AS ca FROM runs WHERE run_kind = 'endpoint' GROUP BY name),
t AS (SELECT endpoint, count(*) FILTER (kind = 'route') AS requests, count(*) FILTER (kind = 'error') AS errors, count(status) AS responses, count(*) FILTER (status = 500) AS bad FROM x WHERE endpoint IS NOT NULL GROUP BY 1)
SELECT endpoint, round(coalesce(errors / nullif(requests, 0), 0), 6) AS error_rate, round(bad / nullif(responses, 0), 6) AS rate_5xx, round(coalesce(qa, 0), 6) AS queries_avg, round(coalesce(ca, 0), 6) AS calls_avg FROM t LEFT JOIN q USING (endpoint)""",
    "endpoint_view": "SELECT endpoint, greatest(requests, timed) AS requests, round(coalesce(qa, 0), 6) AS queries_avg, p50, p95, max_ms, status_5xx, CAST(CASE WHEN p95 >= 1000 THEN 2 WHEN p95 >= 300 THEN 1 ELSE 0 END AS INTEGER) AS slow FROM (" + TABLES["slowest_endpoints"] + ") LEFT JOIN (" + BASE + "SELECT name AS endpoint, sum(queries) / count(*) AS qa FROM runs WHERE run_kind = 'endpoint' GROUP BY name) USING (endpoint)",
    "recent_stream": BASE + "SELECT event_id, CASE level WHEN 0 THEN 'DEBUG' WHEN 5 THEN 'CRITICAL' ELSE 'INFO' END AS level, channel FROM l ORDER BY event_id DESC LIMIT 100 OFFSET 50",
    "capped_keys": BASE + """, c AS (SELECT count(DISTINCT endpoint) AS routes, count(DISTINCT CASE WHEN kind = 'error' THEN signature END) AS errors, count(DISTINCT CASE WHEN kind = 'deprecation' THEN 1 END) AS deprecations, count(DISTINCT channel) AS channels,
count(DISTINCT CASE WHEN kind = 'sql' THEN k % 5 END) AS sql, count(DISTINCT CASE WHEN kind = 'http' THEN k % 3 END) AS http, count(DISTINCT CASE WHEN kind IN ('sent', 'handled') THEN k % 4 END) AS messages, count(DISTINCT CASE WHEN kind = 'command' THEN own END) AS commands, count(DISTINCT CASE WHEN kind = 'cache' THEN 1 END) AS cache FROM x)
SELECT name, keys, false AS capped FROM c UNPIVOT (keys FOR name IN (routes, errors, deprecations, channels, sql, http, messages, commands, cache))""",
    "ceilings": BASE + """, c AS (SELECT count(DISTINCT endpoint) AS routes, count(DISTINCT CASE WHEN kind = 'error' THEN signature END) AS errors, count(DISTINCT CASE WHEN kind = 'deprecation' THEN 1 END) AS deprecations, count(DISTINCT channel) AS channels,
count(DISTINCT CASE WHEN kind = 'sql' THEN k % 5 END) AS "sql shapes", count(DISTINCT CASE WHEN kind = 'http' THEN k % 3 END) AS "outbound calls", count(DISTINCT CASE WHEN kind IN ('sent', 'handled') THEN k % 4 END) AS "message classes", count(DISTINCT CASE WHEN kind = 'command' THEN own END) AS commands, count(DISTINCT CASE WHEN kind = 'cache' THEN 1 END) AS "cache keys" FROM x),
u AS (SELECT name, keys FROM c UNPIVOT (keys FOR name IN (routes, errors, deprecations, channels, "sql shapes", "outbound calls", "message classes", commands, "cache keys")))
SELECT name, keys, keys > CASE name WHEN 'routes' THEN 4 WHEN 'errors' THEN 2 WHEN 'channels' THEN 5 WHEN 'cache keys' THEN 1 WHEN 'sql shapes' THEN 5 WHEN 'commands' THEN 2 WHEN 'outbound calls' THEN 3 WHEN 'message classes' THEN 3 ELSE 1 END AS capped FROM u""",
    "ceiled_lists": BASE + """, f AS (SELECT 'endpoints' AS list, endpoint AS key, min(event_id) AS o, 4 AS most FROM x WHERE endpoint IS NOT NULL GROUP BY endpoint
UNION ALL SELECT 'errors', signature, min(event_id), 2 FROM x WHERE kind = 'error' GROUP BY signature UNION ALL SELECT 'channels', channel, min(event_id), 5 FROM x GROUP BY channel
UNION ALL SELECT 'messages', 'App\Message\M' || (k % 4), min(event_id), 3 FROM x WHERE kind IN ('sent', 'handled') GROUP BY 2)
SELECT list, key FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY o, key) AS r FROM f) WHERE r <= most""",
    "ceiled_runs": BASE + """, known AS (SELECT k % 4 AS c FROM x WHERE kind IN ('sent', 'handled') GROUP BY 1 ORDER BY min(event_id) LIMIT 3),
m AS (SELECT token, run_no, count(*) AS messages FROM x WHERE kind = 'sent' AND k % 4 IN (SELECT c FROM known) GROUP BY ALL)
SELECT token, name, first_ms, calls, coalesce(m.messages, 0) AS messages, misses FROM runs LEFT JOIN m USING (token, run_no)""",
    "admitted_errors": BASE + "SELECT signature, count(*) AS count FROM l WHERE kind = 'error' GROUP BY signature ORDER BY min(event_id) LIMIT 2",
}

QUERIES = {name: globals()[name] for name in ORACLE}
