"""Registered queries over the driver's tables, each with its SQL.

The log is written from ``events`` (see ``sources.virtual``) and read back through the whole
engine; the SQL computes the same tables straight from ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.functions import fields
from logscope.functions.parse import parse
from logscope.functions.quantile import quantiles
from logscope.functions.text import contains_ignoring_case, fold, one_line_sql, truncate, url_target
from logscope.operators import tables, timeline
from logscope.operators.analysis import Analysis, Lines, Options
from logscope.operators.assemble import assemble
from logscope.plans.thresholds import evaluate
from logscope.sources.virtual import dealt, virtual_log

TIMEOUT_MS = 1_800_000
OPTIONS = Options(timeout_ms=TIMEOUT_MS, nplus1=2, scrollback=1 << 60, duration_key="duration_ms", correlate_key="token")
#: The same, with the keys found in the log.
FOUND_KEYS = Options(timeout_ms=TIMEOUT_MS)
THRESHOLDS = ["error-rate>2%", "5xx-rate>50%", "p95>100ms", "entries>1", "errors<5", "messages-waiting>0", "commands-failed>0", "http-client-max>1s", "deprecations>0", "request-error-rate>1%"]


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_open: dict[tuple, tuple[Lines, dict[Options, Analysis]]] = {}


def analysis(spark: SparkSession, sf: str, options: Options = OPTIONS) -> Analysis:
    """The analysis of the virtual log under these options.

    All analyses of one log share its typed lines.  One log is open at a time: another
    gives its memory back.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _open:
        for (app, _), (old, analyses) in _open.items():
            if app == key[0]:
                for a in analyses.values():
                    a.close()
                old.close()
        _open.clear()
        events = dealt(_read(spark, sf, "events"))
        _open[key] = Lines(parse(virtual_log(events)).where("level is not null")), {}
    lines, analyses = _open[key]
    if options not in analyses:
        analyses[options] = Analysis(lines, options)
    return analyses[options]


def _ms(c: str) -> F.Column:
    return F.round(F.col(c).cast("double"), 4).alias(c)


def slowest_endpoints(spark, sf):
    e = tables.endpoints(analysis(spark, sf)).where("timed > 0")
    return e.select("endpoint", "requests", "errors", "timed", "responses", "status_4xx", "status_5xx", _ms("p50"), _ms("p95"), _ms("p99"), _ms("max_ms"), F.round("avg_ms", 4).alias("avg_ms"))


def endpoint_runs(spark, sf):
    return tables.endpoints(analysis(spark, sf)).select("endpoint", "closed_requests", "queries_total", "queries_max", "calls_total", "calls_max")


def parse_roundtrip(spark, sf):
    d = analysis(spark, sf).lines
    return d.select(F.col("ord").alias("event_id"), F.unix_micros("ts").alias("ts_us"), F.col("level").cast("int").alias("level"), "channel", F.col("own_endpoint").alias("route"), F.round("duration_ms", 6).alias("duration_ms"), F.col("status").cast("int").alias("status"), "token")


def multiline_assembly(spark, sf):
    """Every line of a document after its first is a continuation of one entry."""
    docs = _read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    rows = docs.select("doc_id", F.posexplode("parts").alias("pos", "part"))
    body = F.regexp_replace("part", r"[\[{\r]", "(")
    value = F.when(F.col("pos") == 0, F.concat(F.lit("[2026-01-01 00:00:00] app.INFO: "), body)).otherwise(body)
    lines = rows.select(F.lit(0).alias("source"), (F.col("doc_id") * 1_000_000 + F.col("pos")).alias("ord"), value.alias("value"))
    entries, _ = assemble(lines)
    return entries.select(F.floor(F.col("ord") / 1_000_000).alias("doc_id"), F.md5("message").alias("digest"), F.length("message").cast("long").alias("n_chars"))


def level_counts(spark, sf):
    return tables.levels(analysis(spark, sf))


def channel_counts(spark, sf):
    return tables.channels(analysis(spark, sf))


def status_classes(spark, sf):
    return tables.status_classes(analysis(spark, sf))


def error_signatures(spark, sf):
    e = tables.errors(analysis(spark, sf))
    return e.select("signature", "count", F.col("level").cast("int").alias("level"), "channel", "exception", "first_ms", "last_ms")


def error_subjects(spark, sf):
    e = tables.errors(analysis(spark, sf))
    return e.select("signature", F.array_join("raised_by", ",").alias("raised_by"), "raised_by_capped")


def deprecations(spark, sf):
    return tables.deprecations(analysis(spark, sf)).select("signature", "count", "channel")


def fold_digits(spark, sf):
    p = _read(spark, sf, "pages").select("page_id", fold(F.col("url")).alias("folded"), truncate(F.col("url"), 20).alias("short"))
    return p


def url_targets(spark, sf):
    return _read(spark, sf, "pages").select("page_id", url_target(F.col("url")).alias("target"))


def duration_units(spark, sf):
    e = _read(spark, sf, "events").select("event_id", "value")
    out = []
    for key in ("elapsed_ms", "duration", "elapsed_us", "time_s"):
        v = F.try_parse_json(F.col("value").cast("string"))
        out.append(e.select("event_id", F.lit(key).alias("key"), F.round(fields.to_millis(v, key), 6).alias("ms")))
    r = out[0]
    for x in out[1:]:
        r = r.unionByName(x)
    return r


def time_window(spark, sf):
    a = analysis(spark, sf, Options(timeout_ms=TIMEOUT_MS, duration_key="duration_ms", correlate_key="token", since_ms=1704844800000, until_ms=1705708800000))
    t, o = tables.totals(a).select("entries", "errors", "first_ms", "last_ms"), tables.out_of_window(a)
    return t.withColumn("one", F.lit(1)).join(o.withColumn("one", F.lit(1)), "one").drop("one")


def report_totals(spark, sf):
    t = tables.totals(analysis(spark, sf, FOUND_KEYS))
    return t.select("entries", "errors", "requests", "timed", "deprecations", "command_lines", "cache_misses", "messenger_lines", "http_calls", "responses", "status_5xx", F.round("error_rate", 6).alias("error_rate"), F.round("request_error_rate", 6).alias("request_error_rate"), F.round("rate_5xx", 6).alias("rate_5xx"))


def runs_by_gap(spark, sf):
    e = _read(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return timeline.sessions(e, "user_id", "ms", TIMEOUT_MS)


def run_totals(spark, sf):
    return analysis(spark, sf).runs.select("token", "kind", "name", "first_ms", "last_ms", "ms", "queries", "calls", "messages", "misses")


def subject_as_of(spark, sf):
    return analysis(spark, sf).enriched.select(F.col("ord").alias("event_id"), F.col("subject.kind").alias("kind"), F.col("subject.name").alias("name"))


def retroactive_claim(spark, sf):
    return analysis(spark, sf).enriched.where("claimed is not null").select(F.col("ord").alias("event_id"), "claimed")


def deprecation_claims(spark, sf):
    d = tables.deprecations(analysis(spark, sf))
    return d.select("signature", "endpoint", F.array_join("raised_by", ",").alias("raised_by"), "raised_by_capped")


def message_lag(spark, sf):
    return tables.lags(analysis(spark, sf)).groupBy("class").agg(F.count("*").alias("paired"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


def message_backlog(spark, sf):
    return tables.messages(analysis(spark, sf), in_runs=False).select("class", "dispatched", "handled", "waiting", "failed")


def message_totals(spark, sf):
    return tables.message_totals(analysis(spark, sf))


def nplus1(spark, sf):
    return tables.nplus1(analysis(spark, sf)).select("subject", "sql", "runs", "max_count", "total_count", F.round("avg_count", 6).alias("avg_count"))


def outbound_shapes(spark, sf):
    o = tables.outbound(analysis(spark, sf))
    return o.select("shape", "calls", "timed", "responses", "status_4xx", "status_5xx", _ms("p95"), _ms("max_ms"), F.round("avg_ms", 4).alias("avg_ms"))


def cache_misses(spark, sf):
    return tables.cache_keys(analysis(spark, sf)).select("key", "computed", "contended", "misses", "runs", "max_per_run", "worst_subject")


def worst_subject(spark, sf):
    return tables.repetition(analysis(spark, sf), "call")


def commands(spark, sf):
    c = tables.commands(analysis(spark, sf))
    return c.select("name", "runs", "failed", "threw", "last_code", "timed", "sum_ms", "max_ms", "closed_runs", "queries_total", F.round("failure_rate", 6).alias("failure_rate"))


def _lines(spark, sf):
    e = _read(spark, sf, "events")
    return e.select(F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), (F.col("event_type") == "error").alias("is_error"))


def per_second_peak(spark, sf):
    return timeline.peak(timeline.seconds(_lines(spark, sf)))


def sliding_rate(spark, sf):
    return timeline.sliding_rate(timeline.seconds(_lines(spark, sf)), 60).select("sec", F.round("rate", 6).alias("rate"))


def zero_filled_series(spark, sf):
    return timeline.series(timeline.seconds(_lines(spark, sf)), 600)


def ceilings(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return tables.admitted(rows, "key", 512)


def top_k(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def union_sources(spark, sf):
    e = virtual_log(_read(spark, sf, "events"))
    both = e.unionByName(e.withColumn("source", F.lit(1)))
    return parse(both).where("level is not null").groupBy("source", "channel").agg(F.count("*").alias("count"))


def histogram_by_part(spark, sf):
    li = _read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_extendedprice").alias("ms"))
    return quantiles(li, ["key"]).select("key", *(_ms(c) for c in ("p50", "p95", "p99")))


def search_stream(spark, sf):
    return tables.stream(analysis(spark, sf), min_level=1, search="APP\\E1").select(F.col("ord").alias("event_id"), "channel")


def follow_subject(spark, sf):
    return tables.stream(analysis(spark, sf), subject="r3").select(F.col("ord").alias("event_id"), F.col("level").cast("int").alias("level"))


def threshold_verdicts(spark, sf):
    v = evaluate(analysis(spark, sf), THRESHOLDS)
    return v.select("threshold", F.round("measured", 6).alias("measured"), "culprit", "breached")


def one_line(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", one_line_sql(F.col("text")).alias("shown"), contains_ignoring_case(F.col("text"), "THE AND").alias("hit"))


BASE = """
WITH e AS (SELECT event_id, ts, (epoch_us(ts) // 1000) AS ts_ms, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events),
b AS (SELECT *, CASE event_type WHEN 'view' THEN 'route' WHEN 'click' THEN CASE WHEN k % 10 < 7 THEN 'sql' ELSE 'cache' END
  WHEN 'purchase' THEN 'http' WHEN 'signup' THEN CASE WHEN k % 10 < 6 THEN 'sent' WHEN k % 10 < 8 THEN 'handled' ELSE 'command' END
  ELSE CASE WHEN k % 10 < 8 THEN 'error' ELSE 'deprecation' END END AS kind,
  'u' || user_id || 'd' || strftime(ts, '%d') AS token,
  CASE WHEN k % 10 = 0 THEN 500 WHEN k % 10 = 1 THEN 404 ELSE 200 END AS code FROM e),
l AS (SELECT *, CASE kind WHEN 'route' THEN 'request' WHEN 'sql' THEN 'doctrine' WHEN 'cache' THEN 'cache' WHEN 'http' THEN 'http_client' WHEN 'sent' THEN 'messenger'
  WHEN 'handled' THEN 'messenger' WHEN 'command' THEN 'console' WHEN 'error' THEN 'request' ELSE 'php' END AS channel,
  CASE kind WHEN 'sql' THEN 0 WHEN 'command' THEN 0 WHEN 'error' THEN 5 ELSE 1 END AS level,
  CASE kind WHEN 'route' THEN 'r' || (user_id % 8) WHEN 'command' THEN 'app:job' || (k % 3) END AS own,
  CASE kind WHEN 'route' THEN 'endpoint' WHEN 'command' THEN 'command' END AS own_kind,
  CASE WHEN kind = 'error' THEN 'E' || (k % 4) || ': Uncaught PHP Exception App\\E#: "…" at X.php line #' END AS signature,
  CASE WHEN kind = 'route' THEN code END AS status,
  CASE WHEN kind = 'route' THEN value END AS duration_ms,
  ts_ms - max(ts_ms) OVER (PARTITION BY token ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM b),
r AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY event_id) AS run_no FROM l),
s AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS name, last_value(own_kind IGNORE NULLS) OVER w AS name_kind, min(ts_ms) OVER w AS run_first,
  arg_min(CASE WHEN kind = 'command' THEN own END, CASE WHEN kind = 'command' THEN event_id END) OVER (PARTITION BY token ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_command,
  min(CASE WHEN kind = 'command' THEN event_id END) OVER (PARTITION BY token ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_exit
  FROM r WINDOW w AS (PARTITION BY token, run_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN name_kind = 'endpoint' THEN name END AS endpoint, CASE WHEN name IS NULL THEN next_command END AS claimed, CASE WHEN name IS NULL THEN next_exit END AS claimed_at FROM s),
runs AS (SELECT token, run_no, arg_max(own, CASE WHEN own IS NOT NULL THEN event_id END) AS name, arg_max(own_kind, CASE WHEN own IS NOT NULL THEN event_id END) AS run_kind,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) FILTER (kind = 'sql') AS queries, count(*) FILTER (kind = 'http') AS calls, count(*) FILTER (kind = 'sent') AS messages,
  count(*) FILTER (kind = 'cache') AS misses FROM x GROUP BY ALL HAVING count(own) > 0),
sh AS (SELECT x.token, x.run_no, what, shape, count(*) AS n, any_value(runs.name) AS name FROM (
  SELECT token, run_no, kind AS what, CASE kind WHEN 'sql' THEN 'SELECT * FROM t' || (k % 5) || ' WHERE id = ?' WHEN 'http' THEN 'GET api.p' || (k % 3) || '.test/v1/items/#'
    WHEN 'cache' THEN 'item_#_view' END AS shape FROM x WHERE kind IN ('sql', 'http', 'cache')) x JOIN runs USING (token, run_no) GROUP BY x.token, x.run_no, what, shape)
"""


def _hist(source: str, key: str, ms: str) -> str:
    """CTEs q(key, p50, p95, p99) of the log-linear histogram of ``ms`` in ``source``."""
    return f"""
h0 AS (SELECT {key} AS key, CAST(CAST({ms} AS FLOAT) AS DOUBLE) AS x FROM {source}),
h1 AS (SELECT key, x, CASE WHEN x > 0 THEN floor(log2(x)) END AS e0 FROM h0),
h2 AS (SELECT key, x, CASE WHEN pow(2.0, e0 + 1) <= x THEN e0 + 1 WHEN pow(2.0, e0) > x THEN e0 - 1 ELSE e0 END AS e FROM h1),
h3 AS (SELECT key, CASE WHEN x <= 0 OR x IS NULL OR e < -4 THEN 0 ELSE least(671, (e + 4) * 32 + floor((x / pow(2.0, e) - 1) * 32)) END AS b FROM h2),
h4 AS (SELECT key, b, count(*) AS n FROM h3 GROUP BY ALL),
h5 AS (SELECT key, b, sum(n) OVER (PARTITION BY key ORDER BY b) AS cum, sum(n) OVER (PARTITION BY key) AS total FROM h4),
h6 AS (SELECT key, min(b) FILTER (cum > round((total - 1) * 0.5)) AS b50, min(b) FILTER (cum > round((total - 1) * 0.95)) AS b95, min(b) FILTER (cum > round((total - 1) * 0.99)) AS b99 FROM h5 GROUP BY key),
q AS (SELECT key, (1 + (b50 % 32 + 0.5) / 32) * pow(2.0, floor(b50 / 32) - 4) AS p50, (1 + (b95 % 32 + 0.5) / 32) * pow(2.0, floor(b95 / 32) - 4) AS p95, (1 + (b99 % 32 + 0.5) / 32) * pow(2.0, floor(b99 / 32) - 4) AS p99 FROM h6)"""


_TARGET = "regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*?://', ''), '/+$', '')"

ORACLE = {
    "slowest_endpoints": BASE + "," + _hist("(SELECT * FROM x WHERE duration_ms IS NOT NULL AND endpoint IS NOT NULL)", "endpoint", "duration_ms") + """,
t AS (SELECT endpoint, count(*) FILTER (kind = 'route') AS requests, count(*) FILTER (kind = 'error') AS errors, count(duration_ms) AS timed, count(status) AS responses,
  count(*) FILTER (status = 404) AS status_4xx, count(*) FILTER (status = 500) AS status_5xx, max(CAST(duration_ms AS FLOAT)) AS m, avg(duration_ms) AS a FROM x WHERE endpoint IS NOT NULL GROUP BY 1)
SELECT endpoint, requests, errors, timed, responses, status_4xx, status_5xx, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99, round(CAST(m AS DOUBLE), 4) AS max_ms, round(a, 4) AS avg_ms
FROM t JOIN q ON endpoint = key WHERE timed > 0""",
    "endpoint_runs": BASE + """SELECT name AS endpoint, count(*) AS closed_requests, CAST(sum(queries) AS BIGINT) AS queries_total, max(queries) AS queries_max, CAST(sum(calls) AS BIGINT) AS calls_total, max(calls) AS calls_max
FROM runs WHERE run_kind = 'endpoint' GROUP BY name""",
    "parse_roundtrip": BASE + "SELECT event_id, epoch_us(ts) AS ts_us, CAST(level AS INTEGER) AS level, channel, CASE WHEN kind = 'route' THEN own END AS route, round(duration_ms, 6) AS duration_ms, CAST(status AS INTEGER) AS status, token FROM l",
    "multiline_assembly": """
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, regexp_replace(part, '[\\[{\\r]', '(', 'g') AS part FROM p),
t AS (SELECT doc_id, pos, CASE WHEN pos = 1 THEN rtrim(ltrim(part, ' '), ' ') ELSE part END AS part FROM c),
z AS (SELECT *, sum(strlen(part) + CASE WHEN pos = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bytes FROM t),
m AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY pos) AS message FROM z WHERE pos = 1 OR bytes < 4000 GROUP BY doc_id),
f AS (SELECT doc_id, CASE WHEN length(message) > 4000 THEN left(message, 4000) || '…' ELSE message END AS message FROM m)
SELECT doc_id, md5(message) AS digest, length(message) AS n_chars FROM f""",
    "level_counts": BASE + """SELECT n.level AS level, count(l.event_id) AS count FROM (VALUES (0,'debug'),(1,'info'),(2,'notice'),(3,'warning'),(4,'error'),(5,'critical'),(6,'alert'),(7,'emergency')) n(rank, level)
LEFT JOIN l ON l.level = n.rank GROUP BY n.level""",
    "channel_counts": BASE + "SELECT channel, count(*) AS count, count(*) FILTER (kind = 'error') AS errors FROM l GROUP BY channel",
    "status_classes": BASE + "SELECT CAST(status // 100 AS INTEGER) AS class, count(*) AS count FROM l WHERE status IS NOT NULL GROUP BY 1",
    "error_signatures": BASE + """SELECT signature, count(*) AS count, 5 AS level, 'request' AS channel, 'App\\E' || substr(signature, 2, 1) AS exception, arg_min(ts_ms, event_id) AS first_ms, arg_max(ts_ms, event_id) AS last_ms
FROM l WHERE kind = 'error' GROUP BY signature""",
    "error_subjects": BASE + """, n AS (SELECT signature, coalesce(name, claimed) AS who, min(coalesce(claimed_at, event_id)) AS o FROM x WHERE kind = 'error' AND coalesce(name, claimed) IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY o, who) AS r FROM n)
SELECT s.signature, coalesce(string_agg(who, ',' ORDER BY who) FILTER (r <= 16), '') AS raised_by, coalesce(max(r) > 16, false) AS raised_by_capped FROM (SELECT DISTINCT signature FROM x WHERE kind = 'error') s LEFT JOIN k USING (signature) GROUP BY 1""",
    "deprecations": BASE + "SELECT 'Call number # of old# is deprecated' AS signature, count(*) AS count, 'php' AS channel FROM l WHERE kind = 'deprecation' HAVING count(*) > 0",
    "fold_digits": "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS folded, CASE WHEN length(url) > 20 THEN left(url, 20) || '…' ELSE url END AS short FROM pages",
    "url_targets": f"""WITH t AS (SELECT page_id, {_TARGET} AS t FROM pages), p AS (SELECT page_id, list_filter(string_split(t, '/'), lambda s: s <> '') AS parts FROM t)
SELECT page_id, array_to_string(list_prepend(lower(parts[1]), list_transform(parts[2:], lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '#' WHEN regexp_full_match(s, '[0-9]+\\.[a-zA-Z0-9]{{1,5}}') THEN '#.' || split_part(s, '.', 2) ELSE s END)), '/') AS target FROM p""",
    "duration_units": """SELECT event_id, key, round(CASE WHEN key = 'elapsed_us' THEN value / 1000 WHEN key = 'time_s' OR (key = 'duration' AND value > 0 AND value < 30 AND value % 1 <> 0) THEN value * 1000 ELSE value END, 6) AS ms
FROM events, (VALUES ('elapsed_ms'), ('duration'), ('elapsed_us'), ('time_s')) k(key)""",
    "time_window": """WITH e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events), i AS (SELECT * FROM e WHERE ms BETWEEN 1704844800000 AND 1705708800000)
SELECT (SELECT count(*) FROM i) AS entries, (SELECT count(*) FROM i WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS BIGINT) % 10 < 8) AS errors, (SELECT arg_min(ms, event_id) FROM i) AS first_ms, (SELECT arg_max(ms, event_id) FROM i) AS last_ms,
(SELECT count(*) FROM e WHERE ms NOT BETWEEN 1704844800000 AND 1705708800000) AS out_of_window""",
    "report_totals": BASE + """SELECT count(*) AS entries, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'route') AS requests, count(duration_ms) AS timed, count(*) FILTER (kind = 'deprecation') AS deprecations,
count(*) FILTER (kind = 'command') AS command_lines, count(*) FILTER (kind = 'cache') AS cache_misses, count(*) FILTER (kind IN ('sent', 'handled')) AS messenger_lines, count(*) FILTER (kind = 'http') AS http_calls, count(status) AS responses, count(*) FILTER (status = 500) AS status_5xx,
round(count(*) FILTER (kind = 'error') / count(*), 6) AS error_rate, round(count(*) FILTER (kind = 'error') / nullif(count(*) FILTER (kind = 'route'), 0), 6) AS request_error_rate, round(count(*) FILTER (status = 500) / nullif(count(status), 0), 6) AS rate_5xx FROM l""",
    "runs_by_gap": """WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS ms FROM events), g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS gap FROM e),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms) AS run FROM g)
SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n FROM n GROUP BY user_id, run""",
    "run_totals": BASE + "SELECT token, run_kind AS kind, name, first_ms, last_ms, last_ms - first_ms AS ms, queries, calls, messages, misses FROM runs",
    "subject_as_of": BASE + "SELECT event_id, name_kind AS kind, name FROM x",
    "retroactive_claim": BASE + "SELECT event_id, claimed FROM x WHERE claimed IS NOT NULL",
    # a subject is there when its line comes, or when the command exits that claims the line
    "deprecation_claims": BASE + """, d AS (SELECT coalesce(name, claimed) AS who, coalesce(claimed_at, event_id) AS o, name, claimed, claimed_at, event_id FROM x WHERE kind = 'deprecation'),
k AS (SELECT who, row_number() OVER (ORDER BY min(o), who) AS r FROM d WHERE who IS NOT NULL GROUP BY who)
SELECT 'Call number # of old# is deprecated' AS signature, coalesce(arg_max(name, CASE WHEN name IS NOT NULL THEN event_id END), arg_min(claimed, claimed_at)) AS endpoint,
  coalesce((SELECT string_agg(who, ',' ORDER BY who) FROM k WHERE r <= 16), '') AS raised_by, coalesce((SELECT max(r) > 16 FROM k), false) AS raised_by_capped FROM d HAVING count(*) > 0""",
    "message_lag": BASE + """, m AS (SELECT event_id, ts_ms, kind, 'App\\Message\\M' || (k % 4) AS class, lag(kind) OVER w AS pk, lag(ts_ms) OVER w AS pt, lag(k % 4) OVER w AS pc, k % 4 AS c FROM l WHERE kind IN ('sent', 'handled') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT class, count(*) AS paired, sum(CAST(greatest(ts_ms - pt, 0) AS DOUBLE)) AS total_ms, max(CAST(greatest(ts_ms - pt, 0) AS DOUBLE)) AS max_ms FROM m WHERE kind = 'handled' AND pk = 'sent' AND pc = c GROUP BY class""",
    "message_backlog": BASE + """SELECT 'App\\Message\\M' || (k % 4) AS class, count(*) FILTER (kind = 'sent') AS dispatched, count(*) FILTER (kind = 'handled') AS handled, greatest(count(*) FILTER (kind = 'sent') - count(*) FILTER (kind = 'handled'), 0) AS waiting, CAST(0 AS BIGINT) AS failed
FROM l WHERE kind IN ('sent', 'handled') GROUP BY 1""",
    "message_totals": BASE + "SELECT count(*) FILTER (kind = 'sent') AS dispatched, count(*) FILTER (kind = 'handled') AS handled, CAST(0 AS BIGINT) AS failed, greatest(count(*) FILTER (kind = 'sent') - count(*) FILTER (kind = 'handled'), 0) AS waiting FROM l",
    "nplus1": BASE + "SELECT name AS subject, shape AS sql, count(*) AS runs, max(n) AS max_count, CAST(sum(n) AS BIGINT) AS total_count, round(sum(n) / count(*), 6) AS avg_count FROM sh WHERE what = 'sql' AND n >= 2 GROUP BY ALL",
    "outbound_shapes": BASE + ", c AS (SELECT *, 'GET api.p' || (k % 3) || '.test/v1/items/#' AS shape, (value / 1000) * 1000 AS ms FROM l WHERE kind = 'http')," + _hist("c", "shape", "ms") + """
SELECT shape, count(*) AS calls, count(*) AS timed, count(*) AS responses, count(*) FILTER (code = 404) AS status_4xx, count(*) FILTER (code = 500) AS status_5xx, round(any_value(p95), 4) AS p95, round(CAST(max(CAST(ms AS FLOAT)) AS DOUBLE), 4) AS max_ms, round(avg(ms), 4) AS avg_ms FROM c JOIN q ON shape = key GROUP BY shape""",
    "cache_misses": BASE + """, a AS (SELECT shape, count(*) AS runs, max(n) AS max_per_run FROM sh WHERE what = 'cache' GROUP BY shape), w AS (SELECT shape, name FROM (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY n DESC, name) AS r FROM sh WHERE what = 'cache') WHERE r = 1)
SELECT 'item_#_view' AS key, count(*) AS computed, CAST(0 AS BIGINT) AS contended, count(*) AS misses, (SELECT runs FROM a) AS runs, (SELECT max_per_run FROM a) AS max_per_run, (SELECT name FROM w) AS worst_subject FROM l WHERE kind = 'cache' HAVING count(*) > 0""",
    "worst_subject": BASE + """SELECT shape, count(*) AS runs, CAST(sum(n) AS BIGINT) AS in_runs, max(n) AS max_per_run, arg_min(name, row(-n, name)) AS worst_subject FROM sh WHERE what = 'http' GROUP BY shape""",
    "commands": BASE + """, c AS (SELECT own AS name, k % 2 AS code, CASE WHEN ts_ms > run_first THEN CAST(ts_ms - run_first AS DOUBLE) END AS ms, event_id FROM x WHERE kind = 'command'),
p AS (SELECT name, count(*) AS closed_runs, CAST(sum(queries) AS BIGINT) AS queries_total FROM runs WHERE run_kind = 'command' GROUP BY name)
SELECT name, count(*) AS runs, count(*) FILTER (code <> 0) AS failed, CAST(0 AS BIGINT) AS threw, arg_max(code, event_id) AS last_code, count(ms) AS timed, sum(ms) AS sum_ms, max(ms) AS max_ms, coalesce(any_value(closed_runs), 0) AS closed_runs, coalesce(any_value(queries_total), 0) AS queries_total, round(count(*) FILTER (code <> 0) / count(*), 6) AS failure_rate
FROM c LEFT JOIN p USING (name) GROUP BY name""",
    "per_second_peak": "SELECT sec, count FROM (SELECT (epoch_us(ts) // 1000) // 1000 AS sec, count(*) AS count, max(event_id) AS o FROM events GROUP BY 1) ORDER BY count DESC, o LIMIT 1",
    "sliding_rate": "WITH s AS (SELECT (epoch_us(ts) // 1000) // 1000 AS sec, count(*) AS n FROM events GROUP BY 1) SELECT sec, round(sum(n) OVER (ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) / 60, 6) AS rate FROM s",
    "zero_filled_series": """WITH s AS (SELECT (epoch_us(ts) // 1000) // 1000 AS sec, count(*) AS count, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1), h AS (SELECT max(sec) AS head FROM s), a AS (SELECT unnest(generate_series(head - 599, head)) AS sec FROM h)
SELECT a.sec AS sec, coalesce(count, 0) AS count, coalesce(errors, 0) AS errors FROM a LEFT JOIN s USING (sec)""",
    "ceilings": "SELECT CAST(l_partkey AS VARCHAR) AS key, min(l_orderkey * 10 + l_linenumber) AS first_ord FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 512",
    "top_k": "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY 2 DESC, 1 LIMIT 25",
    "union_sources": BASE + "SELECT CAST(source AS INTEGER) AS source, channel, count(*) AS count FROM l, (VALUES (0), (1)) v(source) GROUP BY ALL",
    "histogram_by_part": "WITH " + _hist("lineitem", "l_suppkey", "l_extendedprice").lstrip() + " SELECT key, round(p50, 4) AS p50, round(p95, 4) AS p95, round(p99, 4) AS p99 FROM q",
    "search_stream": BASE + "SELECT event_id, channel FROM x WHERE level >= 1 AND kind = 'error' AND k % 4 = 1",
    "follow_subject": BASE + "SELECT event_id, CAST(level AS INTEGER) AS level FROM x WHERE coalesce(name, claimed) = 'r3'",
    "threshold_verdicts": BASE + ", c AS (SELECT (value / 1000) * 1000 AS ms, 'GET api.p' || (k % 3) || '.test/v1/items/#' AS shape FROM l WHERE kind = 'http')," + _hist("(SELECT * FROM x WHERE duration_ms IS NOT NULL AND endpoint IS NOT NULL)", "endpoint", "duration_ms") + """,
cm AS (SELECT shape, CAST(max(CAST(ms AS FLOAT)) AS DOUBLE) AS m FROM c GROUP BY shape),
v AS (SELECT 'error-rate>2%' AS threshold, count(*) FILTER (kind = 'error') / count(*) AS measured, CAST(NULL AS VARCHAR) AS culprit, '>' AS op, 0.02 AS bound FROM l
UNION ALL SELECT '5xx-rate>50%', count(*) FILTER (status = 500) / count(status), NULL, '>', 0.5 FROM l
UNION ALL SELECT 'p95>100ms', (SELECT p95 FROM q ORDER BY p95 DESC, key LIMIT 1), (SELECT key FROM q ORDER BY p95 DESC, key LIMIT 1), '>', 100
UNION ALL SELECT 'entries>1', count(*), NULL, '>', 1 FROM l
UNION ALL SELECT 'errors<5', count(*) FILTER (kind = 'error'), NULL, '<', 5 FROM l
UNION ALL SELECT 'messages-waiting>0', greatest(count(*) FILTER (kind = 'sent') - count(*) FILTER (kind = 'handled'), 0), NULL, '>', 0 FROM l
UNION ALL SELECT 'commands-failed>0', count(*) FILTER (kind = 'command' AND k % 2 = 1), NULL, '>', 0 FROM l
UNION ALL SELECT 'http-client-max>1s', (SELECT m FROM cm ORDER BY m DESC, shape LIMIT 1), (SELECT shape FROM cm ORDER BY m DESC, shape LIMIT 1), '>', 1000
UNION ALL SELECT 'deprecations>0', count(*) FILTER (kind = 'deprecation'), NULL, '>', 0 FROM l
UNION ALL SELECT 'request-error-rate>1%', count(*) FILTER (kind = 'error') / count(*) FILTER (kind = 'route'), NULL, '>', 0.01 FROM l)
SELECT threshold, round(CAST(measured AS DOUBLE), 6) AS measured, culprit, CASE op WHEN '>' THEN measured > bound ELSE measured < bound END AS breached FROM v""",
    "one_line": "SELECT doc_id, CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END AS shown, contains(lower(text), 'the and') AS hit FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: globals()[name] for name in ORACLE}
