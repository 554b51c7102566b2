"""Reports of an analysis: a JSON snapshot, a text summary and single items.

Only the lists' first rows and one row of totals reach the driver.
"""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime, tzinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.functions.levels import NAMES, level_lower
from logscope.operators import tables, timeline, views
from logscope.operators.analysis import Analysis
from logscope.operators.ceilings import Ceiled

# Exit codes.
OK, UNREADABLE, USAGE, BREACHED = 0, 1, 2, 3
STATUS = ("1xx", "2xx", "3xx", "4xx", "5xx")


def format_ms(ms: float) -> str:
    return f"{ms / 1000:.2f} s" if ms >= 1000 else f"{ms:.0f} ms" if ms >= 10 else f"{ms:.1f} ms"


def format_count(n: int) -> str:
    return f"{n:,}"


def format_span(secs: float) -> str:
    """The two largest units of a span."""
    if secs < 1:
        return f"{secs:.1f} s"
    parts, left = [], int(secs + 0.5)
    for name, size in (("d", 86_400), ("h", 3_600), ("min", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n or parts or name == "s":
            parts.append(f"{n} {name}")
    return " ".join(parts[:2])


def format_window(first_ms: int | None, last_ms: int | None, zone: tzinfo = UTC) -> str:
    """From first to last, the date once where both are on one day."""
    if first_ms is None or last_ms is None:
        return "--:--:-- → --:--:--"
    first, last = (datetime.fromtimestamp(ms / 1000, zone) for ms in (first_ms, last_ms))
    return f"{first:%Y-%m-%d %H:%M:%S} → {last.strftime('%H:%M:%S' if first.date() == last.date() else '%Y-%m-%d %H:%M:%S')}"


def coverage(part: int, whole: int) -> str | None:
    return f"{format_count(part)} of {format_count(whole)} requests" if 0 < whole and part <= whole else None


def shortened(text: str, size: int) -> str:
    """At most ``size`` characters with the ellipsis (N05, for display)."""
    return text if len(text) <= size else text[: size - 1] + "…"


def slug(what: str, name: str | None, at: datetime) -> str:
    """A file name for a report."""
    # fixed values: characters of the name that are looked at, and that are kept
    clean = re.sub(r"[^A-Za-z0-9_]+", "-", (name or "")[:60]).strip("-")[:40]
    return "-".join(x for x in ("logscope", what, clean, f"{at:%Y%m%d-%H%M%S}") if x)


def iso(ms: int | None) -> str | None:
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).isoformat(timespec="milliseconds")


def _r(column: str, digits: int, name: str | None = None, zero: bool = False):
    c = F.round(F.col(column).cast("double"), digits)
    return (F.coalesce(c, F.lit(0.0)) if zero else c).alias(name or column)


def _seen(name: str, column: str):
    return F.col(column).alias(name)


def list_rows(a: Analysis, what: str, top: int | None = None) -> DataFrame:
    """A list as the snapshot shows it; times are ms there, and RFC 3339 in the document."""
    rows = views.listed(a, what, top)
    times = lambda p, zero: [_r(f"p{k}", 2, f"{p}p{k}_ms", zero) for k in (50, 95)]
    repeated = [F.coalesce("runs", F.lit(0)).alias("requests_affected"), F.coalesce(F.round(F.try_divide("in_runs", "runs"), 1), F.lit(0.0)).alias("avg_per_request"), F.coalesce("max_per_run", F.lit(0)).alias("max_per_request"), "worst_subject", _seen("last_seen", "last_ms")]
    shown = {
        "channels": lambda: ["channel", "count", "errors"],
        "errors": lambda: ["signature", "count", level_lower(F.col("level")).alias("level"), "channel", "exception", "endpoint", "method", "raised_by", "raised_by_capped", _seen("first_seen", "first_ms"), _seen("last_seen", "last_ms"), F.substring_index("message", "\n", 1).alias("message")],
        "deprecations": lambda: ["signature", "count", "channel", "origin", "endpoint", "raised_by", "raised_by_capped", _seen("first_seen", "first_ms"), _seen("last_seen", "last_ms"), "message"],
        "endpoints": lambda: ["endpoint", F.greatest("requests", F.coalesce("timed", F.lit(0))).alias("requests"), "errors", _r("error_rate", 4), "responses", "status_4xx", "status_5xx", F.coalesce("timed", F.lit(0)).alias("timed"), *times("", True), _r("p99", 2, "p99_ms", True), _r("max_ms", 2, zero=True), _r("avg_ms", 2, zero=True), _r("queries_avg", 1), "queries_max", _r("calls_avg", 1, "http_calls_avg"), F.col("calls_max").alias("http_calls_max")],
        "nplus1": lambda: ["subject", "sql", F.col("runs").alias("runs_affected"), F.col("max_count").alias("max_per_request"), _r("avg_count", 1, "avg_per_request"), _seen("last_seen", "last_ms")],
        "commands": lambda: [F.col("name").alias("command"), "runs", "failed", _r("failure_rate", 4), "threw", "last_code", "closed_runs", _r("queries_avg", 1), "queries_max", _r("calls_avg", 1, "http_calls_avg"), F.col("calls_max").alias("http_calls_max"), "timed", *times("", False), _r("max_ms", 2), _r("avg_ms", 2), _seen("first_seen", "first_ms"), _seen("last_seen", "last_ms")],
        "cache_keys": lambda: ["key", "misses", "computed", "contended", *repeated],
        "messages": lambda: ["class", "dispatched", "handled", "waiting", F.col("ran").alias("handler_runs"), "no_handler", "retried", "failed", F.col("paired").alias("lag_timed"), *times("lag_", False), _r("max_lag_ms", 2, "lag_max_ms"), *repeated],
        "http_calls": lambda: ["shape", "calls", "timed", *times("", True), _r("p99", 2, "p99_ms", True), _r("max_ms", 2, zero=True), _r("avg_ms", 2, zero=True), "responses", "status_4xx", "status_5xx", *repeated],
    }
    return rows.select(*shown[what]())


def snapshot(a: Analysis, skipped: int = 0, generated: datetime | None = None) -> dict:
    """All counters and lists (K02), under its ceilings if it is a ``Ceiled`` analysis; a rate
    without a population is null."""
    a.all  # typed in full at once, as the lists read every column
    t, now = tables.totals(a).first().asDict(), generated or datetime.now(UTC)
    status = {r["class"]: r["count"] for r in tables.status_classes(a).collect()}
    seconds = timeline.seconds(a.lines, a.shared.launched_ms or None)
    peak = timeline.peak(seconds).first()
    tail = lambda secs: seconds.agg(F.max("sec").alias("head")).crossJoin(seconds).where(F.col("sec") > F.col("head") - secs).agg(F.sum("count")).first()[0] or 0
    shapes, sums = views.shape_counts(a), tables.message_totals(a).first()
    runs = tables.commands(a).agg(F.coalesce(F.sum("runs"), F.lit(0)), F.coalesce(F.sum("failed"), F.lit(0))).first()
    rate = lambda x, digits=4: None if x is None else round(x, digits)
    last = t["last_ms"]
    opened = 0 if last is None else a.runs.where(F.col("last_ms") + a.options.timeout_ms > last).count()
    # fixed values: the names of the document
    document = {
        "generated_at": now.isoformat(),
        "window": {"first_seen": iso(t["first_ms"]), "last_seen": iso(last), "span_seconds": 0.0 if last is None else round(max(0, last - t["first_ms"]) / 1000, 3)},
        "totals": {"entries": t["entries"], "skipped": skipped, "errors": t["errors"], "error_rate": rate(t["error_rate"]), "requests": t["requests"], "request_errors": t["request_errors"], "request_error_rate": rate(t["request_error_rate"]), "deprecations": t["deprecations"], "out_of_window": tables.out_of_window(a).first()[0]},
        "levels": {r["level"]: r["count"] for r in tables.levels(a).collect()},
        "status": {"responses": t["responses"], **{name: status.get(k + 1, 0) for k, name in enumerate(STATUS)}, "rate_5xx": rate(t["rate_5xx"])},
        "throughput": {"peak_per_second": peak["count"] if peak else 0, "peak_at": iso(peak["sec"] * 1000) if peak else None, "last_5s_per_second": round(tail(5) / 5, 2), "last_60s_per_second": round(tail(60) / 60, 2)},
        "duration_source": {**views.duration_source(a), "timed": t["timed"]},
        "open_requests": opened,
        "capped": sorted(r["name"] for r in a.capped().where("capped").collect()) if isinstance(a, Ceiled) else [],
        "sql": {"shapes": shapes["sql"], "nplus1_threshold": a.options.nplus1},
        "console": {"lines": t["command_lines"], "commands": shapes["commands"], "runs": runs[0], "failed": runs[1]},
        "cache": {"misses": t["cache_misses"], "keys": shapes["cache"]},
        "messenger": {"lines": t["messenger_lines"], "classes": shapes["classes"], "dispatched": sums["dispatched"], "handled": sums["handled"], "waiting": sums["waiting"], "failed": sums["failed"]},
        "http_client": {"calls": t["http_calls"], "timed": t["http_timed"], "shapes": shapes["http"]},
    }
    for what in views.LISTS:
        document[what] = [{k: iso(v) if k in ("first_seen", "last_seen") else v for k, v in r.asDict().items()} for r in list_rows(a, what).collect()]
    return document


def render_json(document: dict, pretty: bool = True) -> str:
    """Keys in alphabetical order."""
    return json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2 if pretty else None)


#: What the summary tabulates: of each list the columns of the document, and how a number is shown.
TABLES = {
    "channels": {"channel": str, "count": format_count, "errors": format_count},
    "errors": {"signature": str, "level": str, "count": format_count, "endpoint": str},
    "deprecations": {"signature": str, "count": format_count, "endpoint": str},
    "endpoints": {"endpoint": str, "requests": format_count, "p95_ms": format_ms, "max_ms": format_ms, "status_5xx": format_count},
    "nplus1": {"subject": str, "sql": str, "max_per_request": format_count, "runs_affected": format_count},
    "commands": {"command": str, "runs": format_count, "failed": format_count},
    "messages": {"class": str, "dispatched": format_count, "handled": format_count, "waiting": format_count},
    "http_calls": {"shape": str, "calls": format_count, "p95_ms": format_ms},
    "cache_keys": {"key": str, "misses": format_count},
}
#: Characters of a cell.
CELL = 48


def _facts(d: dict, zone: tzinfo) -> list[tuple[str, str]]:
    """Names and values of what the document says of the whole log."""
    t, s, source = d["totals"], d["status"], d["duration_source"]
    at = lambda text: datetime.fromisoformat(text).astimezone(zone).strftime("%Y-%m-%d %H:%M:%S") if text else "-"
    rate = lambda x: "-" if x is None else f"{x:.2%}"
    return [
        ("first line", at(d["window"]["first_seen"])), ("last line", at(d["window"]["last_seen"])), ("span", format_span(d["window"]["span_seconds"])),
        ("entries", format_count(t["entries"])), ("lines without an entry", format_count(t["skipped"])), ("entries outside the bounds", format_count(t["out_of_window"])),
        ("errors", f"{format_count(t['errors'])} = {rate(t['error_rate'])}"), ("requests", format_count(t["requests"])), ("request errors", f"{format_count(t['request_errors'])} = {rate(t['request_error_rate'])}"),
        *((f"answers {k}", format_count(s[k])) for k in STATUS if s[k]), ("share of 5xx", rate(s["rate_5xx"])),
        ("fullest second", format_count(d["throughput"]["peak_per_second"])), ("timed by", " ".join(str(source[k]) for k in ("kind", "key") if k in source)), ("timed entries", format_count(source["timed"])),
        *((f"level {n.lower()}", format_count(d["levels"][n.lower()])) for n in reversed(NAMES) if d["levels"][n.lower()]),
        *([("tables at their ceiling", ", ".join(d["capped"]))] if d["capped"] else []),
    ]


def render_summary(d: dict, zone: tzinfo = UTC, rows: int = 10) -> str:
    """The document as text (K01): a column of facts, then each list that has rows as a Markdown
    table under its own column names."""
    facts = _facts(d, zone)
    width = max(len(name) for name, _ in facts)
    out = [f"{name.ljust(width)}  {value}" for name, value in facts]
    for what, columns in TABLES.items():
        found = d[what][:rows]
        if not found:
            continue
        cells = [[name for name in columns]] + [["-" if r[name] is None else shortened(show(r[name]), CELL) for name, show in columns.items()] for r in found]
        widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
        lines = [f"| {' | '.join(c.ljust(w) for c, w in zip(row, widths, strict=True))} |" for row in cells]
        out += ["", f"## {what}, {len(found)} of {len(d[what])}", lines[0], f"|{'|'.join('-' * (w + 2) for w in widths)}|", *lines[1:]]
    return "\n".join(out) + "\n"


#: Rows of one name that an item report shows: queries of a subject, origins of a deprecation.
ITEMS = 50


def item_report(a: Analysis, what: str, name: str, sources: list[str], at: datetime) -> str:
    """The rows of a list under one name with a header (K06, K11): every repeated query of a
    subject, every origin of a deprecation; of an endpoint its repeated queries too."""
    _, falls, names = views.LISTS[what]
    rows = views.keep_top(views.LISTS[what][0](a).where(F.col(names[0]) == name), views.order_of(what), ITEMS).collect()
    out = [f"# {what}: {name}", "", f"of {', '.join(sources)}", f"at {at.isoformat(timespec='seconds')}", ""]
    if not rows:
        out += ["There is no such row.", ""]
    for row in rows:
        shown = {k: v for k, v in row.asDict().items() if v is not None and v != []}
        # the row's own keys come first, and whole
        for k in (*names, *(k for k in shown if k not in names)):
            if k in shown:
                v = shown[k]
                out.append(f"- {k}: {', '.join(v) if isinstance(v, list) else iso(v) if k in ('first_ms', 'last_ms') else v}")
        out.append("")
    if what == "endpoints" and rows:
        out += [f"- repeated {r['max_count']} times in a run: {r['sql']}" for r in views.endpoint_patterns(a, name).limit(ITEMS).collect()]
    return "\n".join(out).rstrip() + "\n"


def exit_code(unreadable: list[str], breaches: list[str]) -> int:
    """What was not read outweighs a crossed threshold."""
    return UNREADABLE if unreadable else BREACHED if breaches else OK
