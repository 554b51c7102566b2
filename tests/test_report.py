"""Reports, bounds and the command line on a small log."""

import io
import json
import threading
import time
from datetime import UTC, datetime, timedelta, timezone

import pytest

from logscope.__main__ import run
from logscope.functions.parse import parse
from logscope.operators import tables, views
from logscope.operators.analysis import Analysis, Options
from logscope.plans import report
from logscope.plans.bounds import conflicts, parse_bound, read_from_start
from logscope.plans.thresholds import parse_threshold

LAUNCHED = datetime(2026, 9, 9, 12, 0, 30, tzinfo=timezone(timedelta(hours=2)))


def at(*of):
    return int(datetime(*of, tzinfo=LAUNCHED.tzinfo).timestamp() * 1000)


@pytest.mark.parametrize(
    "text, ms",
    [
        ("15m", at(2026, 9, 9, 11, 45, 30)), ("3d", at(2026, 9, 6, 12, 0, 30)), ("2026-09-09T14:30:00Z", at(2026, 9, 9, 16, 30)), (" 2026-09-08 14:30 ", at(2026, 9, 8, 14, 30)),
        ("2026-09-08", at(2026, 9, 8)), ("14:30", at(2026, 9, 9, 14, 30)), ("14:30:15", at(2026, 9, 9, 14, 30, 15)),
    ],
)
def test_bounds(text, ms):
    assert parse_bound(text, LAUNCHED) == ms


@pytest.mark.parametrize("text", ["15", "", "m", "1.5h", "2026-13-01", "25:00", "noon"])
def test_bounds_that_are_none(text):
    with pytest.raises(ValueError):
        parse_bound(text, LAUNCHED)


def test_range_and_conflicts():
    assert [read_from_start(*x) for x in ((False, None, False, None), (True, None, False, None), (True, None, False, "1h"), (True, 5, True, "1h"), (True, None, True, None))] == [True, False, True, False, True]
    assert conflicts(["errors>1"], False, 10) == [] and conflicts(["errors>1"], True, 10) and conflicts(["nplus1>0"], False, 0)


@pytest.mark.parametrize("text", ["errors", "what>1", "errors:x>1", "p95:>1", "p95>1%", "errors>1ms", "error-rate>x", "p95>", "p95>1_0", "p95>1 2", "p95>e3"])
def test_thresholds_that_are_none(text):
    with pytest.raises(ValueError):
        parse_threshold(text)


def test_any_number_is_a_bound():
    assert [parse_threshold(f"p95>{x}").value for x in ("1e3", "-1", "+.5", "5.", "1e-1s", " 2 ms ")] == [1000, -1, 0.5, 5, 100, 2]


def test_errors_of_a_subject_and_future_lines(spark):
    lines = [
        ("00", "request", "INFO", "Matched route", {"route": "a"}, "1"), ("01", "app", "ERROR", "broken", {}, "1"), ("02", "request", "INFO", "Matched route", {"route": "b"}, "2"), ("03", "app", "ERROR", "broken", {}, "2"),
        ("04", "app", "ERROR", "other", {"request_uri": "/Only?q=Here"}, "2"), ("05", "php", "INFO", "User Deprecated: x", {}, "1"), ("59", "app", "INFO", "from the future", {}, "9"),
    ]
    rows = [(0, i, f"[2026-01-01T00:00:{s}+00:00] {c}.{lv}: {m} {json.dumps(x)} {json.dumps({'token': t})}") for i, (s, c, lv, m, x, t) in enumerate(lines)]
    launched = 1_767_225_605_000
    a = Analysis(parse(spark.createDataFrame(rows, "source int, ord long, value string")), Options(correlate_key="token"), launched)
    shown = lambda what, name: sorted(r.signature for r in views.followed(a, what, name).collect())
    assert shown("errors", "a") == ["broken"] and shown("errors", "b") == ["broken"] and shown("errors", "/Only") == ["other"] and shown("errors", "c") == []
    assert shown("deprecations", "a") == ["x"] and shown("deprecations", "b") == []
    assert [r.ord for r in tables.stream(a, search="q=here").collect()] == [4]
    d = report.snapshot(a)
    # the line dated ahead counts in the second after the launch, and empties nothing
    assert d["throughput"]["last_60s_per_second"] == round(7 / 60, 2) and d["throughput"]["last_5s_per_second"] == 1.0
    a.close()


def test_breach_texts():
    assert parse_threshold("p95>0.5s").breach(812.4, "home") == "p95 (home) = 812ms > 500ms"
    assert parse_threshold("error-rate>=2%").breach(0.031, None) == "error-rate = 3.10% >= 2.00%"


def test_formats():
    assert [report.format_ms(x) for x in (0.25, 9.96, 10, 999, 1500)] == ["0.2 ms", "10.0 ms", "10 ms", "999 ms", "1.50 s"]
    assert [report.format_span(x) for x in (0.4, 5, 65, 3 * 3600 + 120, 90_000)] == ["0.4 s", "5 s", "1 min 5 s", "3 h 2 min", "1 d 1 h"]
    assert report.format_window(0, 86_400_000) == "1970-01-01 00:00:00 → 1970-01-02 00:00:00" and report.format_window(0, 1000).endswith("→ 00:00:01")
    assert report.shortened("abcdef", 4) == "abc…" and report.coverage(3, 2) is None
    assert report.slug("error", "App\\E: /api/1", datetime(2026, 1, 2, tzinfo=UTC)) == "logscope-error-App-E-api-1-20260102-000000"


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    def line(second, channel, level, message, **context):
        return f"[2026-09-09T10:00:{second:02d}+00:00] {channel}.{level}: {message} {json.dumps(context)} []\n"

    text = "lost\n"
    for k in range(3):
        token = {"token": f"t{k}"}
        text += line(k, "request", "INFO", 'Matched route "home".', route="home", **token)
        text += "".join(line(k, "doctrine", "DEBUG", "Executing statement", sql="SELECT 1", **token) for _ in range(4))
        text += line(k, "request", "INFO", "Request finished", route="home", status=500 if k == 2 else 200, duration_ms=100 * (k + 1), **token)
    text += line(5, "request", "CRITICAL", 'Uncaught PHP Exception App\\E: "x 1"', exception="[object] (App\\E(code: 0): x at /a.php:3)", token="t2") + "#0 trace\n"
    text += line(6, "console", "DEBUG", 'Command "app:import" exited with code "1"', command="app:import", code=1, token="c")
    text += line(7, "console", "CRITICAL", 'Error thrown while running command "app:import". Message: "x"', command="app:import", token="c")
    text += line(8, "messenger", "INFO", "[m1] Sent App\\Mail") + line(9, "messenger_audit", "INFO", "[m1] Received App\\Mail") + line(9, "cache", "INFO", 'Item "menu_1" is locked, waiting for it to be released', key="menu_1")
    path = tmp_path_factory.mktemp("log") / "app.log"
    path.write_text(text)
    return str(path)


def told(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = run(spark, list(argv), out, err)
    return code, out.getvalue(), err.getvalue()


def test_json_and_thresholds(spark, log):
    code, out, err = told(spark, log, "/nowhere/prod.log", "--json", "--nplus1", "3", "--fail-if", "errors>1", "--fail-if", "5xx-rate>90%")
    d = json.loads(out)
    assert code == report.UNREADABLE and "/nowhere/prod.log" in err and "errors = 2 > 1" in err and "5xx-rate" not in err
    assert (d["totals"]["entries"], d["totals"]["skipped"], d["totals"]["errors"], d["totals"]["requests"]) == (24, 1, 2, 3)
    assert list(d) == sorted(d) and d["duration_source"] == {"key": "duration_ms", "kind": "field", "timed": 3}
    assert d["nplus1"] == [{"avg_per_request": 4.0, "last_seen": d["nplus1"][0]["last_seen"], "max_per_request": 4, "runs_affected": 3, "sql": "SELECT 1", "subject": "home"}]
    (e,) = d["endpoints"]
    assert (e["endpoint"], e["requests"], e["status_5xx"], e["max_ms"], e["queries_max"]) == ("home", 3, 1, 300.0, 4)
    (c,) = d["commands"]
    assert (c["command"], c["runs"], c["failed"], c["threw"], c["last_code"]) == ("app:import", 1, 1, 1, 1)
    (m,) = d["messages"]
    assert (m["dispatched"], m["handled"], m["lag_timed"], m["lag_max_ms"]) == (1, 1, 1, 1000.0)
    assert (d["cache_keys"][0]["key"], d["cache_keys"][0]["contended"]) == ("menu_#", 1)
    assert d["errors"][0]["count"] == 1 and d["capped"] == []


def test_summary_items_and_usage(spark, log, tmp_path):
    code, out, _ = told(spark, log, "--summary", "--nplus1", "3", "--fail-if", "commands-failed>0")
    assert code == report.BREACHED
    facts = dict(line.split("  ", 1) for line in out.split("\n\n")[0].splitlines())
    facts = {k: v.strip() for k, v in facts.items()}
    assert (facts["entries"], facts["lines without an entry"], facts["timed by"], facts["answers 5xx"]) == ("24", "1", "field duration_ms", "1") and facts["errors"] == "2 = 8.33%"
    for what in ("endpoints", "nplus1", "commands", "cache_keys", "messages", "channels", "errors"):
        assert f"## {what}, " in out
    assert "## http_calls" not in out and "| home " in out
    code, out, _ = told(spark, log, "--item", "endpoints", "home", "--nplus1", "3")
    assert code == report.OK and "- repeated 4 times in a run: SELECT 1" in out and "- endpoint: home" in out
    code, out, _ = told(spark, log, "--item", "nplus1", "home", "--nplus1", "3", "--save", str(tmp_path / "out"))
    (saved,) = (tmp_path / "out").iterdir()
    assert code == report.OK and out.strip() == str(saved) and saved.name.startswith("logscope-nplus1-home-") and "- sql: SELECT 1" in saved.read_text()
    assert "There is no such row." in told(spark, log, "--item", "errors", "none")[1]
    assert told(spark, log, "--since", "soon")[0] == told(spark, log, "--fail-if", "nplus1>0", "--nplus1", "0")[0] == report.USAGE


def test_followed_reports_end_as_the_batch_report(spark, log, tmp_path):
    """A log that grows while it is followed: the last report is that of the whole log."""
    path, text = tmp_path / "app.log", open(log).read()
    path.write_text(text[: len(text) // 2])

    def grow():
        time.sleep(8)
        with path.open("a") as f:
            f.write(text[len(text) // 2 :])

    threading.Thread(target=grow, daemon=True).start()
    out = io.StringIO()
    assert run(spark, [str(path), "--follow", "--all", "--every", "12", "--nplus1", "3"], out, ticks=4) == report.OK
    taken = [json.loads(x) for x in out.getvalue().splitlines()]
    whole = json.loads(told(spark, log, "--json", "--nplus1", "3")[1])
    assert len(taken) == 4
    for d in (taken[-1], whole):
        d.pop("generated_at")
    assert taken[-1] == whole
    assert told(spark, log, "--follow", "--fail-if", "errors>1")[0] == report.USAGE
