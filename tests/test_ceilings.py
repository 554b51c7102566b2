"""What tables detail when keys are refused, and what refused keys still feed."""

import io
import json

from logscope.__main__ import run
from logscope.functions.parse import parse
from logscope.operators import tables, views
from logscope.operators.analysis import Analysis, Options
from logscope.operators.ceilings import NAMES, Ceiled


def line(i, channel, message, context, token, level="INFO"):
    return f"[2026-01-01T00:00:{i % 60:02d}+00:00] {channel}.{level}: {message} {json.dumps(context)} {json.dumps({'token': token})}"


def log():
    out = []
    for r in range(3):
        out.append(line(len(out), "request", "Matched route", {"route": f"r{r}"}, f"t{r}"))
        for k in range(3):
            out += [line(len(out), "doctrine", "x", {"sql": f"SELECT {k}"}, f"t{r}")] * (k + 2)
            out.append(line(len(out), "http_client", f'Response: "200 https://h{k}.test/" 0.1 seconds', {}, f"t{r}"))
            out.append(line(len(out), "cache", f'now computing item "{"abc"[k]}"', {}, f"t{r}"))
            out.append(line(len(out), "messenger", f"Sending message M{k}", {"message_id": f"{r}-{k}"}, f"t{r}"))
        out.append(line(len(out), "app", f"broken {'xyz'[r]}", {}, f"t{r}", "ERROR"))
    return out


def analysis(spark):
    entries = parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(log())], "source int, ord long, value string"))
    return Analysis(entries, Options(correlate_key="token", duration_key="duration_ms", nplus1=2))


def test_the_first_keys_are_detailed_and_all_are_counted(spark):
    c = Ceiled(analysis(spark), {"routes": 2, "errors": 1, "sql": 2, "http": 1, "cache": 2, "messages": 1, "nplus1": 3, "open_requests": 1, "open_messages": 8}, shapes=1)
    shown = lambda what, key: sorted(r[key] for r in views.listed(c, what, 0).collect())
    assert (shown("endpoints", "endpoint"), shown("errors", "signature"), shown("http_calls", "shape")) == (["r0", "r1"], ["broken x"], ["h0.test"])
    assert (shown("cache_keys", "key"), shown("messages", "class")) == (["a", "b"], ["M0"])
    t = tables.totals(c).first()
    assert (t.entries, t.errors, t.http_calls, t.cache_misses, t.messenger_lines) == (len(log()), 3, 9, 9, 9)
    # a refused call feeds its run, a refused cache key or class doesn't
    assert {(r.calls, r.misses, r.messages, r.queries) for r in c.runs.collect()} == {(3, 2, 1, 9)}
    # a run details one statement, and no refused one
    assert {(r.what, r["shape"], r.n) for r in c.run_shapes.where("what = 'sql'").collect()} == {("sql", "SELECT 0", 2)}
    capped = {r.name: (r.keys, r.capped) for r in c.capped().collect()}
    assert set(capped) == set(NAMES.values())
    assert capped == {
        "routes": (3, True), "errors": (3, True), "deprecations": (0, False), "channels": (6, False), "sql shapes": (3, True), "n+1 patterns": (9, True), "outbound calls": (3, True), "message classes": (3, True),
        "open messages": (9, True), "cache keys": (3, True), "commands": (0, False), "open requests": (2, True),
    }
    c.close()


def test_without_reaching_them_ceilings_change_nothing(spark):
    a = analysis(spark)
    c = Ceiled(a)
    for what, key in (("endpoints", "endpoint"), ("errors", "signature"), ("nplus1", "sql"), ("channels", "channel"), ("cache_keys", "key")):
        assert sorted(r[key] for r in views.listed(c, what, 0).collect()) == sorted(r[key] for r in views.listed(a, what, 0).collect())
    assert c.capped().where("capped").isEmpty()
    c.close()


def test_the_command_line_tells_what_is_capped(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"[2026-01-01T00:00:00+00:00] c{i:03d}.INFO: x {{}} []" for i in range(600)) + "\n")
    out = io.StringIO()
    assert run(spark, [str(tmp_path / "a.log"), "--json", "--ceilings"], out) == 0
    d = json.loads(out.getvalue())
    assert d["capped"] == ["channels"] and len(d["channels"]) == 512 and d["totals"]["entries"] == 600
