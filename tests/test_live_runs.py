"""Runs of a replayed log, in state, against the batch analysis of the same log."""

import random
import time

import pytest

from logscope.functions.parse import parse
from logscope.operators import tables
from logscope.operators.analysis import Analysis, Options
from logscope.streaming import runs
from logscope.streaming.live import read_typed

OPTIONS = Options(duration_key="duration_ms", correlate_key="token", timeout_ms=5000, nplus1=3, scrollback=40)


def log(seed, n=600):
    rng, out, now = random.Random(seed), [], 0
    for _ in range(n):
        now += rng.choice([1, 20, 300, 300, 4000])
        t = rng.choice(["a", "b", "c"])
        stamp = f"2026-01-01T{10 + now // 3_600_000:02d}:{now // 60_000 % 60:02d}:{now // 1000 % 60:02d}.{now % 1000:03d}+00:00"
        channel, message, context = rng.choice([
            ("request", "Matched route", f'{{"route": "r{rng.randrange(3)}"}}'), ("doctrine", "Executing", f'{{"sql": "SELECT {rng.randrange(2)} FROM t"}}'), ("doctrine", "Executing", '{"sql": "SELECT 1 FROM t"}'),
            ("http_client", f'Response: "200 https://api.test/v{rng.randrange(2)}/x" 0.2 seconds', "[]"), ("cache", 'Lock acquired, now computing item "k7"', "[]"),
            ("messenger", "Sending message App\\M with async sender", "[]"), ("app", "plain", "[]"), ("app", "plain", "[]"),
            ("console", f'Command "app:{rng.choice("xy")}" exited with code "0"', "[]"),
        ])
        out.append(f'[{stamp}] {channel}.INFO: {message} {context} {{"token": "{t}"}}')
    return out


def rows(df, *columns):
    return sorted(tuple(repr(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_a_replayed_log_equals_the_batch_tables(spark, tmp_path, parts):
    lines = log(parts)
    entries = parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "source int, ord long, value string"))
    batch = Analysis(entries, OPTIONS)
    folder, size = f"file://{tmp_path}/typed", len(lines) // parts
    for k in range(parts):
        batch.lines.where(f"ord >= {k * size} and ord < {(k + 1) * size}").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
    stream = spark.readStream.schema(batch.lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    whole = runs.replayed(stream, OPTIONS, f"file://{tmp_path}/live")
    assert runs.open_runs(spark, f"file://{tmp_path}/live/checkpoint") == 3
    # once more, as after a failure: nothing comes twice
    n = whole.count()
    whole = runs.replayed(stream, OPTIONS, f"file://{tmp_path}/live")
    assert whole.count() == n
    live = runs.Closed(whole, OPTIONS)
    for kind in ("runs", "run_shapes"):
        shown = getattr(live, kind).columns
        assert rows(getattr(live, kind), *shown) == rows(getattr(batch, kind), *shown), kind
    assert rows(tables.nplus1(live), "subject", "sql", "runs", "max_count", "total_count", "last_ms") == rows(tables.nplus1(batch), "subject", "sql", "runs", "max_count", "total_count", "last_ms")
    assert tables.nplus1(batch).count() > 0
    for what in ("sql", "call", "message", "cache"):
        assert rows(tables.repetition(live, what), "shape", "runs", "in_runs", "max_per_run", "worst_subject") == rows(tables.repetition(batch, what), "shape", "runs", "in_runs", "max_per_run", "worst_subject")
    assert rows(runs.lines_of(whole), "ord", "run_no", "subject", "run_first_ms") == rows(batch.enriched.where("token is not null"), "ord", "run_no", "subject", "run_first_ms")
    claims = batch.enriched.where("claimed is not null")
    assert rows(runs.claims_of(whole), "ord", "claimed", "claimed_at") == rows(claims, "ord", "claimed", "claimed_at") and claims.count() > 0
    batch.close()


def test_a_still_token_closes_by_the_clock(spark, tmp_path):
    entries = parse(spark.createDataFrame([(0, i, x) for i, x in enumerate(['[2026-01-01T10:00:00+00:00] request.INFO: Matched route {"route": "home"} {"token": "a"}'] * 2)], "source int, ord long, value string"))
    batch = Analysis(entries, OPTIONS)
    batch.lines.coalesce(1).write.parquet(f"file://{tmp_path}/typed")
    stream = read_typed(batch.lines, f"file://{tmp_path}/typed")
    short = Options(duration_key="duration_ms", correlate_key="token", timeout_ms=1000)
    query = runs.tracked(stream, short).writeStream.format("memory").queryName("still").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and not (got := spark.table("still").where("what = 'run'").collect()):
            assert not query.exception()
            time.sleep(0.3)
        assert [(r.token, r.name, r.first_ms == r.last_ms) for r in got] == [("a", "home", True)]
    finally:
        query.stop()
        batch.close()
