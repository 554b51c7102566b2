"""Running values over blocks against plain loops over a key's rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from logscope.functions.parse import parse
from logscope.operators import scan, tables, timeline
from logscope.operators.analysis import Analysis, Options

LINE = "token string, ord long, ts_ms long, own struct<kind: string, name: string>, cmd struct<name: string, exited: boolean>"


def log(n, seed, tokens=("a", "b", "hot", "hot", "hot")):
    """Lines out of order in time, with subjects, exits and pauses."""
    rng, out, now = random.Random(seed), [], 0
    for i in range(n):
        now += rng.choice([0, 1, 2, 40, 120])
        name = f"n{rng.randrange(5)}"
        own = ("command", name) if rng.random() < 0.08 else ("endpoint", name) if rng.random() < 0.1 else None
        cmd = (name, rng.random() < 0.7) if own and own[0] == "command" else None
        out.append((rng.choice(tokens), i * 3, now - rng.choice([0, 0, 5, 200]), own, cmd))
    return out


def brute(lines, timeout):
    """run_no, subject, run_first_ms and the next exit of each line, token by token."""
    out = {}
    for token in {r[0] for r in lines}:
        own = [r for r in lines if r[0] == token]
        newest = run = None
        for k, (_, ord_, ts, subject, _) in enumerate(own):
            if newest is None or ts - newest >= timeout:
                run, name, first = (run or 0) + 1, None, ts
            newest, first, name = max(ts, newest if newest is not None else ts), min(first, ts), subject or name
            exits = [(r[1], r[4][0]) for r in own[k:] if r[4] and r[4][1]]
            out[ord_] = (run, name, first, exits[0] if exits else None)
    return out


@pytest.mark.parametrize(("bits", "seed", "carry"), [(3, 1, True), (5, 2, True), (17, 3, True), (17, 4, False)])
def test_runs_equal_a_loop(spark, bits, seed, carry):
    lines = log(400, seed)
    want = brute(lines, 100)
    got = scan.runs(spark.createDataFrame(lines, LINE).repartition(5), 100, bits, carry).collect()
    assert len(got) == len(lines)
    for r in got:
        assert (r.run_no, r.subject and tuple(r.subject), r.run_first_ms, r.exit and tuple(r.exit)) == want[r.ord], r.ord


@pytest.mark.parametrize("bits", [6, 12, 14, 30])
def test_sessions_over_blocks(spark, bits):
    rng = random.Random(bits)
    times = [sorted(rng.randrange(40_000) for _ in range(n)) for n in (1, 200, 40)]
    rows = [(str(k), t) for k, of in enumerate(times) for t in of]
    got = sorted(tuple(r) for r in scan.sessions(spark.createDataFrame(rows, "key string, ms long"), "key", "ms", 300, bits).collect())
    want = []
    for k, of in enumerate(times):
        cut = [0, *(i for i in range(1, len(of)) if of[i] - of[i - 1] >= 300), len(of)]
        want += [(str(k), of[a], of[b - 1], b - a) for a, b in zip(cut, cut[1:])]
    assert got == sorted(want)


@pytest.mark.parametrize("bits", [2, 17])
def test_previous_row_and_sessions(spark, bits):
    rng = random.Random(4)
    rows = [(rng.choice("xyyy"), i, i * rng.choice([1, 1, 9])) for i in range(200)] + [(None, 900, 1), (None, 901, 2)]
    df = spark.createDataFrame(rows, "key string, at long, v long")
    got = {r["at"]: r.was and r.was.v for r in scan.previous(df, "key", "at", F.struct("v"), "was", bits).where("key is not null").collect()}
    last, want = {}, {}
    for key, at, v in rows[:200]:
        want[at], last[key] = last.get(key), v
    assert got == want
    times = sorted(rng.randrange(4_000_000) for _ in range(300))
    made = timeline.sessions(spark.createDataFrame([("k", t) for t in times], "key string, ms long"), "key", "ms", 20_000)
    cut = [0, *(i for i in range(1, 300) if times[i] - times[i - 1] >= 20_000), 300]
    assert sorted((r.first_ms, r.last_ms, r.n) for r in made.collect()) == [(times[a], times[b - 1], b - a) for a, b in zip(cut, cut[1:])]


def test_a_hot_token_is_many_tasks_and_linear(spark):
    """One token on 1.5 million lines: blocks of it lie in several partitions, in seconds."""
    n = 1_500_000
    none = F.lit(None)
    lines = spark.range(n).select(
        F.lit("t").alias("token"), F.col("id").alias("ord"), (F.col("id") * 10).alias("ts_ms"),
        F.when(F.col("id") == 7, F.struct(F.lit("endpoint").alias("kind"), F.lit("home").alias("name"))).alias("own"),
        F.when(F.col("id") == n - 1, F.struct(F.lit("app:x").alias("name"), F.lit(True).alias("exited"))).otherwise(none).alias("cmd"),
    )
    start = time.time()
    d = scan.runs(lines, 5000)
    r = d.agg(F.count("*").alias("n"), F.max("run_no").alias("runs"), F.count("subject").alias("named"), F.max("run_first_ms").alias("first"), F.count("exit").alias("claims")).first()
    assert (r.n, r.runs, r.named, r.first, r.claims) == (n, 1, n - 7, 0, n)
    assert time.time() - start < 90


HEAD = "[2026-01-01T00:00:{:02d}+00:00] {}.{}: {} {} {{\"token\": \"{}\"}}"


def entries(spark, *lines):
    rows = [(0, i, HEAD.format(i, *x)) for i, x in enumerate(lines)]
    return parse(spark.createDataFrame(rows, "source int, ord long, value string")).where("level is not null")


def test_a_command_claims_deprecations_and_errors(spark):
    exit_line = 'Command "{}" exited with code "0"'
    a = Analysis(entries(
        spark,
        ("php", "INFO", "User Deprecated: old", "[]", "t1"),
        ("php", "INFO", "User Deprecated: old", "[]", "t2"),
        ("app", "ERROR", "broken", "[]", "t1"),
        ("console", "DEBUG", exit_line.format("app:late"), "[]", "t2"),
        ("console", "DEBUG", exit_line.format("app:x"), "[]", "t1"),
        ("php", "INFO", "User Deprecated: other", "[]", "t3"),
    ), Options(correlate_key="token", duration_key="duration_ms"))
    error = tables.errors(a).first()
    assert (error.endpoint, error.raised_by) == ("app:x", ["app:x"])
    got = {r.signature: (r.endpoint, r.raised_by, r.raised_by_capped) for r in tables.deprecations(a).collect()}
    # the command that exits first is the first to claim, though its line came second
    assert got == {"old": ("app:late", ["app:late", "app:x"], False), "other": (None, [], False)}
    a.close()


def test_a_later_name_replaces_a_claim(spark):
    a = Analysis(entries(
        spark,
        ("php", "INFO", "User Deprecated: old", "[]", "t1"),
        ("console", "DEBUG", 'Command "app:x" exited with code "0"', "[]", "t1"),
        ("request", "INFO", "Matched route", '{"route": "home"}', "t2"),
        ("php", "INFO", "User Deprecated: old", "[]", "t2"),
    ), Options(correlate_key="token", duration_key="duration_ms"))
    r = tables.deprecations(a).first()
    assert (r.endpoint, r.raised_by) == ("home", ["app:x", "home"])
    a.close()
