"""Following files and the live tables on small logs."""

import json
import os
import time

import pytest

from logscope.functions.parse import parse
from logscope.operators.analysis import Analysis, Options
from logscope.streaming.follow import FollowReader, follow, is_head, last_lines
from logscope.streaming.live import Live, live_runs, merged, rates, read_typed, session_totals, snapshots
from logscope.streaming.runs import open_runs

OPTIONS = Options(duration_key="duration_ms", correlate_key="token", timeout_ms=5000)


def line(second, message, level="INFO", **context):
    return f"[2026-01-01T10:00:{second:06.3f}+00:00] request.{level}: {message} {json.dumps(context)} []\n"


def request(start, token, ms):
    return line(start, f'Matched route "{token}".', route=f"r_{token}", token=token) + line(start + ms / 1000, "Request finished", route=f"r_{token}", token=token, duration_ms=ms)


def wait(query, rows, n, limit=150):
    end = time.time() + limit
    while time.time() < end and len(got := rows()) < n:
        if query.exception():
            raise query.exception()
        time.sleep(0.3)
    return got


def memory(spark, df, name, tmp_path, mode="append"):
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(processingTime="300 milliseconds").start()


def test_heads():
    assert is_head(line(1, "x").encode()) and is_head(b'{"level": 200, "message": "x"}') and is_head(b'{"level_name": "INFO"}')
    assert not any(map(is_head, (b"#0 x", b"[x] a.NOPE: b", b"{broken", b'{"level": 7}', b'{"level": 400.0}', b"[1]", b"")))


def test_last_lines_over_blocks(tmp_path):
    p = tmp_path / "a.log"
    first, second = line(1, "a").encode(), line(2, "b").encode()
    p.write_bytes(first + second + b"x" * 150_000 + b"\n#1\ncut")
    assert last_lines(str(p), p.stat().st_size) == (len(first), p.stat().st_size - 3)
    p.write_bytes(b"no head\ncut")
    assert last_lines(str(p), 11) == (0, 8)


def reader_rows(reader, start, end):
    return [(r[2].split(": ", 1)[1].split(" ")[0], [m[2] for m in r[3]]) for p in reader.partitions(start, end) for r in reader.read(p)]


def test_open_entries_rotation_and_truncation(tmp_path):
    p = tmp_path / "a.log"
    p.write_text(line(1, "a") + line(2, "b") + "#0 trace\n")
    r = FollowReader({"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "100000"})
    o0, o1 = r.initialOffset(), r.latestOffset()
    assert reader_rows(r, o0, o1) == [("a", [])]
    with p.open("a") as f:
        f.write("#1 more\n" + line(3, "c"))
    o2 = r.latestOffset()
    assert reader_rows(r, o1, o2) == [("b", ["#0 trace", "#1 more"])]
    os.rename(p, tmp_path / "a.log.1")
    p.write_text(line(4, "d") + line(5, "e"))
    o3 = r.latestOffset()
    assert sorted(reader_rows(r, o2, o3)) == [("c", []), ("d", [])]
    p.write_text(line(6, "f"))  # shorter, same file
    r.idle = 0
    assert reader_rows(r, o3, r.latestOffset()) == [("f", [])]


def test_restart_reads_nothing_twice(tmp_path):
    p = tmp_path / "a.log"
    p.write_text(line(1, "a") + line(2, "b"))
    options = {"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "0"}
    first = FollowReader(options)
    start, end = first.initialOffset(), first.latestOffset()
    assert [x for x, _ in reader_rows(first, start, end)] == ["a", "b"]
    again = FollowReader(options | {"idleMs": "100000"})
    low = again.latestOffset()
    assert reader_rows(again, end, low) == []
    with p.open("a") as f:
        f.write(line(3, "c") + line(4, "d"))
    assert [x for x, _ in reader_rows(again, low, again.latestOffset())] == ["c"]
    gone = FollowReader({"paths": json.dumps([str(tmp_path / "none")])})
    assert reader_rows(gone, gone.initialOffset(), gone.latestOffset()) == []


def drained(reader, start, limit=600):
    """All rows that polls hand on until nothing comes, the bytes of each batch, and its tasks."""
    rows, sizes, tasks = [], [], []
    for _ in range(limit):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        if not parts:
            return rows, sizes, tasks
        rows += [r for p in parts for r in reader.read(p)]
        sizes.append(sum(min(p.end, p.limit) - p.start for p in parts))
        tasks.append(len(parts))
        start = end
    raise AssertionError("no end")


@pytest.mark.parametrize(("most", "size"), [(1000, 100), (5000, 777), (300, 10_000), (0, 50)])
def test_a_backlog_comes_in_bounded_batches_of_several_tasks(tmp_path, most, size):
    p = tmp_path / "a.log"
    entries = [line(i % 60, f"m{i}") + "#trace\n" * (i % 4) for i in range(400)]
    p.write_text("orphan\n\n" + "".join(entries))
    r = FollowReader({"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "0", "maxBytesPerBatch": str(most), "rangeBytes": str(size)})
    rows, sizes, tasks = drained(r, r.initialOffset())
    assert [x[2] for x in rows[:1]] == ["orphan"] and [x[2].split(": ", 1)[1].split(" ")[0] for x in rows[1:]] == [f"m{i}" for i in range(400)]
    assert [len(x[3]) for x in rows[1:]] == [i % 4 for i in range(400)] and sum(sizes) == p.stat().st_size
    longest = max(map(len, entries))
    assert not most or (max(sizes) <= max(most, longest + 8) and len(sizes) > 3)
    assert size > 1000 or max(tasks) > 1


def test_an_entry_longer_than_a_batch_comes_whole(tmp_path):
    p = tmp_path / "a.log"
    p.write_text(line(1, "a") + "#more\n" * 500 + line(2, "b") + line(3, "c"))
    r = FollowReader({"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "0", "maxBytesPerBatch": "200", "rangeBytes": "500"})
    rows, _, _ = drained(r, r.initialOffset())
    assert [x[2].split(": ", 1)[1].split(" ")[0] for x in rows] == ["a", "b", "c"] and len(rows[0][3]) == 500


def test_an_open_entry_is_looked_at_once(tmp_path, monkeypatch):
    """Polls of an entry that grows without a head read what is new, not all of it again."""
    from logscope.streaming import follow as module

    p = tmp_path / "a.log"
    p.write_text(line(1, "a"))
    r = FollowReader({"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "100000"})
    start, looked = r.initialOffset(), []
    real = module.last_lines
    monkeypatch.setattr(module, "last_lines", lambda path, size, low=0: looked.append(size - low) or real(path, size, low))
    for k in range(5):
        with p.open("a") as f:
            f.write(f"#trace {k}\n" * 1000)
        assert r.partitions(start, r.latestOffset()) == []
    assert max(looked[1:]) <= 9 * 1000
    with p.open("a") as f:
        f.write(line(2, "b"))
    assert [(x, len(m)) for x, m in reader_rows(r, start, r.latestOffset())][0][0] == "a"


def test_cut_and_grown_while_nobody_followed(tmp_path):
    p = tmp_path / "a.log"
    options = {"paths": json.dumps([str(p)]), "startingOffsets": "earliest", "idleMs": "0"}
    p.write_text(line(1, "a") + line(2, "b"))
    first = FollowReader(options)
    end = (first.initialOffset(), first.latestOffset())[1]
    inode = p.stat().st_ino
    with p.open("r+") as f:  # the same file, longer than before, with other lines
        f.truncate(0)
        f.write(line(3, "c") + line(4, "d") + line(5, "e"))
    assert p.stat().st_ino == inode
    again = FollowReader(options)
    low = again.latestOffset()
    assert [x for x, _ in reader_rows(again, end, low)] == ["c", "d", "e"]
    # and while followed, between two polls
    with p.open("r+") as f:
        f.truncate(0)
        f.write(line(6, "f") + line(7, "g") + line(8, "h") + line(9, "i"))
    assert [x for x, _ in reader_rows(again, low, again.latestOffset())] == ["f", "g", "h", "i"]


def test_followed_runs_close(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text(line(0, "old", token="z"))
    lines = Live(follow(spark, [str(p)], idle_ms=300), OPTIONS).lines
    query = memory(spark, live_runs(lines, 2000), "live_runs", tmp_path)
    try:
        time.sleep(4)
        with p.open("a") as f:
            f.write(request(1, "a", 120) + line(2, "nameless", token="q") + request(9, "a", 30))
        got = wait(query, lambda: spark.table("live_runs").collect(), 2)
        assert sorted((r["token"], r["kind"], r["name"], r["ms"]) for r in got) == [("a", "endpoint", "r_a", 30), ("a", "endpoint", "r_a", 120)]
        # the still tokens close by the clock, and leave no state
        wait(query, lambda: [0] * (1 - min(1, open_runs(spark, f"file://{tmp_path}/ck_live_runs"))), 1)
        assert open_runs(spark, f"file://{tmp_path}/ck_live_runs") == 0
    finally:
        query.stop()


@pytest.fixture(scope="module")
def typed(spark, tmp_path_factory):
    """Streams of the typed lines of two sources, written once."""
    folder = tmp_path_factory.mktemp("typed")
    texts = [request(1, "a", 100) + line(1.5, "bad", "ERROR", token="a") + request(20, "a", 300) + line(59, "end"), request(2, "b", 50) + line(59, "end")]
    rows = [(k, i, x) for k, log in enumerate(texts) for i, x in enumerate(log.splitlines())]
    lines = Analysis(parse(spark.createDataFrame(rows, "source int, ord long, value string")), OPTIONS).lines
    for k in range(2):
        lines.where(f"source = {k}").coalesce(1).write.parquet(f"file://{folder}/{k}")
    return [read_typed(lines, f"file://{folder}/{k}") for k in range(2)]


def test_snapshots(spark, tmp_path, typed):
    taken = []
    query = snapshots(merged(typed, "1 second"), lambda df, n: taken.append(df.collect()), str(tmp_path / "ck"), once=True)
    assert query.awaitTermination(90)
    found = {r["endpoint"]: r for r in taken[-1]}
    assert (found["r_a"]["timed"], found["r_a"]["total_ms"], found["r_a"]["max_ms"]) == (2, 400.0, 300.0)
    assert found["r_a"]["p99"] == pytest.approx(300, rel=0.016) and found[None]["errors"] == 1 and found[None]["timed"] == 0


def test_rates(spark, tmp_path, typed):
    query = memory(spark, rates(merged(typed, "1 second"), 1), "rates", tmp_path)
    try:
        got = wait(query, lambda: spark.table("rates").collect(), 3)
    finally:
        query.stop()
    assert sorted((r["start"].second, r["count"], r["errors"]) for r in got)[:3] == [(1, 3, 1), (2, 2, 0), (20, 2, 0)]


def test_sessions(spark, tmp_path, typed):
    query = memory(spark, session_totals(merged(typed, "1 second")), "sessions", tmp_path)
    try:
        got = wait(query, lambda: spark.table("sessions").collect(), 3)
    finally:
        query.stop()
    assert sorted((r["token"], r["n"], r["last_ms"] - r["first_ms"]) for r in got) == [("a", 2, 300), ("a", 3, 500), ("b", 2, 50)]


def test_a_stream_needs_its_keys(spark):
    with pytest.raises(ValueError):
        Live(spark.range(0), Options())
