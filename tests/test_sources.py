"""Archives, misnamed files, pipes and ends of files."""

import gzip
import io
import os
import random
import threading

import pytest

from logscope.__main__ import run
from logscope.sources import stream
from logscope.sources.text import discard, is_gzip, is_pipe, read_lines, spooled, unreadable


def got(df):
    return [(r["source"], r["value"]) for r in df.orderBy("source", "line_no").collect()]


def test_content_decides_not_the_name(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(gzip.compress(b"a\nb") + gzip.compress(b"b\nc\n"))
    (tmp_path / "y.log.gz").write_bytes(b"plain\ntext\n")
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"last"))
    (tmp_path / "one.gz").write_bytes(b"\x1f")
    (tmp_path / "none.gz").write_bytes(b"")
    names = ["x.log", "y.log.gz", "z.gz", "one.gz", "none.gz"]
    assert [is_gzip(spark, str(tmp_path / n)) for n in names] == [True, False, True, False, False]
    assert got(read_lines(spark, [f"file://{tmp_path}/{n}" if n == "z.gz" else str(tmp_path / n) for n in names])) == [(0, "a"), (0, "bb"), (0, "c"), (1, "plain"), (1, "text"), (2, "last"), (3, "\x1f")]
    # patterns are left to Spark's reader, which goes by the name
    os.mkdir(tmp_path / "day")
    for k in range(2):
        (tmp_path / "day" / f"{k}.gz").write_bytes(gzip.compress(b"p%d\n" % k))
    assert got(read_lines(spark, [f"{tmp_path}/day/*.gz"])) == [(0, "p0"), (0, "p1")]


def test_broken_archives_give_what_comes_before(spark, tmp_path):
    whole = gzip.compress(b"kept\n" * 300_000)
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "bad.gz").write_bytes(b"\x1f\x8bnothing of the kind")
    (tmp_path / "tailed.gz").write_bytes(gzip.compress(b"x\n") + b"garbage after it")
    counts = {r["source"]: r["count"] for r in read_lines(spark, [str(tmp_path / n) for n in ("cut.gz", "bad.gz", "tailed.gz")]).groupBy("source").count().collect()}
    assert 1000 < counts[0] < 300_000 and 1 not in counts and counts[2] == 1


def test_an_archive_is_read_in_bounded_pieces():
    packed = gzip.compress(b"0" * (50 << 20))
    parts = [len(p) for p in stream.unpacked(iter([packed]))]
    assert sum(parts) == 50 << 20 and max(parts) <= stream.CHUNK
    # magic bytes that lie on either side of a chunk's end
    two = gzip.compress(b"a") + gzip.compress(b"b")
    assert all(b"".join(stream.unpacked([two[:k], two[k:]])) == b"ab" for k in range(1, len(two)))


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_hold_each_line_once(spark, tmp_path, size):
    rng = random.Random(size)
    lines = [b"x" * rng.choice([0, 1, 3, 9, 30]) + str(i).encode() for i in range(60)]
    (tmp_path / "a.gz").write_bytes(b"\n".join(lines) + b"\n" * (size % 2))
    reader = stream.LinesReader({"files": f'[[3, "{tmp_path}/a.gz"]]', "last": "null", "range": str(size)})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["value"].encode() for r in sorted(rows, key=lambda r: r["line_no"])] == lines and {r["source"] for r in rows} == {3}
    if size == 64:
        assert [v for _, v in got(stream.streamed(spark, [(0, f"{tmp_path}/a.gz")], size=size))] == [x.decode() for x in lines]


def test_long_lines_are_cut_but_counted():
    text = b"a" * (stream.LINE_BYTES + 5) + b"\nb\n"
    parts = [text[k : k + 1000] for k in range(0, len(text), 1000)]
    assert list(stream.lines(parts)) == [(0, b"a" * stream.LINE_BYTES), (stream.LINE_BYTES + 6, b"b")]


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    read_bytes = 0

    def read(self, n=-1):
        part = super().read(n)
        self.read_bytes += len(part)
        return part


@pytest.mark.parametrize("end", [b"", b"\n"])
def test_the_end_of_a_file_is_found_from_its_end(end):
    text = b"\n".join(b"line %d" % i for i in range(2_000_000)) + end
    f = Counted(text)
    assert text[stream.last_start(f, len(text), 1000) :].split(b"\n")[0] == b"line 1999000" and f.read_bytes <= stream.CHUNK
    assert stream.last_start(Counted(b"a\nb"), 3, 5) == 0 and stream.last_start(Counted(b"a\n\n"), 3, 1) == 2 and stream.last_start(Counted(b"a"), 1, 0) == 1


def test_last_lines_of_plain_files_and_archives(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"1\n2\n3\n4")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"5\n6\n7\n"))
    (tmp_path / "day1.txt").write_bytes(b"x\ny\nz\n")
    paths = [str(tmp_path / "a.log"), str(tmp_path / "b.gz"), f"{tmp_path}/day*.txt"]
    assert got(read_lines(spark, paths, last=2)) == [(0, "3"), (0, "4"), (1, "6"), (1, "7"), (2, "y"), (2, "z")]


def test_missing_sources_are_told(spark, tmp_path):
    (tmp_path / "a.log").write_text("x")
    assert unreadable(spark, [str(tmp_path / "a.log"), str(tmp_path / "no.log"), "nosuch://x/y"]) == [str(tmp_path / "no.log"), "nosuch://x/y"]


LINE = '[2026-01-01T00:00:00+00:00] app.ERROR: broken {} []\n'


def test_pipes_are_spooled_and_plain_text_named_gz_is_reported(spark, tmp_path):
    os.mkfifo(tmp_path / "pipe")
    assert is_pipe(str(tmp_path / "pipe")) and not is_pipe(str(tmp_path / "none"))

    def write():
        with open(tmp_path / "pipe", "wb") as f:
            f.write(gzip.compress(LINE.encode() * 3))

    threading.Thread(target=write, daemon=True).start()
    (tmp_path / "plain.log.gz").write_text(LINE * 2)
    out, err = io.StringIO(), io.StringIO()
    assert run(spark, [str(tmp_path / "pipe"), str(tmp_path / "plain.log.gz"), "--json"], out, err) == 0, err.getvalue()
    assert '"entries": 5' in out.getvalue()
    path = spooled(spark, io.BytesIO(b"one\ntwo\n"))
    assert got(read_lines(spark, [path])) == [(0, "one"), (0, "two")]
    discard(spark, path)
    assert unreadable(spark, [path]) == [path]
