"""Following growing log files (S03-S05, S07, R12, R13) as a Structured Streaming source.

``log_follow`` reads what was appended since the last micro-batch.  An offset holds, per path,
the file's identity (device and inode), the byte up to which entries are closed, and a
fingerprint of its first bytes: an entry is handed on when the next head line is there, or when
its file has been still for ``idleMs``.  A file of another identity, one that got shorter, or one
whose first bytes are others than before (cut and grown again, also while nobody followed) is
read from its start; what a rotation left unread of the old file is looked for beside it.

A batch takes up to ``maxBytesPerBatch`` of each file, and an entry more where one is longer; the rest
of a backlog comes in the batches after it (a trigger of all that is available takes one batch,
so it asks for no bound, 0).  A file's bytes are dealt out in ranges of ``rangeBytes``, a task
each: a task reads the entries that begin in its range.  Polls look only at bytes that they
have not seen.

The paths must be mounted on the driver and on the executors.  Other options: ``paths`` (JSON
list), ``startingOffsets`` (``latest`` or ``earliest``).
"""

from __future__ import annotations

import json
import os
import re
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logscope.functions.levels import CODES, NAMES
from logscope.functions.parse import parse
from logscope.operators.assemble import MESSAGE, joined
from logscope.sources.text import LINE_BYTES

SCHEMA = "source int, ord long, value string, more array<struct<ord: long, _bytes: long, _raw: string>>"
#: Bytes read at once when looking for heads, and of a fingerprint.
STEP, PRINT = 1 << 16, 1 << 10
#: Bytes of a file in one batch, and in one task.
BATCH, RANGE = 1 << 30, 64 << 20
_HEAD = re.compile(rb"\s*\[[^\]]*\]\s*[^:]*\.\s*(?:" + "|".join(NAMES).encode() + rb")\s*:")


def is_head(line: bytes) -> bool:
    """Whether the line begins an entry."""
    if not line.lstrip().startswith(b"{"):
        return bool(_HEAD.match(line))
    try:
        got = json.loads(line)
    except (ValueError, RecursionError):
        return False
    return isinstance(got, dict) and (got.get("level_name") in NAMES or (type(got.get("level")) is int and got["level"] in CODES))


def identity(path: str) -> tuple[str, int]:
    """Device and inode, and size; empty where there is no file."""
    try:
        s = os.stat(path)
    except OSError:
        return "", 0
    return f"{s.st_dev}:{s.st_ino}", s.st_size


def fingerprint(path: str, size: int | None = None) -> list[int]:
    """How many first bytes of a file, at most ``PRINT``, and their checksum."""
    try:
        with open(path, "rb") as f:
            head = f.read(PRINT if size is None else min(PRINT, size))
    except OSError:
        return [0, 0]
    return [len(head), zlib.crc32(head)]


def same_start(path: str, mark: list[int] | None) -> bool:
    """Whether the file still begins as it did when ``mark`` was taken."""
    return not mark or fingerprint(path, mark[0]) == list(mark)


def last_lines(path: str, size: int, low: int = 0) -> tuple[int, int]:
    """Where the last head before ``size`` begins, and the end of the last whole line; ``low``, where
    a line begins, for what isn't found above it."""
    end, buffer, at = None, b"", size
    with open(path, "rb") as f:
        while at > low:
            start = max(low, at - STEP)
            f.seek(start)
            buffer, at = f.read(at - start) + buffer, start
            if end is None and b"\n" in buffer:
                end = at + buffer.rindex(b"\n") + 1
            # lines that begin inside the buffer, the last first; the rest waits for more bytes
            begins = [m.end() + at for m in re.finditer(b"\n", buffer)] + ([low] if at == low else [])
            for b in sorted(begins, reverse=True):
                line = buffer[b - at :].split(b"\n", 1)[0]
                if end is not None and b < end and is_head(line):
                    return b, end
            if begins and at > low:
                # only the unfinished first line is needed again
                buffer = buffer[: min(begins) - at]
    return low, low if end is None else end


def next_head(path: str, start: int, size: int) -> int:
    """Where the first head after ``start`` begins; ``size`` if none does before."""
    with open(path, "rb") as f:
        f.seek(start)
        at = start + len(f.readline())
        while at < size:
            line = f.readline(LINE_BYTES)
            if is_head(line):
                return at
            while line and not line.endswith(b"\n"):
                at += len(line)
                line = f.readline(LINE_BYTES)
            at += len(line)
    return size


class Part(InputPartition):
    """A range of a file: the entries that begin in it, up to ``limit`` where the last one ends."""

    def __init__(self, source: int, path: str, start: int, end: int, limit: int, first: bool = True):
        super().__init__((source, path, start, end, limit, first))
        self.source, self.path, self.start, self.end, self.limit, self.first = source, path, start, end, limit, first


class FollowReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        of = {k.lower(): v for k, v in options.items()}
        self.paths = json.loads(of["paths"])
        self.latest = of.get("startingoffsets", "latest") == "latest"
        self.idle = int(of.get("idlems", "1000")) / 1000
        self.most = int(of.get("maxbytesperbatch", BATCH)) or 1 << 62
        self.range = int(of.get("rangebytes", RANGE))
        self.seen: dict[str, tuple[str, int, float]] = {}
        # what an idle poll handed on, so that a later head before it doesn't take it back
        self.floor: dict[str, tuple[str, int]] = {}
        # bytes after the floor that hold whole lines and no head
        self.bare: dict[str, int] = {}
        self.marks: dict[str, list[int]] = {}
        self.cut: dict[str, int] = {}
        self.done: dict[str, tuple[str, int]] = {}

    def initialOffset(self) -> dict:
        out = {}
        for k, path in enumerate(self.paths):
            name, size = identity(path)
            to = last_lines(path, size)[1] if self.latest and size else 0
            self.floor[path] = (name, to)
            out[str(k)] = [name, to, None, fingerprint(path, size)]
        return out

    def _forget(self, path: str) -> None:
        for of in (self.floor, self.bare, self.done):
            of.pop(path, None)

    def latestOffset(self) -> dict:
        out, now = {}, time.monotonic()
        for k, path in enumerate(self.paths):
            name, size = identity(path)
            before = self.seen.get(path)
            if before and before[0] == name and (size < before[1] or not same_start(path, self.marks.get(path))):
                # when it was cut marks the offsets since
                self.cut[path] = time.time_ns()
                self._forget(path)
            elif self.floor.get(path, (name,))[0] != name:
                self._forget(path)
            since = before[2] if before and before[:2] == (name, size) else now
            self.seen[path] = (name, size, since)
            low = self.floor.get(path, (name, 0))[1]
            out[str(k)] = [name, self._reach(path, size, low, now - since >= self.idle), self.cut.get(path), fingerprint(path, size)]
            self.floor[path], self.marks[path] = (name, out[str(k)][1]), out[str(k)][3]
        return out

    def _reach(self, path: str, size: int, low: int, still: bool) -> int:
        """The byte up to which entries are handed on now, ``low`` or more."""
        if size <= low:
            return low
        if size - low > self.most:
            head, _ = last_lines(path, low + self.most, low)
            # an entry that is longer than a batch comes whole
            return head if head > low else next_head(path, low, size)
        looked = max(low, self.bare.get(path, 0))
        head, end = last_lines(path, size, looked)
        found = head > looked or (looked > low and end > looked and self._is_head_at(path, looked))
        if not found:
            self.bare[path] = end
        return end if still else head if found else low

    @staticmethod
    def _is_head_at(path: str, at: int) -> bool:
        with open(path, "rb") as f:
            f.seek(at)
            return is_head(f.readline(LINE_BYTES))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for k, path in enumerate(self.paths):
            (was, at, old_cut, mark), (now, to, cut, _) = (start.get(str(k), ["", 0, None, None]) + [None])[:4], (end[str(k)] + [None])[:4]
            if was == now and (cut not in (None, old_cut) or not same_start(path, mark)):
                at = 0
                if to and identity(path)[0] == now and self.floor.get(path, (now, 0))[1] < to:
                    self._forget(path)
            elif was == now and to == at:
                continue
            if was and was != now:
                parts += [p for old in self._moved(path, was) for p in self._ranges(k, old, at, identity(old)[1])]
            size = identity(path)[1]
            if was == now and to < at <= size:
                # the first poll after a restart: what was handed on isn't read again
                self.done[path] = self.floor[path] = (now, at)
                continue
            name, least = self.done.get(path, ("", 0))
            if was == now == name and at < least <= size:
                at = least
            parts += self._ranges(k, path, at if was == now and at <= size else 0, to)
        return parts

    def _ranges(self, source: int, path: str, begin: int, to: int) -> list[InputPartition]:
        return [Part(source, path, at, min(at + self.range, to), to, at == begin) for at in range(begin, to, self.range)]

    @staticmethod
    def _moved(path: str, name: str) -> list[str]:
        folder = os.path.dirname(path) or "."
        return [p for p in (os.path.join(folder, f) for f in os.listdir(folder)) if identity(p)[0] == name]

    def read(self, part: Part) -> Iterator[tuple]:
        """(source, ord, value, more) of each entry; a line before a batch's first head is a row of
        its own, which is no entry (S14)."""
        first, value, more, size = None, "", [], 0
        with open(part.path, "rb") as f:
            at = part.start
            if not part.first:
                # a line that began before the range belongs to the range before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.limit:
                line = f.readline(LINE_BYTES)
                if not line:
                    break
                here, at = at, at + len(line)
                while not line.endswith(b"\n") and at < part.limit:
                    # past the ceiling: dropped up to the line's end
                    rest = f.readline(LINE_BYTES)
                    if not rest:
                        break
                    at += len(rest)
                    if rest.endswith(b"\n"):
                        break
                if here >= part.end and (first is None or is_head(line)):
                    break
                text = line.rstrip(b"\r\n").decode("utf-8", "replace")
                if is_head(line):
                    if first is not None:
                        yield part.source, first, value, more
                    first, value, more, size = (part.source << 42) + here, text, [], 0
                elif first is None:
                    # of a later range it belongs to an entry of the one before
                    if part.first and text.strip():
                        yield part.source, (part.source << 42) + here, text, []
                elif size < MESSAGE:
                    more.append(((part.source << 42) + here, size, text))
                    size += len(text.encode()) + 1
        if first is not None:
            yield part.source, first, value, more

    def commit(self, end: dict) -> None:
        pass


class FollowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_follow"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(self.options)


def followed(spark: SparkSession, paths: list[str], latest: bool = True, idle_ms: int = 1000, max_bytes: int = BATCH) -> DataFrame:
    """The same as ``follow``, with the lines that belong to no entry; their level is null."""
    spark.dataSource.register(FollowSource)
    rows = spark.readStream.format("log_follow").option("paths", json.dumps(paths)).option("startingOffsets", "latest" if latest else "earliest").option("idleMs", str(idle_ms)).option("maxBytesPerBatch", str(max_bytes)).load()
    return parse(rows).withColumn("message", joined(F.col("message"), F.col("more"))).drop("more")


def follow(spark: SparkSession, paths: list[str], latest: bool = True, idle_ms: int = 1000, max_bytes: int = BATCH) -> DataFrame:
    """Streaming entries (source, ord, ts, level, channel, message, context, extra)."""
    return followed(spark, paths, latest, idle_ms, max_bytes).where("level is not null")
