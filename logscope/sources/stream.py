"""Log files read in order by one task each, as a batch data source.

``log_lines`` takes what Spark's text reader can't: gzip whatever its name, plain text named
``.gz``, and the end of a file alone.  A file is read in chunks, so memory doesn't grow with it or
with a line; plain text is cut into ranges of bytes, a task each, and a range holds the lines
that begin in it.  Rows are Arrow batches of (source, line_no, value); ``line_no`` orders a
source's lines: it counts them in an archive, and is the byte at which they begin elsewhere.

Files are opened where the tasks run: local and mounted paths as such, others by pyarrow.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a line that are kept, of a chunk, and of a range of plain text.
LINE_BYTES, CHUNK, RANGE = 1 << 20, 1 << 20, 128 << 20
MAGIC = b"\x1f\x8b"
#: Rows, and bytes of text, of one Arrow batch.
ROWS, BATCH = 10_000, 8 << 20


def opened(path: str):
    """A file to read by ``read`` and ``seek``."""
    if "://" not in path or path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path, "rb")
    import pyarrow.fs

    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def chunks(f, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    f.seek(start)
    left = None if end is None else end - start
    while left is None or left > 0:
        part = f.read(CHUNK if left is None else min(CHUNK, left))
        if not part:
            return
        left = None if left is None else left - len(part)
        yield part


def unpacked(packed: Iterable[bytes]) -> Iterator[bytes]:
    """What the members of an archive hold, piece by piece; a cut or broken one gives what comes
    before, and what follows the last member is left."""
    member, head = zlib.decompressobj(wbits=31), b""
    try:
        for part in packed:
            part = head + part
            head = b""
            while part:
                yield member.decompress(part, CHUNK)
                part = member.unconsumed_tail
                if member.eof:
                    part = member.unused_data
                    if len(part) < 2:
                        head, part = part, b""
                    elif part[:2] != MAGIC:
                        return
                    member = zlib.decompressobj(wbits=31)
        yield member.flush()
    except zlib.error:
        return


def lines(parts: Iterable[bytes], at: int = 0) -> Iterator[tuple[int, bytes]]:
    """(byte at which it begins, first ``LINE_BYTES``) of each line, of text that begins at ``at``."""
    held, begin = b"", at
    for part in parts:
        pieces = part.split(b"\n")
        for piece in pieces[:-1]:
            at += len(piece) + 1
            yield begin, held + piece[: LINE_BYTES - len(held)]
            held, begin = b"", at
        at += len(pieces[-1])
        held += pieces[-1][: LINE_BYTES - len(held)]
    if at > begin:
        yield begin, held


def last_start(f, size: int, n: int) -> int:
    """The byte at which the last ``n`` lines begin, found from the end backwards."""
    at, seen = size, 0
    if n <= 0:
        return size
    while at > 0:
        start = max(0, at - CHUNK)
        f.seek(start)
        part = f.read(at - start)
        if at == size and part.endswith(b"\n"):
            part = part[:-1]
        for k in range(part.count(b"\n")):
            place = part.rindex(b"\n")
            seen += 1
            if seen == n:
                return start + place + 1
            part = part[:place]
        at = start
    return 0


class Piece(InputPartition):
    """A range of a plain file, or a whole archive (``end`` is None); ``last``: lines of it."""

    def __init__(self, source: int, path: str, start: int, end: int | None, last: int | None):
        super().__init__((source, path, start, end, last))
        self.source, self.path, self.start, self.end, self.last = source, path, start, end, last


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.last = json.loads(options["last"])
        self.range = int(options.get("range", RANGE))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source, path in self.files:
            with opened(path) as f:
                packed = f.read(2) == MAGIC
                size = f.seek(0, 2)
                start = 0 if packed or self.last is None else last_start(f, size, self.last)
            if packed:
                out.append(Piece(source, path, 0, None, self.last))
            else:
                out += [Piece(source, path, at, min(at + self.range, size), None) for at in range(start, size, self.range)]
        return out or [Piece(-1, "", 0, 0, None)]

    def _rows(self, p: Piece) -> Iterator[tuple[int, bytes]]:
        with opened(p.path) as f:
            if p.end is None:
                numbered = enumerate(line for _, line in lines(unpacked(chunks(f))))
                yield from numbered if p.last is None else deque(numbered, p.last)
                return
            # the line over the range's first byte belongs to the range before, unless it begins there
            begin = max(0, p.start - 1)
            for at, line in lines(chunks(f, begin), begin):
                if at >= p.end:
                    return
                if at >= p.start:
                    yield at, line

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        if partition.source < 0:
            return
        for row in self._rows(partition):
            rows.append(row)
            size += len(row[1])
            if len(rows) == ROWS or size >= BATCH:
                yield self._batch(partition.source, rows)
                rows, size = [], 0
        if rows:
            yield self._batch(partition.source, rows)

    @staticmethod
    def _batch(source: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        text = pa.array([r[1].decode("utf-8", "replace") for r in rows], pa.string())
        return pa.record_batch([pa.array([source] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), text], names=["source", "line_no", "value"])


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "source int, line_no long, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def streamed(spark: SparkSession, files: list[tuple[int, str]], last: int | None = None, size: int = RANGE) -> DataFrame:
    """source, line_no, value of (source, path) pairs; of each its last ``last`` lines."""
    spark.dataSource.register(LinesSource)
    return spark.read.format("log_lines").option("files", json.dumps(files)).option("last", json.dumps(last)).option("range", str(size)).load()
