"""Log files (S01-S17): plain and gzip, in file order, with the reader's ceilings."""

from __future__ import annotations

import os
import stat
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscope.sources.store import shared_dir
from logscope.sources.stream import LINE_BYTES, MAGIC, opened, streamed


def decoded(raw) -> F.Column:
    """The first ``LINE_BYTES`` of a line, invalid UTF-8 replaced."""
    return F.make_valid_utf8(F.substring(raw.cast("binary"), 1, LINE_BYTES).cast("string"))


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def first_bytes(spark: SparkSession, path: str) -> list[bytes]:
    """The first two bytes of each file that ``path``, which may be a pattern, names; an error
    where there is none, or one can't be opened."""
    fs, at = _hadoop(spark, path)
    found = fs.globStatus(at)
    if not found:
        raise FileNotFoundError(path)
    out = []
    for status in found:
        if status.isFile():
            stream = fs.open(status.getPath())
            out.append(bytes(b for b in (stream.read(), stream.read()) if b >= 0))
            stream.close()
    return out


def unreadable(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that aren't there or can't be opened; the others are read without them."""
    bad = []
    for p in paths:
        try:
            first_bytes(spark, p)
        except Exception:  # noqa: BLE001 - whatever the file system says: this source can't be read
            bad.append(p)
    return bad


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as gzip does, whatever its name and wherever it lies."""
    return MAGIC in first_bytes(spark, path)


def is_pipe(path: str) -> bool:
    """Whether a path on this machine is a pipe, which can be read but once."""
    try:
        return stat.S_ISFIFO(os.stat(path).st_mode)
    except OSError:
        return False


def spooled(spark: SparkSession, stream) -> str:
    """What a pipe gives, written where all executors read; the caller deletes it (``discard``)."""
    fs, at = _hadoop(spark, f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}.log")
    out = fs.create(at)
    try:
        while part := stream.read(1 << 20):
            out.write(bytearray(part))
    finally:
        out.close()
    return at.toString()


def discard(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, False)


def read_lines(spark: SparkSession, paths: list[str], last: int | None = None, size: int | None = None) -> DataFrame:
    """source (place in ``paths``), line_no, value; of each file its last ``last`` lines.

    Plain files are split by Spark's reader; a line's number comes from counts per split, summed
    per file, so no file is ordered in one task.  Archives, text that is named as one, and ends of
    files are read by ``stream``.  A pattern, or a file that only Hadoop opens, is left to Spark's
    reader, which unpacks by name; what it finds broken gives what comes before.
    """
    parts, own = [], []
    for source, path in enumerate(paths):
        odd = is_gzip(spark, path) or path.endswith(".gz") or last is not None
        if odd and _opens(path):
            own.append((source, path))
            continue
        text = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(path)
        plain = numbered(text.select(F.lit(source).alias("source"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), decoded(F.col("value")).alias("value")))
        parts.append(plain if last is None else tail(plain, last))
    if own:
        parts.append(streamed(spark, own, last, **({} if size is None else {"size": size})))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _opens(path: str) -> bool:
    """Whether Python itself can open the file."""
    try:
        opened(path).close()
    except Exception:  # noqa: BLE001 - no such file system in pyarrow, a pattern, ...
        return False
    return True


def numbered(blocks: DataFrame) -> DataFrame:
    """Line numbers from (source, file, block, at): inside a block, after the blocks before."""
    key = ["source", "file", "block"]
    inside = Window.partitionBy(*key).orderBy("at")
    sizes = blocks.groupBy(*key).agg(F.count("*").alias("n"))
    base = sizes.select(*key, (F.sum("n").over(Window.partitionBy("source").orderBy("file", "block")) - F.col("n")).alias("base"))
    return blocks.withColumn("row", F.row_number().over(inside)).join(base, key).select("source", (F.col("base") + F.col("row") - 1).alias("line_no"), "value")


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last ``n`` numbered lines of each source (S06, S09), where all have been read."""
    last = lines.groupBy("source").agg(F.max("line_no").alias("_last"))
    return lines.join(last, "source").where(F.col("line_no") > F.col("_last") - n).drop("_last")


def merge_order(lines: DataFrame) -> DataFrame:
    """``ord`` for one source is the line number; several sources follow one another."""
    return lines.withColumn("ord", F.col("source").cast("long") * F.lit(1 << 42) + F.col("line_no"))
