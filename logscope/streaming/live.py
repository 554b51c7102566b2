"""Live tables (R01-R11) over streaming entries.

Runs close when the next line of their token is ``timeout_ms`` later, or when the token has been
still for as long on the wall clock, so a silent log closes them too.  Late lines are
never dropped there: a line of a closed token opens a new run.  Windowed rates and session
totals use event time; of several sources the furthest behind holds the watermark.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logscope.functions.quantile import bucket, of_counts
from logscope.operators.analysis import Analysis, Lines, Options, Written
from logscope.plans.report import snapshot as snapshot_document
from logscope.sources.store import delete, shared_dir
from logscope.streaming.follow import followed
from logscope.streaming.runs import Closed, tracked


class Live(Analysis):
    """The typed lines of a stream; its keys are given, as a stream has no first entry to ask."""

    def __init__(self, entries: DataFrame, options: Options, launched_ms: int = 0):
        if not options.duration_key or (options.correlate and not options.correlate_key):
            raise ValueError("a stream needs duration_key, and correlate_key unless correlate is off")
        super().__init__(entries, options, launched_ms)

    def keep(self, df: DataFrame) -> DataFrame:
        return df

    @property
    def all(self) -> DataFrame:
        return self.shared.plan

    def narrow(self, *columns: str) -> DataFrame:
        return self.entries.select(*columns)

    def over(self, *columns: str) -> Live:
        """Itself: nothing is written of a stream's lines."""
        return self


def write_typed(lines: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append the typed lines of a stream to a table, so that each line is parsed once for all
    live tables and their micro-batches plan over a narrow scan."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def read_typed(lines: DataFrame, path: str) -> DataFrame:
    """The stream of what ``write_typed`` wrote of ``lines``."""
    return lines.sparkSession.readStream.schema(lines.schema).parquet(path)


def reports(paths: list[str], options: Options, spark: SparkSession, launched: datetime, every: float, latest: bool = True, ticks: int | None = None, idle_ms: int = 1000) -> Iterator[dict]:
    """The whole report of followed files every so many seconds (K03, R14, R15), ``ticks`` times or
    until the caller ends.

    A query types each line once, into a table; a report reads the table as far as it has come, so
    it equals the batch report of the same lines.  Its cost grows with the lines typed so far, not
    with the text: a long log is better asked for at longer intervals.
    """
    folder = f"{shared_dir(spark)}/follow-{uuid.uuid4().hex}"
    more = ((options.duration_key,) if options.duration_key else (), (options.correlate_key,) if options.correlate_key else ())
    lines = Lines(followed(spark, paths, latest, idle_ms), int(launched.timestamp() * 1000), *more, options.duration_unit)
    query = write_typed(lines.plan, f"{folder}/typed", f"{folder}/checkpoint")
    try:
        made = 0
        while ticks is None or made < ticks:
            time.sleep(every)
            if query.exception():
                raise query.exception()
            typed = spark.read.schema(lines.plan.schema).parquet(f"{folder}/typed") if query.lastProgress else spark.createDataFrame([], lines.plan.schema)
            a = Analysis(Written(typed.where("level is not null"), lines), options)
            yield snapshot_document(a, typed.where("level is null").count(), datetime.now(launched.tzinfo))
            a.close()
            made += 1
    finally:
        query.stop()
        delete(spark, folder)


def merged(streams: list[DataFrame], delay: str = "10 seconds") -> DataFrame:
    """Sources with a watermark each; the least one counts."""
    return reduce(DataFrame.unionByName, [s.withWatermark("ts", delay) for s in streams])


def live_runs(lines: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """Runs as they close (R01, R03, R04, R06); one without a subject is dropped."""
    return Closed(tracked(lines, Options(timeout_ms=timeout_ms)), Options()).runs.drop("run_no")


def session_totals(lines: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """Totals per token and event-time session (R01); ``lines`` carry a watermark on ts.

    The gap is a millisecond short, as sessions that are exactly a gap apart are merged.
    """
    session = F.session_window("ts", f"{timeout_ms - 1} milliseconds")
    # lines without a token move the watermark too: a filter on the token would be pushed below
    # it, so they are grouped, by salt, and left out afterwards
    salt = F.when(F.col("token").isNull(), F.pmod(F.xxhash64("ts_ms"), F.lit(64)))
    g = lines.groupBy("token", salt.alias("_salt"), session.alias("s")).agg(F.count("token").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("sql").alias("queries"))
    return g.where("n > 0").drop("s", "_salt")


def rates(lines: DataFrame, secs: int = 60) -> DataFrame:
    """Entries and errors per window of ``secs`` seconds, each second (R07 with 1, R08)."""
    w = F.window("ts", f"{secs} seconds", "1 second") if secs > 1 else F.window("ts", "1 second")
    g = lines.groupBy(w.alias("w")).agg(F.count("*").alias("count"), F.count(F.when(F.col("is_error"), 1)).alias("errors"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count", "errors", (F.col("count") / secs).alias("rate"))


def counters(lines: DataFrame) -> DataFrame:
    """Totals per endpoint and duration bucket, never dropping late lines.

    Its rows are endpoints times at most 673 buckets, however long the stream runs.
    """
    return lines.groupBy(F.col("own_endpoint").alias("endpoint"), bucket(F.col("duration_ms")).alias("_b"), F.col("duration_ms").isNotNull().alias("timed")).agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))


def snapshot(counted: DataFrame) -> DataFrame:
    """endpoint, entries, errors, timed, total_ms, max_ms, p50, p95, p99 of one set of counters."""
    timed = F.when(F.col("timed"), F.col("_n"))
    sums = counted.groupBy("endpoint").agg(F.sum("_n").alias("entries"), F.sum("errors").alias("errors"), F.coalesce(F.sum(timed), F.lit(0)).alias("timed"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"))
    q = of_counts(counted.where("timed").select("endpoint", "_b", "_n"), ["endpoint"]).withColumnRenamed("endpoint", "_endpoint")
    return sums.join(q, F.col("endpoint").eqNullSafe(F.col("_endpoint")), "left").drop("_endpoint")


def snapshots(lines: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", since_ms: int | None = None, once: bool = False) -> StreamingQuery:
    """Cumulative snapshots at each interval (R09, R14, R15); a new ``since_ms`` and checkpoint
    reset the counters (R10)."""
    kept = lines if since_ms is None else lines.where(F.col("ts_ms") >= since_ms)
    writer = counters(kept).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.foreachBatch(lambda batch, n: sink(snapshot(batch), n)).start()
