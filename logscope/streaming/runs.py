"""Runs of a stream with their subjects, shapes and claims, in state.

One processor for each token holds, between micro-batches, the open run (its number, subject,
times and counts), a map from what the run repeats (a statement, a call, a message, a cache
key) to how often, and the lines that no subject has and no command has claimed yet.  A run
closes when the next line of its token is ``timeout_ms`` later than the latest before it, when the
token has been still for as long on the wall clock (a timer), or, at the end of a stream, by
``unfinished``, which reads the state that is left as a table.

The rows that come out are of three kinds (``what``): ``line`` with the subject so far, ``claim``
of a line by the command that exited, and ``run``.  ``lines_of``, ``claims_of`` and ``Closed`` take
them apart into what the batch analysis calls by the same names.

The rows of a token in one micro-batch are ordered in memory, so the source's budget bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logscope.operators.analysis import Options
from logscope.sources.store import settings

SHAPES = "array<struct<what: string, shape: string, n: bigint>>"
_RUN = "run_no long, kind string, name string, newest_ms long, first_ms long, last_ms long, queries long, calls long, messages long, misses long"
#: What comes out of the processor.
EVENT = "what string, token string, run_no long, kind string, name string, ord long, at long, first_ms long, last_ms long, queries long, calls long, messages long, misses long, shapes " + SHAPES
_FIELDS = [f.split()[0] for f in EVENT.split(", ", 13)]
_COUNTED = {"sql": "queries", "call": "calls", "message": "messages", "cache": "misses"}
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event(**of) -> Row:
    return Row(**{f: of.get(f) for f in _FIELDS})


class Tracker(StatefulProcessor):
    """The state of one token."""

    def __init__(self, timeout_ms: int, idle_ms: int, scrollback: int):
        self.timeout_ms, self.idle_ms, self.scrollback = timeout_ms, idle_ms, scrollback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)
        self.shapes = handle.getMapState("shapes", "what string, shape string", "n long")
        self.waiting = handle.getListState("waiting", "ord long")

    def _open(self) -> dict | None:
        return dict(zip([f.split()[0] for f in _RUN.split(", ")], self.run.get(), strict=True)) if self.run.exists() else None

    def _closed(self, token: str, run: dict, counted: dict[tuple[str, str], int]) -> Iterator[Row]:
        """The run, with what it repeated in state and in this batch."""
        total = {tuple(k): v[0] for k, v in self.shapes.iterator()}
        for k, n in counted.items():
            total[k] = total.get(k, 0) + n
        self.shapes.clear()
        if run["kind"] is not None:
            kept = {f: run[f] for f in ("run_no", "kind", "name", "first_ms", "last_ms", *_COUNTED.values())}
            yield _event(what="run", token=token, shapes=[Row(what=w, shape=s, n=n) for (w, s), n in sorted(total.items())], **kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        token, run, counted = key[0], self._open(), {}
        waiting = [r[0] for r in self.waiting.get()]
        for row in sorted(rows, key=lambda r: r.ord):
            if run is None or row.ts_ms - run["newest_ms"] >= self.timeout_ms:
                if run is not None:
                    yield from self._closed(token, run, counted)
                counted = {}
                run = {"run_no": (run["run_no"] if run else 0) + 1, "kind": None, "name": None, "newest_ms": row.ts_ms, "first_ms": row.ts_ms, "last_ms": row.ts_ms, **dict.fromkeys(_COUNTED.values(), 0)}
            run["newest_ms"] = max(run["newest_ms"], row.ts_ms)
            run["first_ms"], run["last_ms"] = min(run["first_ms"], row.ts_ms), max(run["last_ms"], row.ts_ms)
            if row.kind is not None:
                run["kind"], run["name"] = row.kind, row.name
            for what, count in _COUNTED.items():
                run[count] += row[count]
                if row[what] is not None:
                    counted[what, row[what]] = counted.get((what, row[what]), 0) + 1
            yield _event(what="line", token=token, run_no=run["run_no"], kind=run["kind"], name=run["name"], ord=row.ord, first_ms=run["first_ms"])
            if row.exited is not None:
                yield from (_event(what="claim", token=token, kind="command", name=row.exited, ord=o, at=row.ord) for o in waiting if row.ord - o < self.scrollback)
                waiting = []
            elif run["kind"] is None:
                waiting = [o for o in waiting if row.ord - o < self.scrollback] + [row.ord]
        for k, n in counted.items():
            self.shapes.updateValue(k, ((self.shapes.getValue(k)[0] if self.shapes.containsKey(k) else 0) + n,))
        self.run.update(tuple(run.values()))
        self.waiting.put([(o,) for o in waiting]) if waiting else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The token was still for so long: its run is over, its state goes, and the next line
        begins at number 1 again (with another first_ms)."""
        run = self._open()
        if run is not None:
            yield from self._closed(key[0], run, {})
        self.run.clear()
        self.waiting.clear()

    def close(self) -> None:
        pass


def tracked(lines: DataFrame, options: Options, idle_ms: int | None = None) -> DataFrame:
    """The events of a stream of typed lines (``Live.lines``); ``idle_ms`` is how long a token is
    still on the wall clock until its run is over, the timeout where it isn't given.

    Sets the session's state store to RocksDB, which such state needs.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    dispatched = F.coalesce(F.col("msg.event") == "dispatched", F.lit(False))
    of = {"sql": ("queries", F.col("sql").isNotNull(), F.col("sql")), "call": ("calls", F.col("http").isNotNull(), F.col("http.shape")), "message": ("messages", dispatched, F.when(dispatched, F.col("msg.class"))), "cache": ("misses", F.col("cache").isNotNull(), F.col("cache.key"))}
    counted = [c for what, (count, there, shape) in of.items() for c in (shape.alias(what), there.cast("long").alias(count))]
    rows = lines.where("token is not null").select(
        "token", "ord", "ts_ms", F.col("own.kind").alias("kind"), F.col("own.name").alias("name"), F.when(F.col("cmd.exited"), F.col("cmd.name")).alias("exited"), *counted,
    )
    tracker = Tracker(options.timeout_ms, idle_ms or options.timeout_ms, options.scrollback)
    return rows.groupBy("token").transformWithState(tracker, EVENT, "Append", "ProcessingTime")


def lines_of(events: DataFrame) -> DataFrame:
    """ord, run_no, subject, run_first_ms of the lines."""
    subject = F.when(F.col("kind").isNotNull(), F.struct("kind", "name"))
    return events.where("what = 'line'").select("token", "ord", "run_no", subject.alias("subject"), F.col("first_ms").alias("run_first_ms"))


def claims_of(events: DataFrame) -> DataFrame:
    """ord of a line, and the command that claimed it, where that exited."""
    return events.where("what = 'claim'").select("token", "ord", F.col("name").alias("claimed"), F.col("at").alias("claimed_at"))


class Closed:
    """Runs that are over, for the tables that read runs and shapes (``nplus1``, ``repetition``)."""

    def __init__(self, events: DataFrame, options: Options):
        self.options = options
        self.closed = events.where("what = 'run'")

    @property
    def runs(self) -> DataFrame:
        return self.closed.select("token", "run_no", "kind", "name", "first_ms", "last_ms", (F.col("last_ms") - F.col("first_ms")).alias("ms"), *_COUNTED.values())

    @property
    def run_shapes(self) -> DataFrame:
        return self.closed.select("token", "run_no", F.inline("shapes"), "name", "last_ms").select("token", "run_no", F.col("what"), "shape", "n", "name", "last_ms")

    def repeated(self, what: str) -> DataFrame:
        return self.run_shapes.where(F.col("what") == what)


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)


def unfinished(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs that a stopped query left open, as events (R05): those of the query's sink and
    these are all runs, each once.

    It reads what the last finished micro-batch left, and changes nothing.  A caller that goes on
    following the same log afterwards must not add it.
    """
    run = _state(spark, checkpoint, "run").select("key.token", "value.*").where("kind is not null")
    shapes = _state(spark, checkpoint, "shapes")
    counted = shapes.select("key.token", F.col("user_map_key.what").alias("what"), F.col("user_map_key.shape").alias("shape"), F.col("user_map_value.n").alias("n"))
    counted = counted.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("what", "shape", "n"))).alias("shapes"))
    made = run.join(counted, "token", "left").withColumns({"what": F.lit("run"), "shapes": F.coalesce("shapes", F.array().cast(SHAPES))})
    null = lambda c: F.lit(None).cast("long").alias(c)
    return made.select(*(null(c) if c in ("ord", "at") else F.col(c) for c in _FIELDS))


def replayed(lines: DataFrame, options: Options, folder: str) -> DataFrame:
    """The events of all that a stream of typed lines holds now, its open runs closed at the end.

    A call that failed is called again with the same folder: its query goes on from its
    checkpoint, and the closing pass overwrites what it wrote, so each run is there once.
    """
    spark, events = lines.sparkSession, f"{folder}/events"
    # the wall clock closes nothing, and no batches without rows wait for it
    with settings(spark, spark__sql__streaming__noDataMicroBatches__enabled="false"):
        query = tracked(lines, options, idle_ms=1 << 40).writeStream.format("parquet").option("path", events).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    unfinished(spark, f"{folder}/checkpoint").write.mode("overwrite").parquet(f"{folder}/open")
    return spark.read.schema(EVENT).parquet(events).unionByName(spark.read.schema(EVENT).parquet(f"{folder}/open"))


def open_runs(spark: SparkSession, checkpoint: str) -> int:
    """Runs that are open now."""
    return _state(spark, checkpoint, "run").count()
