"""An analysis under ceilings (A24-A26, A30): each table details the first keys that arrive.

The first place of every key of every table is one aggregate over the lines, kept once; a table's
admitted keys are the first of them, a top-k (a bounded heap in each task, merged), so they
are few enough to be broadcast.  Totals count everything.  What a refused key still feeds: a refused
call its run's number of calls; a refused cache key or message class nothing of its run; a
refused statement no pattern.  A run details the first shapes of each kind.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.operators import tables
from logscope.operators.analysis import Analysis
from logscope.operators.tables import CEILINGS

#: Shapes of one kind that a run details.
SHAPES = 256
# What users know the tables as.
NAMES = {"routes": "routes", "errors": "errors", "deprecations": "deprecations", "channels": "channels", "sql": "sql shapes", "nplus1": "n+1 patterns", "http": "outbound calls", "messages": "message classes", "open_messages": "open messages", "cache": "cache keys", "commands": "commands", "open_requests": "open requests"}
#: The list of the report that a table's keys are those of, and its columns.
_LISTS = {"endpoints": ("routes", ("endpoint",)), "errors": ("errors", ("signature",)), "deprecations": ("deprecations", ("signature", "origin_key")), "channels": ("channels", ("channel",)), "http_calls": ("http", ("shape",)), "messages": ("messages", ("class",)), "commands": ("commands", ("name",)), "cache_keys": ("cache", ("key",))}


def _joined(*columns: str) -> Column:
    """One text of several key columns, as ``tables.key_places`` makes it."""
    return F.concat_ws("\0", *columns)


class Ceiled(Analysis):
    """The analysis of the same lines under ``limits`` (``CEILINGS`` where they name nothing)."""

    def __init__(self, a: Analysis, limits: dict[str, int] | None = None, shapes: int = SHAPES):
        self.options, self.shared, self.inside = a.options, a.shared, a.inside
        self._kept, self._over, self._owner, self.whole = [], {}, False, a
        self.limits, self.shapes = {**CEILINGS, **(limits or {})}, shapes

    @property
    def _found(self) -> dict:
        """That of the same lines without ceilings."""
        return self.whole._found

    @cached_property
    def first(self) -> DataFrame:
        """name, key, at: where each key of each table by lines comes first; kept."""
        return self.keep(tables.key_places(self.whole))

    def over(self, *columns: str) -> Analysis:
        """Itself: refused keys are taken from lines with all columns."""
        return self

    def admitted(self, name: str) -> DataFrame:
        """The keys of a table that are detailed."""
        return self.first.where(F.col("name") == name).orderBy("at", "key").limit(self.limits[name]).select("key")

    def admit(self, what: str, rows: DataFrame) -> DataFrame:
        """The rows of a list whose keys are detailed."""
        if what == "nplus1":
            return rows.orderBy("last_ms", "subject", "sql").limit(self.limits["nplus1"])
        name, columns = _LISTS[what]
        return rows.join(F.broadcast(self.admitted(name)), _joined(*columns) == F.col("key") if what != "cache_keys" else ["key"], "left_semi")

    @cached_property
    def enriched(self) -> DataFrame:
        """Lines without the cache keys and classes that are refused."""
        d = self.whole.enriched
        for name, column, key in (("cache", "cache", "cache.key"), ("messages", "msg", "msg.class")):
            known = F.broadcast(self.admitted(name).withColumnRenamed("key", "_key"))
            d = d.join(known, F.col(key) == F.col("_key"), "left").withColumn(column, F.when(F.col("_key").isNotNull(), F.col(column))).drop("_key")
        return self.keep(d)

    @cached_property
    def run_shapes(self) -> DataFrame:
        counted = super().run_shapes
        sql = counted.where("what = 'sql'").join(F.broadcast(self.admitted("sql").withColumnRenamed("key", "shape")), "shape", "left_semi")
        rest = counted.where("what <> 'sql'").unionByName(sql.select(counted.columns))
        nth = F.row_number().over(Window.partitionBy("token", "run_no", "what").orderBy("first_ord", "shape"))
        return self.keep(rest.repartition(self._parts, "token", "run_no").withColumn("_nth", nth).where(F.col("_nth") <= self.shapes).drop("_nth"))

    def close(self) -> None:
        super().close()
        self.whole.close()

    def _most_open(self, opened: DataFrame) -> DataFrame:
        """keys: the most that is open at once of (from_ms, to_ms), by seconds."""
        sec = lambda c: F.floor(F.col(c) / 1000)
        steps = opened.select(sec("from_ms").alias("sec"), F.lit(1).alias("n")).unionByName(opened.where("to_ms is not null").select((sec("to_ms") + 1).alias("sec"), F.lit(-1).alias("n")))
        day = steps.groupBy("sec").agg(F.sum("n").alias("n")).withColumn("day", F.floor(F.col("sec") / 86_400))
        # a day begins with what the days before left open
        left = day.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        inside = F.sum("n").over(Window.partitionBy("day").orderBy("sec"))
        return day.join(F.broadcast(left), "day").select((inside + F.col("before")).alias("open")).agg(F.coalesce(F.max("open"), F.lit(0)).cast("long").alias("keys"))

    def capped(self) -> DataFrame:
        """name, keys, capped of the twelve tables."""
        limit = F.create_map(*(F.lit(x) for pair in self.limits.items() for x in pair))
        seen = self.first.groupBy("name").agg(F.count("*").alias("keys"))
        none = seen.sparkSession.createDataFrame([(n,) for n in NAMES], "name string")
        lines = self.whole
        runs = self._most_open(lines.runs.select(F.col("first_ms").alias("from_ms"), (F.col("last_ms") + self.options.timeout_ms).alias("to_ms"))).select(F.lit("open_requests").alias("name"), "keys")
        sent = lines.lines.where("msg.id is not null").groupBy("msg.id").agg(F.min(F.when(F.col("msg.event") == "dispatched", F.col("ts_ms"))).alias("from_ms"), F.max(F.when(F.col("msg.event") == "handled", F.col("ts_ms"))).alias("to_ms")).where("from_ms is not null")
        messages = self._most_open(sent.withColumn("to_ms", F.when(F.col("to_ms").isNotNull(), F.greatest("from_ms", "to_ms")))).select(F.lit("open_messages").alias("name"), "keys")
        patterns = tables.nplus1(lines).agg(F.count("*").alias("keys")).select(F.lit("nplus1").alias("name"), "keys")
        found = seen.unionByName(runs).unionByName(messages).unionByName(patterns)
        shown = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
        return none.join(found, "name", "left").select(shown[F.col("name")].alias("name"), F.coalesce("keys", F.lit(0)).alias("keys"), (F.coalesce("keys", F.lit(0)) > limit[F.col("name")]).alias("capped"))
