"""Running values along the rows of one key, for keys of any size.

A key's rows are cut into blocks by their place.  Windows run inside a block, so the rows of a
hot key lie in many tasks; a block's summary (one row, whatever the block's size) is carried to
the blocks after it by a second window, over summaries only, and joined back.  The operators
carried are associative: a maximum, a sum, the last value since the last reset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of one block, as a power of two.
BITS = 17
#: Rows of one task: the windows sort a task's rows several times, some kilobytes a typed line.
TASK = 50_000


def blocked(rows: DataFrame, place: str, bits: int = BITS) -> DataFrame:
    return rows.withColumn("_block", F.shiftright(F.col(place).cast("long"), bits))


def inside(key: str, place: str, last: int = 0):
    """The rows of a key's block up to this one, or up to ``last`` before it."""
    return Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, last)


def blocks_before(key: str):
    """The summaries of a key's blocks before this one."""
    return Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def blocks_after(key: str):
    """The same for the blocks after it, the nearest last."""
    return Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)


def previous(rows: DataFrame, key: str, place: str, value: Column, name: str, bits: int = BITS) -> DataFrame:
    """``rows`` with what ``value``, a struct, was in the key's row before."""
    cut = blocked(rows, place, bits).withColumn("_value", value)
    ends = cut.groupBy(key, "_block").agg(F.max_by("_value", place).alias("_end"))
    carried = ends.select(key, "_block", F.last("_end", ignorenulls=True).over(blocks_before(key)).alias("_carried")).where("_carried is not null")
    local = F.lag("_value").over(Window.partitionBy(key, "_block").orderBy(place))
    return cut.join(carried, [key, "_block"], "left").withColumn(name, F.coalesce(local, "_carried")).drop("_block", "_value", "_carried")


def sessions(rows: DataFrame, key: str, place: str, timeout: int, bits: int = BITS) -> DataFrame:
    """key, first, last, n: the rows of a key, by a place that is a time, cut where the pause before one
    reaches ``timeout``.

    Sessions inside a block are final; only the first and last of each block meet those of its
    neighbours, two summaries a block.
    """
    cut = blocked(rows, place, bits)
    w = Window.partitionBy(key, "_block").orderBy(place)
    was = F.lag(place).over(w)
    cut = cut.withColumn("_new", (was.isNull() | (F.col(place) - was >= timeout)).cast("long"))
    cut = cut.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = cut.groupBy(key, "_block", "_k").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    local = local.withColumn("_edge", (F.col("_k") == 1) | (F.col("_k") == F.max("_k").over(Window.partitionBy(key, "_block"))))
    edges, order = local.where("_edge"), Window.partitionBy(key).orderBy("first")
    before = F.lag("last").over(order)
    edges = edges.withColumn("_new", (before.isNull() | (F.col("first") - before >= timeout)).cast("long"))
    edges = edges.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = edges.groupBy(key, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    shown = [key, "first", "last", "n"]
    return local.where("not _edge").select(*shown).unionByName(merged.select(*shown))


def _numbered(lines: DataFrame, timeout_ms: int, bits: int, carry: bool, parts: int | None):
    """``lines`` with _block, _new (1 where a run begins) and _k (runs of the block so far), and the
    windows over a token's blocks before and a block's rows so far."""
    cut, key = blocked(lines, "ord", bits), ["token", "_block"]
    cut = cut if parts is None else cut.repartition(parts, *key)
    before, upto = blocks_before("token"), inside("token", "ord")
    prior = F.max("ts_ms").over(inside("token", "ord", -1))
    if carry:
        newest = cut.groupBy(*key).agg(F.max("ts_ms").alias("_newest"))
        newest = newest.select(*key, F.max("_newest").over(before).alias("_newest")).where("_newest is not null")
        cut, prior = cut.join(newest, key, "left"), F.greatest("_newest", prior)
    d = cut.withColumn("_new", (prior.isNull() | (F.col("ts_ms") - prior >= timeout_ms)).cast("long")).drop("_newest")
    return d.withColumn("_k", F.sum("_new").over(upto)), before, upto


def numbered(lines: DataFrame, timeout_ms: int, bits: int = BITS, carry: bool = True, parts: int | None = None) -> DataFrame:
    """``lines`` (token, ord, ts_ms and more) with run_no alone, as by ``runs``: for who groups by
    run, and needs nothing of a run beside its lines."""
    d, before, _ = _numbered(lines, timeout_ms, bits, carry, parts)
    if not carry:
        return d.withColumn("run_no", F.col("_k")).drop("_block", "_new", "_k")
    key = ["token", "_block"]
    ends = d.groupBy(*key).agg(F.sum("_new").alias("n"))
    base = ends.select(*key, F.sum("n").over(before).alias("_base")).where("_base is not null")
    return d.join(base, key, "left").withColumn("run_no", F.coalesce("_base", F.lit(0)) + F.col("_k")).drop("_block", "_new", "_k", "_base")


def runs(lines: DataFrame, timeout_ms: int, bits: int = BITS, carry: bool = True, parts: int | None = None) -> DataFrame:
    """``lines`` (token, ord, ts_ms, own, cmd; no token is null) with their place in a run.

    Adds run_no (from 1), subject (the last ``own`` of the run so far), run_first_ms (the
    earliest ts_ms of the run so far) and exit (ord and name of the next command line of the
    token that exited, this one included).  A run begins where ts_ms is ``timeout_ms`` or more after the
    latest before it.  Without ``carry`` all lines are known to lie in one block.  Blocks are dealt
    over ``parts`` tasks, by default as the session says, whatever the input.
    """
    d, before, upto = _numbered(lines, timeout_ms, bits, carry, parts)
    key = ["token", "_block"]
    # a run without a subject yet hides that of the run before
    named = F.when(F.col("own").isNotNull(), F.struct("own")).when(F.col("_new") == 1, F.struct(F.lit(None).cast(lines.schema["own"].dataType).alias("own")))
    exited = F.when(F.col("cmd.exited"), F.struct("ord", F.col("cmd.name").alias("name")))
    # read from the end, so that each row's frame grows by one row
    back = Window.partitionBy(*key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_own": F.last(named, ignorenulls=True).over(upto), "_first": F.min(F.struct((-F.col("_k")).alias("k"), "ts_ms")).over(upto)["ts_ms"], "_exit": F.last(exited, ignorenulls=True).over(back)})
    if not carry:
        whole = {"run_no": F.col("_k"), "subject": F.col("_own")["own"], "run_first_ms": F.col("_first"), "exit": F.col("_exit")}
        return d.withColumns(whole).drop("_block", "_new", "_k", "_own", "_first", "_exit")
    ends = d.groupBy(*key).agg(F.sum("_new").alias("n"), F.max_by("_own", "ord").alias("own"), F.max_by("_first", "ord").alias("first"), F.min(exited).alias("exit"))
    ends = ends.withColumn("open", F.sum("n").over(Window.partitionBy("token").orderBy("_block")))
    # of the blocks before, those with the highest number end in the run that is open
    carried = ends.select(
        *key, F.sum("n").over(before).alias("_base"), F.last("own", ignorenulls=True).over(before).alias("_own_before"),
        F.min(F.struct((-F.col("open")).alias("k"), "first")).over(before)["first"].alias("_first_before"), F.last("exit", ignorenulls=True).over(blocks_after("token")).alias("_exit_after"),
    ).where("_base is not null or _exit_after is not null")
    d = d.join(carried, key, "left")
    whole = {
        "run_no": F.coalesce("_base", F.lit(0)) + F.col("_k"), "subject": F.coalesce("_own", "_own_before")["own"],
        "run_first_ms": F.when(F.col("_k") == 0, F.least("_first", "_first_before")).otherwise(F.col("_first")), "exit": F.coalesce("_exit", "_exit_after"),
    }
    return d.withColumns(whole).drop("_block", "_new", "_k", "_own", "_first", "_exit", "_base", "_own_before", "_first_before", "_exit_after")
