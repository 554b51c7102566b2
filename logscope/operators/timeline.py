"""The time axis (X05-X08, R07, R08): per-second series, sliding rates and the peak."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.operators import scan


def seconds(lines: DataFrame, newest_ms: int | None = None) -> DataFrame:
    """sec, count, errors, reach_ord; later than ``newest_ms`` + 1 s counts as that."""
    ms = F.col("ts_ms") if newest_ms is None else F.least(F.col("ts_ms"), F.lit(newest_ms + 1000))
    return lines.groupBy(F.floor(ms / 1000).alias("sec")).agg(F.count("*").alias("count"), F.count(F.when(F.col("is_error"), 1)).alias("errors"), F.max("ord").alias("reach_ord"))


def peak(per_second: DataFrame) -> DataFrame:
    """The fullest second; of equals the one that reached it first."""
    return per_second.orderBy(F.desc("count"), "reach_ord").limit(1).select("sec", "count")


def series(per_second: DataFrame, n: int) -> DataFrame:
    """The last ``n`` seconds up to the newest, with zeros."""
    head = per_second.agg(F.max("sec").alias("head")).where("head is not null")
    axis = head.select(F.explode(F.sequence(F.col("head") - (n - 1), F.col("head"))).alias("sec"))
    return axis.join(per_second.select("sec", "count", "errors"), "sec", "left").na.fill(0, ["count", "errors"])


def sliding_rate(per_second: DataFrame, secs: int) -> DataFrame:
    """Entries a second over the ``secs`` seconds up to each, cut into days before the window."""
    day = F.floor(F.col("sec") / 86400)
    own = per_second.select("sec", "count", day.alias("day"), F.lit(True).alias("own"))
    # a day also needs the last seconds of the day before
    edge = per_second.where(F.pmod("sec", F.lit(86400)) > 86400 - secs).select("sec", "count", (day + 1).alias("day"), F.lit(False).alias("own"))
    w = Window.partitionBy("day").orderBy("sec").rangeBetween(-(secs - 1), 0)
    return own.unionByName(edge).withColumn("rate", F.sum("count").over(w) / secs).where("own").select("sec", "rate")


def sessions(rows: DataFrame, key: str, ts_ms: str, timeout_ms: int) -> DataFrame:
    """key, first_ms, last_ms, n: rows of a key split where the gap reaches the timeout."""
    # blocks of 2 ** 20 ms, some 17 minutes
    made = scan.sessions(rows.where(F.col(ts_ms).isNotNull()), key, ts_ms, timeout_ms, bits=20)
    return made.select(key, F.col("first").alias("first_ms"), F.col("last").alias("last_ms"), "n")
