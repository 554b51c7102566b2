"""Log-linear histogram quantiles with a relative error of at most 1.6 %."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices an octave, lowest exponent, last bucket.
SLICES, LOWEST, LAST = 32, -4, 671


def bucket(ms: Column) -> Column:
    """Bucket of a duration; 32 to each doubling from 1/16 ms."""
    x = ms.cast("float").cast("double")
    e = F.floor(F.log2(x))
    e = F.when(F.pow(F.lit(2.0), e + 1) <= x, e + 1).when(F.pow(F.lit(2.0), e) > x, e - 1).otherwise(e)
    at = (e - LOWEST) * SLICES + F.floor((x / F.pow(F.lit(2.0), e) - 1) * SLICES)
    return F.when((x <= 0) | x.isNull() | ~(x < float("inf")) | (e < LOWEST), F.lit(0)).otherwise(F.least(F.lit(LAST), at)).cast("int")


def middle(at: Column) -> Column:
    return (1 + (at % SLICES + 0.5) / SLICES) * F.pow(F.lit(2.0), F.floor(at / SLICES) + LOWEST)


def quantiles(timed: DataFrame, keys: list[str], ms: str = "ms", of: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """keys, p50, p95, p99: two hash aggregates, and running counts over at most 672 rows a key."""
    return of_counts(timed.groupBy(*keys, bucket(F.col(ms)).alias("_b")).agg(F.count("*").alias("_n")), keys, of)


def of_counts(counts: DataFrame, keys: list[str], of: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The same from counts ``_n`` per keys and bucket ``_b``."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_cum", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    firsts = [F.min(F.when(F.col("_cum") > F.round((F.col("_all") - 1) * p), F.col("_b"))).alias(f"_q{k}") for k, p in enumerate(of)]
    return run.groupBy(*keys).agg(*firsts).select(*keys, *(middle(F.col(f"_q{k}")).alias(f"p{round(p * 100)}") for k, p in enumerate(of)))
