"""Thresholds (H01-H14): a one-line grammar, and a verdict with its population rule."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.operators import tables
from logscope.operators.analysis import RUNS, Analysis

# The metrics by unit, and those that may name an endpoint or command.
DURATIONS = ("p50", "p95", "p99", "max", "http-client-p50", "http-client-p95", "http-client-p99", "http-client-max")
RATES = ("error-rate", "request-error-rate", "5xx-rate")
COUNTS = ("errors", "deprecations", "entries", "nplus1", "commands-failed", "messages-waiting", "messages-failed")
#: A number as floats are written.
FLOAT = r"(?i:[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf(?:inity)?|nan))"
NAMED = ("p50", "p95", "p99", "max", "5xx-rate", "nplus1", "commands-failed")


@dataclass(frozen=True)
class Threshold:
    text: str
    metric: str
    name: str | None
    symbol: str
    value: float

    def crossed(self, measured: float) -> bool:
        return {">": measured > self.value, ">=": measured >= self.value, "<": measured < self.value, "<=": measured <= self.value}[self.symbol]

    def shown(self, value: float) -> str:
        if self.metric in RATES:
            return f"{value * 100:.2f}%"
        if self.metric in DURATIONS:
            return f"{value:.0f}ms"
        return f"{value:.0f}"

    def breach(self, measured: float, culprit: str | None) -> str:
        who = self.name or culprit
        return f"{self.metric}{f' ({who})' if who else ''} = {self.shown(measured)} {self.symbol} {self.shown(self.value)}"


def parse_threshold(text: str) -> Threshold:
    """``metric[:name] cmp value[unit]``; ValueError if it is malformed."""
    for symbol in (">=", "<=", ">", "<"):
        if symbol in text:
            left, _, right = text.partition(symbol)
            break
    else:
        raise ValueError(f"{text}: no comparator")
    metric, named, name = left.strip().partition(":")
    metric, name = metric.strip(), name.strip() if named else None
    if metric not in (*DURATIONS, *RATES, *COUNTS):
        raise ValueError(f"{text}: unknown metric {metric}")
    if named and (metric not in NAMED or not name):
        raise ValueError(f"{text}: {metric} takes no name")
    m = re.fullmatch(rf"\s*({FLOAT})\s*(%|ms|s)?\s*", right, re.ASCII)
    if not m:
        raise ValueError(f"{text}: bad value")
    value, unit = float(m[1]), m[2]
    if (unit == "%" and metric not in RATES) or (unit in ("ms", "s") and metric not in DURATIONS):
        raise ValueError(f"{text}: wrong unit")
    return Threshold(text, metric, name, symbol, value / 100 if unit == "%" else value * 1000 if unit == "s" else value)


class Tables:
    """The tables that thresholds look into, each made once however many ask for it."""

    def __init__(self, a: Analysis):
        self.a, self._made = a.over(*RUNS, *tables.SCALARS), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            # no threshold is on what these are of runs
            lines = {"in_runs": False} if name in ("outbound", "commands", "messages") else {}
            self._made[name] = self.a.keep(getattr(tables, name)(self.a, **lines))
        return self._made[name]


def _measure(a: Analysis, made: Tables, t: Threshold) -> DataFrame:
    """measured, culprit: one row at most, none (or null) where there is no population."""
    none = F.lit(None).cast("string").alias("culprit")
    one = lambda df, c: df.select(c.cast("double").alias("measured"), none)
    total, metric = made.totals, t.metric
    if metric in ("p50", "p95", "p99", "max"):
        e, column = made.endpoints, "max_ms" if metric == "max" else metric
        if t.name:
            return one(e.where(F.col("endpoint") == t.name), F.coalesce(column, F.lit(0.0)))
        return e.where("timed > 0").orderBy(F.desc(column), "endpoint").limit(1).select(F.col(column).cast("double").alias("measured"), F.col("endpoint").alias("culprit"))
    if metric.startswith("http-client-"):
        column = metric.removeprefix("http-client-").replace("max", "max_ms")
        return made.outbound.where("timed > 0").orderBy(F.desc(column), "shape").limit(1).select(F.col(column).cast("double").alias("measured"), F.col("shape").alias("culprit"))
    if metric == "5xx-rate" and t.name:
        return one(made.endpoints.where(F.col("endpoint") == t.name), F.col("rate_5xx"))
    if metric == "nplus1":
        found = made.nplus1
        if t.name:
            known = made.endpoints.where(F.col("endpoint") == t.name).select(F.col("endpoint").alias("subject"))
            return one(known.join(found.groupBy("subject").count(), "subject", "left"), F.coalesce("count", F.lit(0)))
        any_sql = total.where("statements > 0").withColumn("k", F.lit(1))
        return one(any_sql.select("k").join(found.agg(F.count("*").alias("n")).withColumn("k", F.lit(1)), "k"), F.col("n"))
    if metric == "commands-failed":
        c = made.commands
        c = c.where(F.col("name") == t.name) if t.name else c
        return one(c.agg(F.sum("failed").alias("n")), F.col("n"))
    if metric in ("messages-waiting", "messages-failed"):
        seen = total.where("messenger_lines > 0").withColumn("k", F.lit(1))
        return one(seen.select("k").join(made.message_totals.withColumn("k", F.lit(1)), "k"), F.col(metric.removeprefix("messages-")))
    scalar = {"error-rate": F.when(F.col("entries") > 0, F.col("error_rate")), "request-error-rate": F.col("request_error_rate"), "5xx-rate": F.col("rate_5xx"), "errors": F.col("errors"), "deprecations": F.col("deprecations"), "entries": F.col("entries")}
    return one(total, scalar[metric])


def evaluate(a: Analysis, texts: list[str]) -> DataFrame:
    """threshold, measured, culprit, breached; no population is no row."""
    out, made = None, Tables(a)
    for text in texts:
        t = parse_threshold(text)
        m = F.col("measured")
        crossed = {">": m > t.value, ">=": m >= t.value, "<": m < t.value, "<=": m <= t.value}[t.symbol]
        row = _measure(a, made, t).where("measured is not null").select(F.lit(text).alias("threshold"), "measured", "culprit", crossed.alias("breached"))
        out = row if out is None else out.unionByName(row)
    return out


def verdict(a: Analysis, texts: list[str]) -> list[str]:
    """Texts of the crossed thresholds."""
    rows = evaluate(a, texts).where("breached").collect()
    return [parse_threshold(r.threshold).breach(r.measured, r.culprit) for r in rows]
