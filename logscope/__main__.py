"""``python -m logscope FILE...``: a report of log files, and a verdict by its exit code."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from logscope.operators.analysis import Analysis, Options
from logscope.operators.assemble import assemble
from logscope.operators.ceilings import Ceiled
from logscope.plans import report
from logscope.plans.bounds import conflicts, parse_bound, read_from_start
from logscope.plans.thresholds import parse_threshold, verdict
from logscope.sources.store import drop_all
from logscope.sources.text import discard, is_pipe, merge_order, read_lines, spooled, unreadable
from logscope.streaming.live import reports


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logscope")
    p.add_argument("files", nargs="+", help="log files; - is standard input")
    shown = p.add_mutually_exclusive_group()
    shown.add_argument("--json", action="store_true")
    shown.add_argument("--summary", action="store_true")
    shown.add_argument("--item", nargs=2, metavar=("LIST", "NAME"))
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("-n", "--lines", type=int)
    p.add_argument("--top", type=int, default=25)
    p.add_argument("--nplus1", type=int, default=10)
    p.add_argument("--fail-if", action="append", default=[])
    p.add_argument("--duration-key")
    p.add_argument("--duration-unit", default="auto", choices=("auto", "ms", "s", "us"))
    p.add_argument("--correlate-key")
    p.add_argument("--save", metavar="DIR", help="write the item's report there instead, under a name of its own")
    p.add_argument("--follow", action="store_true", help="a JSON report a line, of files that grow, until interrupted")
    p.add_argument("--every", type=float, default=10, help="seconds between reports of followed files")
    p.add_argument("-a", "--all", action="store_true", help="followed files are read from their start")
    p.add_argument("--ceilings", action="store_true", help="detail the first keys of each table only")
    p.add_argument("--no-correlate", action="store_true")
    p.add_argument("--correlate-timeout", type=int, default=5000, help="ms")
    return p


def _drained(spark: SparkSession, pipe: str) -> str:
    with open(pipe, "rb") as f:
        return spooled(spark, f)


def saved(folder: str, name: str, text: str) -> str:
    """Where the report was written."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}.md")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def _followed(spark: SparkSession, o: argparse.Namespace, options: Options, launched: datetime, out, ticks: int | None) -> int:
    latest = not read_from_start(True, o.lines, o.all, o.since)
    try:
        for document in reports(o.files, options, spark, launched, o.every, latest, ticks):
            out.write(report.render_json(document, pretty=False) + "\n")
            out.flush()
    except (BrokenPipeError, KeyboardInterrupt):
        pass
    return report.OK


def run(spark: SparkSession, argv: list[str], out=None, err=None, ticks: int | None = None) -> int:
    """The report, or ``ticks`` of them where files are followed; 0, or 1 where a source could not be read, 2 for the command line, 3 for a breach."""
    out, err = out or sys.stdout, err or sys.stderr
    o, launched = arguments().parse_args(argv), datetime.now().astimezone()
    try:
        bounds = [None if b is None else parse_bound(b, launched) for b in (o.since, o.until)]
        for text in o.fail_if:
            parse_threshold(text)
        if why := conflicts(o.fail_if, o.follow, o.nplus1):
            raise ValueError("; ".join(why))
    except ValueError as e:
        print(e, file=err)
        return report.USAGE
    options = Options(since_ms=bounds[0], until_ms=bounds[1], duration_key=o.duration_key, duration_unit=o.duration_unit, correlate=not o.no_correlate, correlate_key=o.correlate_key, timeout_ms=o.correlate_timeout, nplus1=o.nplus1, top=o.top)
    if o.follow:
        return _followed(spark, o, options, launched, out, ticks)
    spools = {k: spooled(spark, sys.stdin.buffer) if f == "-" else _drained(spark, f) for k, f in enumerate(o.files) if f == "-" or is_pipe(f)}
    paths = [spools.get(k, f) for k, f in enumerate(o.files)]
    missing = unreadable(spark, paths)
    for path in missing:
        print(f"{path}: can't be read", file=err)
    readable = [p for p in paths if p not in missing]
    if not readable:
        return report.UNREADABLE
    entries, skipped = assemble(merge_order(read_lines(spark, readable, o.lines)))
    a = Analysis(entries, options, int(launched.timestamp() * 1000))
    if o.ceilings:
        a = Ceiled(a)
    try:
        if o.item:
            text = report.item_report(a, *o.item, o.files, launched)
            if o.save:
                text = saved(o.save, report.slug(*o.item, launched), text) + "\n"
        else:
            document = report.snapshot(a, skipped.count(), launched)
            text = report.render_json(document) + "\n" if o.json else report.render_summary(document, launched.tzinfo)
        breaches = verdict(a, o.fail_if) if o.fail_if else []
    finally:
        a.close()
        for path in spools.values():
            discard(spark, path)
    try:
        out.write(text)
        out.flush()
    except BrokenPipeError:  # who reads has seen enough (K04)
        pass
    for line in breaches:
        print(line, file=err)
    return report.exit_code(missing, breaches)


def main() -> int:
    spark = SparkSession.builder.appName("logscope").getOrCreate()
    try:
        return run(spark, sys.argv[1:])
    finally:
        drop_all(spark)
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
