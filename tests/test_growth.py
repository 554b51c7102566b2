"""Work that stays in proportion to the log: tasks of bounded size, and no more columns than are read."""

import pytest
from pyspark.sql import functions as F

from logscope.functions.parse import parse
from logscope.operators import scan, tables
from logscope.operators.analysis import Analysis, Lines, Options
from logscope.sources import virtual
from logscope.sources.varied import varied_log

LINE = '{{"message":"m","context":{{"status":{},"Status":7}},"level":200,"channel":"Console","extra":{{"token":"t"}}}}'


def lines(spark, *values):
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(values)], "source int, ord long, value string")
    return Lines(parse(rows).where("level is not null"))


def test_events_are_dealt_without_a_sort_over_tasks_of_bounded_size(spark, sf, monkeypatch):
    events = spark.read.parquet(f"{sf}/events.parquet")
    monkeypatch.setattr(virtual, "TASK", 10)
    got = virtual.dealt(events)
    assert got.rdd.getNumPartitions() >= events.count() // 10
    assert "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == events.count() and max(sizes) < 60


@pytest.mark.parametrize("table", [tables.status_classes, tables.levels, tables.channels])
def test_a_table_of_few_columns_types_no_others(spark, table):
    shared = lines(spark, LINE.format(503), LINE.format(200), LINE.format('"204"'), LINE.format("null"))
    a = Analysis(shared, Options(until_ms=1 << 60))
    got = sorted(map(tuple, table(a).collect()))
    assert "typed" not in shared.__dict__
    written = {c for df in shared._narrow.values() for c in df.columns}
    assert written and not written & {"message", "sql", "http", "tokens"}
    # the typed table, once it is there, gives the same
    assert shared.typed.count() == 4 and sorted(map(tuple, table(a).collect())) == got
    if table is tables.status_classes:
        assert got == [(2, 2), (5, 1)]
    shared.close()


def test_empty_json_with_white_space_is_dropped(spark):
    texts = ('[2026-01-01 00:00:00] app.INFO: x { } [\t]', '{"message":"x","level":200,"context":[ ],"extra":{\t}}', '[2026-01-01 00:00:00] app.INFO: x {"a":{}} []')
    got = parse(spark.createDataFrame([(x,) for x in texts], "value string")).select(F.to_json("context").alias("c"), F.to_json("extra").alias("e")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), ('{"a":{}}', None)]


def test_runs_are_dealt_over_the_tasks_that_are_asked_for(spark):
    none = "CAST(NULL AS STRUCT<kind: STRING, name: STRING>) AS own", "CAST(NULL AS STRUCT<name: STRING, exited: BOOLEAN>) AS cmd"
    rows = spark.range(4000).selectExpr("CAST(id % 500 AS STRING) AS token", "id AS ord", "id * 10 AS ts_ms", *none)
    got = scan.runs(rows, 5000, parts=23)
    assert got.groupBy(F.spark_partition_id()).count().count() == 23


SQL = '{{"message":"Executing","context":{{"sql":"SELECT {}"}},"level":200,"channel":"doctrine","extra":{{"token":"t"}}}}'
ERROR = '{"message":"Gone","context":{"request_uri":"/a?b"},"level":400,"channel":"app","extra":{"token":"t"}}'
ASKED = Options(duration_key="duration_ms", correlate_key="token", nplus1=2)


def written(shared):
    return {c for df in shared._narrow.values() for c in df.columns}


def test_a_table_of_runs_types_only_what_it_reads(spark):
    for table, left_out in ((tables.errors, {"sql", "http", "msg", "depr", "status"}), (tables.nplus1, {"message", "context_json", "signature", "depr"})):
        shared, whole = (lines(spark, ERROR, SQL.format(1), SQL.format(1), ERROR) for _ in range(2))
        a = Analysis(shared, ASKED)
        got = sorted(map(str, table(a).collect()))
        assert got and "typed" not in shared.__dict__ and written(shared) and not written(shared) & left_out
        assert whole.typed.count() == 4 and sorted(map(str, table(Analysis(whole, ASKED)).collect())) == got
        a.close(), shared.close(), whole.close()


def test_many_tables_of_one_log_type_it_twice_at_most(spark):
    shared = lines(spark, ERROR, SQL.format(1))
    a = Analysis(shared, ASKED)
    assert tables.totals(a).first()["errors"] == 1 and len(shared._narrow) == 1
    assert [r["count"] for r in tables.errors(a).collect()] == [1]
    assert len(shared._narrow) == 1 and "typed" in shared.__dict__
    a.close(), shared.close()


def test_tables_without_what_they_are_of_runs_cut_no_runs(spark, sf):
    shared = Lines(parse(varied_log(spark.read.parquet(f"{sf}/events.parquet").limit(400))).where("level is not null"))
    assert shared.typed.count() == 400
    a, made = Analysis(shared, ASKED), (tables.commands, tables.cache_keys, tables.messages, tables.outbound)
    short = [table(a, in_runs=False) for table in made]
    got = [sorted(map(str, df.collect())) for df in short]
    assert all(got) and "enriched" not in vars(a)
    assert [sorted(map(str, table(a).select(*df.columns).collect())) for table, df in zip(made, short)] == got
    a.close(), shared.close()


def test_repeated_things_are_typed_and_cut_with_their_own_column(spark, sf):
    log = parse(varied_log(spark.read.parquet(f"{sf}/events.parquet"))).where("level is not null")
    whole = Lines(log)
    assert whole.typed.count() > 0
    asked = Options(duration_key="duration_ms", correlate_key="token", timeout_ms=86_400_000)
    some = 0
    for what, column in (("sql", "sql"), ("call", "http"), ("message", "msg"), ("cache", "cache")):
        shared = Lines(log)
        a, b = Analysis(shared, asked), Analysis(whole, asked)
        shown = ("token", "run_no", "shape", "n", "first_ord", "name", "last_ms")
        got = sorted(map(str, a.repeated(what).select(*shown).collect()))
        assert written(shared) & {"sql", "http", "msg", "cache", "cmd"} == {column} and "enriched" not in vars(a)
        assert got == sorted(map(str, b.run_shapes.where(F.col("what") == what).select(*shown).collect()))
        some += bool(got)
        a.close(), b.close(), shared.close()
    assert some > 1
    whole.close()


@pytest.mark.parametrize("carry", [True, False])
def test_numbers_of_runs_alone_equal_those_of_runs(spark, carry):
    none = "CAST(NULL AS STRUCT<kind: STRING, name: STRING>) AS own", "CAST(NULL AS STRUCT<name: STRING, exited: BOOLEAN>) AS cmd"
    rows = spark.range(3000).selectExpr("CAST(id % 7 AS STRING) AS token", "id AS ord", "id * 10 + id DIV 500 * 9000 AS ts_ms", *none)
    bits = 6 if carry else 20
    numbers = lambda df: sorted(map(tuple, df.select("token", "ord", "run_no").collect()))
    got = numbers(scan.numbered(rows, 5000, bits=bits, carry=carry, parts=5))
    assert got == numbers(scan.runs(rows, 5000, bits=bits, carry=carry, parts=5)) and max(x[2] for x in got) > 3
