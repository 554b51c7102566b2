"""Every log query against its SQL, and the line parser on its own."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from logscope.functions.parse import parse, split_exact
from logscope.operators.assemble import assemble
from logscope.plans import lists, queries, varied
from logscope.sources.text import merge_order, read_lines

QUERIES, ORACLE = {**queries.QUERIES, **lists.QUERIES, **varied.QUERIES}, {**queries.ORACLE, **lists.ORACLE, **varied.ORACLE}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _rows(df: pd.DataFrame) -> list[str]:
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            got = v.tolist() if hasattr(v, "tolist") else v
            return str([cell(x) for x in got]) if isinstance(got, (list, tuple)) else cell(got)
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize(
    "body, message, context, extra",
    [
        ('Text {"a": 1} []', "Text", '{"a": 1}', "[]"),
        ('Text {name} is old {"name": "x"} []', "Text {name} is old", '{"name": "x"}', "[]"),
        ("No JSON [here", "No JSON [here", None, None),
        ('Only {"a": 1}', "Only", '{"a": 1}', None),
        ('Three {"a": 1} [] []', "Three {\"a\": 1}", "[]", "[]"),
    ],
)
def test_body_is_cut_at_the_leftmost_json(spark, body, message, context, extra):
    got = split_exact(body)
    assert (got["message"], got["context"], got["extra"]) == (message, context, extra)
    line = spark.createDataFrame([(f"[2026-01-01T00:00:00+00:00] app.INFO: {body}",)], "value string")
    assert parse(line).first()["message"] == message


def test_lines_that_are_no_entries(spark):
    lines = ["", "  #0 /var/x.php(1)", "[no level] app: x", "[2026-01-01 00:00:00] app.NOPE: x", "{broken", '{"message": "x"}', None]
    got = parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["level"] for r in got] == [None] * len(lines)


def test_continuations_join_their_head(spark):
    lines = ["orphan", "[2026-01-01 00:00:00] app.ERROR: first [] []", "  at a", "  at b", "[2026-01-01 00:00:01] app.INFO: second [] []"]
    rows = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "source int, ord long, value string")
    entries, skipped = assemble(rows)
    assert [r["message"] for r in entries.orderBy("ord").collect()] == ["first\n  at a\n  at b", "second"]
    assert [r["ord"] for r in skipped.collect()] == [0]


def test_plain_files_keep_their_line_numbers(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rstill one\ntwo\n\xff\xfe\nlast")
    got = merge_order(read_lines(spark, [str(tmp_path / "a.log")])).orderBy("ord").collect()
    assert [r["line_no"] for r in got] == [0, 1, 2, 3]
    assert [r["value"] for r in got] == ["one\rstill one", "two", "��", "last"]
