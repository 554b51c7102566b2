"""The column parser against the exact splitter, on generated bodies."""

import json
import random

from logscope.functions.parse import parse, split_exact

PIECES = ['{"a":1}', "[]", "{}", '{"b":"x} {y"}', '{"c":"] ["}', "[1,2]", "] bar", "} x", "{name}", "[here", "text", '{"d":{"e":[1, {"f":null}]}}', '{"a":1,"a":2}', '{"u":"\\ud800"}', '{"n":1e999}', "5", '"s"', "null", '{"q":"\\"}"}', ",0]", "é"]


def bodies(n: int) -> list[str]:
    draw = random.Random(5)
    some = [draw.choice([" ", "  ", ""]).join(draw.choice(PIECES) for _ in range(draw.randint(1, 5))) for _ in range(n)]
    return ["foo {\"a\":1}] bar", "foo {\"a\":1},0] junk", *some]


def canonical(text):
    got = None if text is None else json.loads(text)
    return None if got in ({}, [], None) else json.dumps(got, sort_keys=True)


def test_parse_equals_the_exact_splitter(spark):
    rows = [(i, f"[2026-01-01T00:00:00+00:00] app.INFO: {b}") for i, b in enumerate(bodies(600))]
    got = parse(spark.createDataFrame(rows, "i long, value string")).selectExpr("i", "message", "to_json(context) AS context", "to_json(extra) AS extra").collect()
    for r in got:
        want = split_exact(bodies(600)[r["i"]].lstrip(" "))
        assert (r["message"], canonical(r["context"]), canonical(r["extra"])) == (want["message"], canonical(want["context"]), canonical(want["extra"])), rows[r["i"]]


def test_json_lines_need_one_whole_object(spark):
    lines = ['{"level":200,"message":"a","level_name":"ERROR"}', '{"level":250} x', '{"level":200,"level":300}', '{"level":200.0}', '  {"level_name":"ALERT","channel":7,"extra":[1]}\r']
    got = parse(spark.createDataFrame(list(enumerate(lines)), "i long, value string")).orderBy("i").collect()
    assert [(r["level"], r["channel"], r["message"]) for r in got] == [(4, "app", "a"), (None, None, None), (3, "app", ""), (None, None, None), (6, "app", "")]
