"""Operators on rows that repeat."""

import random

import numpy as np

from logscope.llm import op5_pii as op5
from logscope.llm import op10_top_k as op10


def test_top_k_with_repeated_query_rows(spark):
    rng = random.Random(4)
    vec = lambda: [rng.randrange(-3, 4) / 4 for _ in range(6)]
    rows = [(k, vec()) for k in range(1, 240)]
    rows += [rows[19]] * 2 + [rows[39]] * 30 + [rows[44]] * 3  # queries 20 and 40, and row 45, repeated
    rows += [(60, vec()) for _ in range(50)]  # one query on many vectors
    rows += [(80, rows[99][1])] * 4 + [(k, rows[79][1]) for k in (-20, -1, 300, 301)]
    rows += [(i, v) for _, v in rows[120:150] for i in (100, rng.randrange(400, 440))]
    rows += [(None, rows[19][1]), (None, vec()), (None, vec())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    fine = [(op10.NO_ID if i is None else i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows]
    got = {}
    for r in op10.top_k(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    want = {}
    for q in {i for i, _ in fine if i % 20 == 0 and i != op10.NO_ID}:
        asked = {tuple(v) for i, v in fine if i == q}
        best = sorted((-int(np.array(x) @ v), i) for x in asked for i, v in fine if i != q)[:20]
        want[q] = [(n, s, None if i == op10.NO_ID else i) for n, (s, i) in enumerate(best, 1)]
    assert got == want


def test_context_finds_spaced_and_plain_identifiers(spark):
    seeds = [form.format(f"+1 202 555 {k:04d}") for k in range(30) for form in ("please call number {} today", "{} is my phone", "Tel : {}", "- {} rings\nnext line")]
    unseen = ["please call number (202) 555-0100 today", "please call number 202 555 - 0101 today", "please call number 0199 today", "555-0177x is my phone", "Tel : 555-0199", "- 20/2 555 rings\n7 lines", "please call number " + "9" * 300 + " today"]
    clean = [f"chapter {k} has 12 pages and 4 tables" for k in range(40)]
    texts = [*seeds, *unseen, *clean]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r["doc_id"]]: r for r in op5.find(df).collect()}
    want = ["(202) 555-0100", "202 555 - 0101", "0199", "555-0177x", "555-0199", "20/2 555", "9" * 300]
    for t, w in zip(unseen, want, strict=True):
        assert f"phone:{t.index(w)}:{t.index(w) + len(w)}" in got[t]["spans"].split(","), (t, got[t]["spans"])
    assert all(got[t]["n_added"] == 0 for t in (*seeds, *clean) if "next line" not in t)
