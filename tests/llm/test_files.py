"""Token blocks read from their files, deep pages, and secrets found by their contexts."""

import zlib

import numpy as np
import pytest

from logscope.llm import op5_pii as op5
from logscope.llm import op6_rans as op6
from logscope.llm import op7_wrappers as op7
from logscope.llm.queries import tokenizer_path


def test_every_checkpoint_decodes_its_stretch():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 700_000).clip(max=999).astype(np.uint32)
    t = op6.Table(op6.frequencies(np.bincount(ids, minlength=1000)))
    blob = op6.pack([1], [len(ids)], ids, t)
    block = op6.Block(blob, t)
    span = op6.CHECK_STEPS * block.lanes
    assert len(block.at) > 2
    for k in range(len(block.at)):
        assert (block.ids(k, k + 1) == ids[k * span : (k + 1) * span]).all()
    with pytest.raises(ValueError):
        op6.Block(blob[:100] + bytes([blob[100] ^ 1]) + blob[101:], t)
    with pytest.raises(ValueError):
        op6.Block(blob, op6.Table(op6.frequencies(np.ones(1000, np.int64))))


def test_ranges_are_read_from_the_stored_tables(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more text " * (i % 40)) for i in range(200)], "doc_id long, text string")
    blocks, stored = op6.write_blocks(docs, tokenizer_path())
    whole = {r["at"]: r["id"] for r in op6.read_range(blocks, stored, 0, 1 << 40).collect()}
    ids = np.array([whole[k] for k in range(len(whole))], "<u4")
    for r in op6.read_blocks(blocks, stored).collect():
        assert zlib.crc32(ids[r["start"] : r["start"] + r["n_tokens"]].tobytes()) == r["ids_crc32"]
    assert {r["at"]: r["id"] for r in op6.read_range(blocks, stored, 50, 777).collect()} == {k: whole[k] for k in range(50, 777)}
    with pytest.raises(ValueError):
        op6.stored_table(stored.where("token > 0"))


def test_deep_pages_are_read_whole(spark):
    deep = "<article><p>first</p>" + "<div>" * 20_000 + "inside<nav>menu</nav>tail" + "</div>" * 20_000 + "<p>last</p></article>"
    rows = [(1, "http://a.test/x", deep), (2, None, None), (3, "http://a.test/x", deep)]
    got = {r["page_id"]: r["text"] for r in op7.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "first\ninside\ntail\nlast", 2: "", 3: "first\ninside\ntail\nlast"}


def test_contexts_of_secrets_find_others(spark):
    digits = "0123456789abcdef"
    value = lambda k: "".join(digits[(k * 7 + j * (j + k)) % 16] for j in range(40)) + "a1"
    texts = [f'deploy with api_key = "{value(k)}" now' for k in range(20)] + [f"deploy with api_key {value(99)} now", "an ordinary sentence about the year 2024", None, ""]
    got = op5.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_secret"] for r in got] == [1] * 21 + [0] * 3
    start = texts[20].index(value(99))
    assert got[20]["spans"] == f"secret:{start}:{start + 42}" and got[20]["base_sha256"] == got[23]["base_sha256"]
