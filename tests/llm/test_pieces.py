"""op12: ids and texts against the sentencepiece library."""

import hashlib
import random

import pytest

from logscope.llm import op12_pieces as op12
from logscope.llm.common import read
from logscope.llm.queries import op12_pieces, tokenizer_path
from tests.llm.test_operators import ODD, frame

MODEL = "piece_bpe_32k.model"
MORE = ["▁", "a▁ ▁ b", "a\rb;\r x;\r\n y\r", "\n\n a\t b", "\x1c\x1d a", "<s> </s> <unk> <0x41>", "日本語 テキスト", " " * 300, "é" * 700, "\x00"]


@pytest.fixture(scope="module")
def code():
    return op12.agenda(tokenizer_path(MODEL))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def mixed(n):
    rng = random.Random(12)
    return ["".join(rng.choice(" \n\r;)\t▁aeinrstheABé日😀.,1 ") for _ in range(rng.choice([3, 10, 23, 40, 200]))) for _ in range(n)]


def test_agenda_equals_library_without_cuts(code):
    for t in mixed(800) + MORE:
        whole = code.escaped(t)
        assert list(code.ids(whole)) == code.lib.encode(t), t
        # the two forms of the agenda form the same symbols
        assert code._short(whole[:200]) == code._long(whole[:200])


def test_ties_go_to_the_left(code):
    assert code.merge("aaaaaaa") == code._long("aaaaaaa") == code._short("aaaaaaa")
    assert list(code.ids("▁" + "a" * 5000)) == code.lib.encode("a" * 5000)


def test_round_trip_equals_library(spark, code):
    texts = ODD + MORE + mixed(300)
    rows = op12.round_trip(frame(spark, texts), tokenizer_path(MODEL)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = code.lib.encode(texts[r.doc_id - 1] or "") + [code.end]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agreed) == (len(ids), sha(" ".join(map(str, ids))), sha(code.lib.decode(ids)), True)


def test_query_equals_library_on_whole_table(spark, sf, code):
    rows = op12_pieces(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = code.lib.encode(texts[r.doc_id]) + [code.end]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(code.lib.decode(ids)))


def test_encode_then_decode(spark, code):
    texts = ["ab c", "ab c", None, "", "x▁y"]
    docs = spark.createDataFrame([(None if i == 1 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = op12.encode(docs, tokenizer_path(MODEL), end=False)
    assert sorted((r.doc_id or 0, tuple(r.ids)) for r in coded.collect()) == sorted((0 if i == 1 else i, tuple(code.lib.encode(t or ""))) for i, t in enumerate(texts))
    back = op12.decode(coded, tokenizer_path(MODEL))
    assert sorted(r.text for r in back.collect()) == sorted(["ab c", "ab c", "", "", "x y"])
    # ids that are no UTF-8, and the unknown id, as the library reads them
    odd = spark.createDataFrame([(1, [code.byte[0xFF], 0, code.byte[0xE3]]), (2, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in op12.decode(odd, tokenizer_path(MODEL)).collect()}
    assert got == {1: code.lib.decode([code.byte[0xFF], 0, code.byte[0xE3]]), 2: None}
    none = docs.where("false")
    assert op12.encode(none, tokenizer_path(MODEL)).count() == op12.round_trip(none, tokenizer_path(MODEL)).count() == 0


def test_disagreement_takes_the_library(code):
    code = op12.Agenda(tokenizer_path(MODEL))
    code.ids, right = (lambda w: (5,) if w == "▁odd" else op12.Agenda.ids(code, w)), code.lib.encode("an odd word")
    got = list(code.encode_batch(["an odd word", "fine"]))
    assert got == [(right, False), (code.lib.encode("fine"), True)]


def test_other_models_are_refused(code, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(code.lib.serialized_model_proto())
    model.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        op12.Agenda(str(tmp_path / "unigram.model"))
