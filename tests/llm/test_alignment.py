"""op11 against a brute-force alignment by byte ranges, from the libraries' own ids."""

import hashlib
import random
from collections import Counter

import pytest

from logscope.llm import op11_alignment as op11
from logscope.llm.common import read
from logscope.llm.pieces import byte_letters
from logscope.llm.queries import op11_alignment, tokenizer_path
from tests.llm.test_operators import ODD, frame
from tests.llm.test_pieces import MORE, mixed

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    """Functions from a text to (id, bytes) lists of both sides, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(FILES[0]))
    a.encode_special_tokens = True
    back, b = {v: k for k, v in byte_letters().items()}, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(FILES[1]))

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return lambda t: [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, piece(i)) for i in b.encode(t)]


def brute(texts, sides):
    """The query's columns for each text, with every pair of tokens compared."""
    found, held = [], Counter()
    for t in texts:
        a, b = (f(t) if t else [] for f in sides)
        raw = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            found.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = ";".join("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts))
        links = []
        for i, s, e in spans[0]:
            near = [j for j, x, y in spans[1] if x < e and s < y]
            links += [(i, j) for j in near]
        held.update(set(links))
        found.append((len(a), len(b), len(cuts), links, groups))
    top = Counter()
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = f[3]
        out.append((*f[:3], len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(f[4].encode()).hexdigest()))
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_brute_force(spark, sf, sides):
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    want = dict(zip(docs, brute(docs.values(), sides), strict=True))
    rows = op11_alignment(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id], r.doc_id


@pytest.mark.parametrize(("block", "head"), [(8_000_000, 200_000), (500, 3), (1, 0)])
def test_odd_texts_small_blocks_and_heads(spark, sides, block, head):
    texts = [t if t is None else t[:3000] for t in ODD] + MORE + mixed(120) + ["twice told"] * 3 + ["\x1c!\x1d", "a!\x1cb", "日本語" * 40, "unbelievablyantidisestablishmentarianism" * 9]
    want = brute(texts, sides)
    got = op11.align(frame(spark, texts).repartition(2), *map(tokenizer_path, FILES), block=block, head=head).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id - 1], texts[r.doc_id - 1]


def test_ids_null_and_repeated(spark, sides):
    texts = ["one two", "one two", "three", None]
    docs = spark.createDataFrame([(None, t, "clash") for t in texts], "doc_id long, text string, row string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in op11.align(docs, *map(tokenizer_path, FILES)).collect())
    assert got == sorted(brute(texts, sides))
    assert op11.align(docs.where("false"), *map(tokenizer_path, FILES)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        op11.Both(tokenizer_path("word_bpe_49k.json"), tokenizer_path(FILES[1]))


def test_links_of_a_long_word_stay_linear(spark):
    """A word of many tokens that never end together but at its end."""
    n = 30_000
    block = spark.createDataFrame(
        [(list(range(n)), list(range(n)), [2 * i + 2 for i in range(n)], [2 * i + 1 for i in range(n - 1)] + [2 * n], [2 * n], [(7, 1, n, n, [0, 0])])],
        "a array<int>, b array<int>, a_ends array<int>, b_ends array<int>, word_ends array<int>, docs array<struct<row: bigint, id: bigint, n_a: bigint, n_b: bigint, words: array<int>>>",
    )
    r = op11.aligned(block).first()
    assert (r.n_groups, len(r.links)) == (2, 2 * (2 * n - 1))


def test_each_shape_of_a_block_is_laid_out_once(spark, sides):
    """Lambdas see the different pairs of lengths of words, not each different word."""
    words = [f" {a}{b}" for a in "bcdfghklmnprstvz" for b in ("aja", "uxo", "eqi", "owu")]
    shapes = {tuple(tuple(len(x) for _, x in side(w[1:])) for side in sides) for w in words}
    block = op11.tokenised(frame(spark, ["".join(words)[1:]]).coalesce(1), *map(tokenizer_path, FILES)).first()
    assert len(block["shape"]) == len(words) > len(block["word_ends"]) == len(shapes)


@pytest.mark.parametrize("kept", [0, 40, 10**9])
def test_words_are_remembered_and_forgotten(monkeypatch, sides, kept):
    monkeypatch.setattr(op11, "KEPT", kept)
    code = op11.Both(*map(tokenizer_path, FILES))
    texts = ["one two three", None, "two  two \x1cone", "日本語" * 100 + " three", "", "a▁b one"] + mixed(20) + ["x" * 300 + " two", "one two three"]
    for _ in range(2):
        for t in texts:
            a, b, shape, a_ends, b_ends, word_ends, own, n_a, n_b, words = code.block([t, "one two", t])
            assert sum(map(len, code.number)) == code.held <= kept + sum(len(x or "") + 1 for x in (t, "one two", t))
            want = [[i for i, _ in side(t)] if t and "▁" not in t else [] for side in sides]
            assert [n_a[0], n_b[0], own[2], n_a[2], n_b[2]] == [len(want[0]), len(want[1]), own[0], n_a[0], n_b[0]]
            assert len(shape) == len(set(words.tolist())) and len(word_ends) == len(set(shape.tolist()))
            for ids, ends, ours in ((a, a_ends, want[0]), (b, b_ends, want[1])):
                # tokens of each shape, then of each word
                count = [sum(lo < e <= hi for e in ends) for lo, hi in zip([0, *word_ends], word_ends)]
                at = [0]
                for s in shape:
                    at.append(at[-1] + count[s])
                assert [i for w in words[: own[0]] for i in ids[at[w] : at[w + 1]]] == ours
