"""Each operator against a brute-force version, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logscope.llm import op1_toxicity as op1
from logscope.llm import op2_decontamination as op2
from logscope.llm import op3_language as op3
from logscope.llm import op4_mixing as op4
from logscope.llm import op5_pii as op5
from logscope.llm import op6_rans as op6
from logscope.llm import op7_wrappers as op7
from logscope.llm import op8_near_dup as op8
from logscope.llm import op10_top_k as op10
from logscope.llm.common import read
from logscope.llm.op9_token_counts import token_counts
from logscope.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size string, id string"
ODD = [None, "", " \t\n", "word", "Straße 😀 ünï  x y", "<|endoftext|> a<|startoftext|>b", "x" * 20_000, "a b c d e " * 4_000]


def frame(spark, texts, source="s"):
    """Documents with ids from 1, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i + 1, t, "en", source, "clash", "clash") for i, t in enumerate(texts)], DOCS)


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


# 8


def brute_groups(rows):
    """component_id per (id, text) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_all_pairs(spark):
    rng, texts = random.Random(5), list(ODD)
    for _ in range(25):
        base = words(rng, rng.choice([3, 6, 40, 200]))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 30)):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(rng.choice([" ", "\n"]).join(copy))
        texts.append(" ".join(base).upper())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in op8.near_duplicates(frame(spark, texts)).collect()}
    want = {i: (n, c, i == c) for i, (n, c) in brute_groups(list(enumerate(texts, 1))).items()}
    assert got == want


def test_near_duplicates_of_nothing(spark):
    assert op8.near_duplicates(frame(spark, ["x"]).limit(0)).collect() == []


# 9 and 6


@pytest.fixture(scope="module")
def encoded(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = [(r["doc_id"], r["text"]) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    rows += [(10_000_000 + k, x) for k, x in enumerate(ODD)]
    return sorted((i, x, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows)


def with_odd(spark, sf):
    odd = spark.createDataFrame([(10_000_000 + k, x) for k, x in enumerate(ODD)], "doc_id long, text string")
    return read(spark, sf, "documents").select("doc_id", "text").unionByName(odd).selectExpr("*", "1 AS id", "'x' AS n_tokens")


def test_token_counts_equal_the_library(spark, sf, encoded):
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts(with_odd(spark, sf), tokenizer_path()).collect()}
    assert got == {i: (len((x or "").encode()), len(ids), len(ids) > 2048) for i, x, ids in encoded}


def test_blocks_round_trip(spark, sf, encoded):
    got = sorted(tuple(r) for r in op6.read_blocks(*op6.write_blocks(with_odd(spark, sf), tokenizer_path())).collect())
    want, start = [], 0
    for i, _, ids in encoded:
        ids = np.array([*ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_tokens_of_nothing(spark):
    none = frame(spark, ["x"]).limit(0)
    assert token_counts(none, tokenizer_path()).collect() == []
    assert op6.read_blocks(*op6.write_blocks(none, tokenizer_path())).collect() == []


# 10


def test_top_k_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in read(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    rows += [(10**6 + k, rows[0][1]) for k in range(50)] + [(2 * 10**6, None), (2 * 10**6 + 20, [float("nan")] * len(rows[0][1])), (2 * 10**6 + 40, [None] * len(rows[0][1]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS key")
    fine = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, x in fine:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in fine if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in op10.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == want
    assert op10.top_k(df.limit(0)).collect() == []


# 5


def plain_spans(text):
    """The fixed patterns, word for word."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], op5.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns(spark, sf):
    tricky = ["a@b.c@d.e", "@@x.y a..b@c-d.ef-.gh", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256", "4111 1111-1111 1111 x 4111111111111111", "+1 (202) 555-0100. +12", "+1.2.3.4.5.6.7.8.9.0", "é😀 a@b.co", "1" * 30_000, "a" * 3_000 + "@" + "b." * 3_000]
    rng = random.Random(1)
    tricky += ["".join(rng.choice("01299. -+@ab()") for _ in range(300)) for _ in range(100)]
    docs = frame(spark, [*ODD, *tricky]).select("doc_id", "text")
    docs = docs.unionByName(read(spark, sf, "documents").selectExpr("doc_id + 100000 AS doc_id", "text"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = op5.find(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        base = [f"{k}:{s}:{e}" for k, s, e in plain_spans(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r["doc_id"]][:200]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(base) <= set(every)
        kinds = Counter(s.split(":")[0] for s in every)
        assert [r[f"n_{k}"] for k in op5.KINDS] == [kinds[k] for k in op5.KINDS]


def test_context_finds_unseen_identifiers(spark):
    texts = [f"please call number +1 202 555 01{k:02d} today" for k in range(30)] + ["please call number 555-0199x today"]
    assert op5.find(frame(spark, ["nothing"]).limit(0)).collect() == []
    assert sum(r["n_phone"] for r in op5.find(frame(spark, texts)).collect()) >= 30


# 4


def test_mix_comes_near_its_targets(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "source").unionByName(frame(spark, [None, "", "one two"], None).select("doc_id", "text", "source").selectExpr("-doc_id AS doc_id", "text", "source"))
    rows = op4.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, op4.mix(docs.repartition(3)).collect()))
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, want, openly = 1.5 * sum(sizes.values()), {}, list(order)
    while openly:
        level = left / sum(weight[s] for s in openly)
        over = [s for s in openly if weight[s] * level > 2 * sizes[s]]
        if not over:
            want |= {s: weight[s] * level for s in openly}
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
            left -= want[s]
            openly.remove(s)
    assert target == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert op4.mix(docs.limit(0)).collect() == []


# 2


def test_reordered_passages_are_caught(spark):
    rng = random.Random(3)
    item = words(rng, 60, 10**6)
    moved = words(rng, 50, 10**6) + item[30:] + words(rng, 9, 10**6) + item[:30]
    few = words(rng, 50, 10**6) + item[:20] + words(rng, 50, 10**6)
    texts = [" ".join(x) for x in (item, moved, few, words(rng, 300, 10**6))] + ODD
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (7, " ".join(item))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in op2.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(1, 7, 60), (2, 7, 60)}
    left = op2.decontaminate(frame(spark, texts), bench)
    assert left.columns == frame(spark, texts).columns
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(3, len(texts) + 1))
    assert op2.contaminated(frame(spark, texts), bench.limit(0)).collect() == []


def greedy(doc, item, least):
    """Words that tiles cover, by looking at every place: the longest first, then the first of
    the item, then of the document."""
    used_d, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in used_d and b + n not in used_i:
                    n += 1
                best = max(best, (n, -b, -a))
        if best[0] < least:
            return total
        n, b, a = best[0], -best[1], -best[2]
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))
        total += n


def test_tiles_cover_what_greedy_tiling_covers():
    rng = random.Random(8)
    for _ in range(40):
        doc, item = (np.array([rng.randrange(4) for _ in range(n)], np.int64) for n in (40, 25))
        tiles = op2.tile(doc, item, 3)
        for a, b, n in tiles:
            assert n >= 3 and (doc[a : a + n] == item[b : b + n]).all()
        for side in (0, 1):
            at = [x for t in tiles for x in range(t[side], t[side] + t[2])]
            assert len(at) == len(set(at))
        if tiles:
            longest = max(t[2] for t in tiles)
            assert longest == max(n for a in range(40) for b in range(25) for n in [next((k for k in range(26) if a + k >= 40 or b + k >= 25 or doc[a + k] != item[b + k]), 0)])
        assert sum(t[2] for t in tiles) == greedy(doc.tolist(), item.tolist(), 3)


# 7


def page(body, title="T"):
    return f"<html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><nav><a href=/>Menu</a></nav><div class='cookie-notice'>Notice</div><article><h1>{title}</h1>{body}</article><section class=comments><p>Comment</p></section><footer>Footer</footer></body></html>"


def test_main_text_of_pages(spark):
    bodies = [f"<p>First &amp;  {k}\n line</p>" + "<p>More <b>bold</b>text</p>" * (k % 3) + "<ul><li>one</li><li>two</li></ul>" * (k % 2) for k in range(12)]
    rows = [(k, "http://a.test/x", page(b, f"Title {k}")) for k, b in enumerate(bodies)] + [(90, None, None), (91, "http://a.test/y", "")]
    got = {r["page_id"]: r for r in op7.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        want = [f"Title {k}", f"First & {k} line", *["More boldtext"] * (k % 3), *(["one", "two"] if k % 2 else [])]
        assert got[k]["text"] == "\n".join(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[90]["text"] == got[91]["text"] == ""


# 1


def test_chain_is_right_on_held_out_documents(spark):
    rng = random.Random(2)
    texts, bad = [], []
    for k in range(900):
        bad.append(k % 4 == 0)
        texts.append(" ".join(words(rng, 60) + ([rng.choice(["vilest", "scumbag", "loathe"]) for _ in range(4)] if bad[-1] else [])))
    docs = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i + 1, int(i % 3 == 0), int(b)) for i, b in enumerate(bad[:600])] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    labels = labels.where("doc_id IS NULL OR doc_id != 5 OR quality IS NOT NULL")
    chain = op1.fit_chain(docs, labels, op1.label_categories())
    got = {r["doc_id"]: r["toxic"] for r in op1.score(docs, chain).collect()}
    assert len(got) == len(texts) + len(ODD)
    assert np.mean([got[i + 1] == bad[i] for i in range(600, 900)]) > 0.97
    kept = {r["doc_id"] for r in op1.reject(docs, chain).collect()}
    assert kept == {i for i, hit in got.items() if not hit}
    none = op1.fit_chain(docs, labels.limit(0), op1.label_categories())
    assert not any(r["toxic"] for r in op1.score(docs, none).collect())


# 3


def test_language_of_labelled_documents(spark, sf):
    docs = read(spark, sf, "documents")
    found = op3.identify(docs, read(spark, sf, "pages"), op3.fit_letters(docs))
    lang = {r["doc_id"]: r["lang"] for r in docs.where("lang IS NOT NULL AND length(text) > 200").collect()}
    got = {r["id"]: r["lang"] for r in found.where("kind = 'document'").collect()}
    assert np.mean([got[i] == x for i, x in lang.items()]) > 0.9
