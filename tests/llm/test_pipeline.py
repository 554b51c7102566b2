"""The stages of the pipeline on rows whose ids are null or shared."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from logscope.llm import op1_toxicity as op1
from logscope.llm import op4_mixing as op4
from logscope.llm.common import read
from logscope.llm.queries import tokenizer_path
from tests.llm.test_operators import brute_groups, greedy, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf):
    rng = random.Random(11)
    text = [" ".join(words(rng, 60, 10**6)) for _ in range(12)]
    rows = [(None, text[k], "s") for k in range(5)]  # unrelated, without ids
    rows += [(7, text[5], "s"), (7, text[6], "s"), (7, text[5] + " end", "s")]  # one id, two texts, a copy
    rows += [(3, text[7], "s"), (9, text[7], "s"), (9, text[8], "s")]  # id 9 is a copy once and itself once
    rows += [(None, text[9], "s"), (4, text[9] + " end", "s"), (None, text[10], "s"), (None, text[10], "s"), (None, "", "s"), (None, None, "s")]
    out = pipeline.near_dedup(spark, rows_of(spark, rows), sf)
    assert out.columns == rows_of(spark, rows).columns
    got = Counter((r["doc_id"], (r["text"] or "").removesuffix(" end")) for r in out.collect())
    want = [(None, text[k]) for k in range(5)] + [(7, text[5]), (7, text[6]), (3, text[7]), (9, text[8]), (4, text[9]), (None, text[10]), (None, ""), (None, "")]
    assert got == Counter(want)


def test_each_row_is_repeated_as_the_mix_takes_it(spark, sf):
    rng = random.Random(12)
    rows = [(rng.choice([None, 1, k]), f"t{k} " + " ".join(words(rng, rng.randrange(1, 40))), rng.choice(["a", "b", "c", None])) for k in range(300)]
    docs = pipeline.keyed(rows_of(spark, rows))
    copies = {r[pipeline.ROW]: r["copies"] for r in op4.mix(docs, row_col=pipeline.ROW).collect()}
    want = Counter({r["text"]: copies[r[pipeline.ROW]] for r in docs.collect() if copies[r[pipeline.ROW]]})
    out = pipeline.mixing(spark, docs.drop(pipeline.ROW), sf)
    assert out.columns == rows_of(spark, rows).columns
    taken, rest = Counter(r["text"] for r in out.collect()), op4.mix(docs.drop(pipeline.ROW))
    assert sum(taken.values()) == rest.selectExpr("sum(copies)").first()[0] == sum(want.values())
    assert sum(len(t.split()) * n for t, n in taken.items()) == rest.selectExpr("sum(taken)").first()[0]
    assert set(taken.values()) <= {1, 2}


def small_tables(spark, folder):
    """Clean, toxic, copied and contaminated documents with unlike ids, labels and a benchmark."""
    rng = random.Random(21)
    item = words(rng, 40, 10**6)
    clean = [" ".join(words(rng, rng.randrange(30, 60), 10**5)) for _ in range(90)]
    texts = [*clean, *(f"{' '.join(words(rng, 30, 10**5))} vile scum filth {k}" for k in range(40))]
    texts += [clean[0], clean[1] + " more", clean[0], " ".join(words(rng, 20, 10**5) + item[20:] + words(rng, 5, 10**5) + item[:20]), " ".join(item[:10] + words(rng, 40, 10**5)), "", None]
    rows = [(k * 3, t, rng.choice(["a", "b", None])) for k, t in enumerate(texts)]
    rows_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labelled = [(k * 3, 1, int(k >= 90)) for k in range(130) if k % 4]
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def plain_probability(chain, text):
    """The chain's last probability, term by term."""
    held = set(op1.terms(text).tolist())
    earlier = []
    for m in chain.models:
        z = m.offset + sum(w for at, w in zip(m.at.tolist(), m.weight, strict=True) if at in held) + sum(w * p for w, p in zip(m.earlier, earlier, strict=True))
        earlier.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
    return earlier[-1]


def test_each_stage_equals_its_brute_force_version(spark, tmp_path):
    sf = f"file://{tmp_path}"
    small_tables(spark, sf)
    docs = read(spark, sf, "documents")
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    chain = op1.fit_chain(docs, read(spark, sf, "labels"), op1.label_categories())
    clean = pipeline.table(pipeline.toxicity(spark, docs, sf), "toxicity")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ids(clean) == Counter(i for i, t in rows if plain_probability(chain, t) < chain.threshold)
    assert set(range(90 * 3, 130 * 3, 3)).isdisjoint(ids(clean)) and set(range(0, 90 * 3, 3)) <= set(ids(clean))

    one = pipeline.table(pipeline.near_dedup(spark, clean, sf), "near_dedup")
    groups = brute_groups([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert ids(one) == Counter(i for i, (_, c) in groups.items() if i == c) and ids(one) != ids(clean)

    kept = pipeline.table(pipeline.decontamination(spark, one, sf), "decontamination")
    items = [(r["text"] or "").split() for r in read(spark, sf, "benchmark").collect()]
    held = [r["doc_id"] for r in one.collect() if any(x and 2 * greedy((r["text"] or "").split(), x, min(5, len(x))) >= len(x) for x in items)]
    assert len(held) == 1 and ids(kept) == ids(one) - Counter(held)

    mixed = pipeline.table(pipeline.mixing(spark, kept, sf), "mixing")
    again = pipeline.mixing(spark, kept.repartition(5), sf)
    assert ids(mixed) == ids(again) and set(ids(mixed)) <= set(ids(kept)) and mixed.columns == docs.columns

    code, want = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in mixed.collect():
        got = np.array([*code.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(got), zlib.crc32(got.tobytes())] += 1
    out = pipeline.run(spark, sf).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert sorted(r["start"] for r in out) == [0, *np.cumsum([r["n_tokens"] for r in sorted(out, key=lambda r: r["start"])])[:-1].tolist()]
