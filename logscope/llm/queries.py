"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm.common import read
from logscope.llm.op1_toxicity import fit_chain, label_categories, score
from logscope.llm.op2_decontamination import contaminated
from logscope.llm.op3_language import fit_letters, identify
from logscope.llm.op4_mixing import mix
from logscope.llm.op5_pii import find
from logscope.llm.op10_top_k import top_k
from logscope.llm.op11_alignment import align
from logscope.llm.op12_pieces import round_trip
from logscope.llm.op13_whitening import whiten
from logscope.llm.op6_rans import read_blocks, write_blocks
from logscope.llm.op7_wrappers import extract
from logscope.llm.op8_near_dup import near_duplicates
from logscope.llm.op9_token_counts import token_counts


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit_chain(docs, read(spark, sf_dir, "labels"), label_categories()))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    found = identify(docs, pages, fit_letters(docs))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    return found.select(of("document").alias("doc_id"), of("page").alias("page_id"), "declared", "text_lang", "lang", "p")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def op6_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_blocks(*write_blocks(read(spark, sf_dir, "documents"), tokenizer_path()))


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_language": op3_language,
        "op4_mixing": op4_mixing,
        "op5_pii": op5_pii,
        "op6_rans": op6_rans,
        "op7_wrappers": op7_wrappers,
        "op8_near_dup": op8_near_dup,
        "op9_token_counts": op9_token_counts,
        "op10_top_k": op10_top_k,
        "op11_alignment": op11_alignment,
        "op12_pieces": op12_pieces,
        "op13_whitening": op13_whitening,
    }


#: Shingle sets as lists of words, links by counting what two sets share, and their closure.
NEAR_DUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM f q JOIN f c USING (i) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_near_dup": NEAR_DUP, "op10_top_k": TOP_K}
