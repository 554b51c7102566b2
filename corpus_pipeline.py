"""The corpus pipeline: toxic documents go, one document of each group of near copies stays,
documents that hold benchmark passages go, sources are mixed to their target weights, and
the mix is written as entropy-coded token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which is what the
stage before it wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscope.llm.common import read, table
from logscope.llm.op1_toxicity import fit_chain, label_categories, reject
from logscope.llm.op2_decontamination import decontaminate
from logscope.llm.op4_mixing import mix
from logscope.llm.op6_rans import read_blocks, write_blocks
from logscope.llm.op8_near_dup import near_duplicates
from logscope.llm.queries import tokenizer_path

#: Name of the column that tells rows apart inside a stage.
ROW = "__row"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier chain, fitted on the labelled documents, calls toxic."""
    chain = fit_chain(docs, read(spark, sf_dir, "labels"), label_categories())
    return reject(docs, chain)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for every row, written, so that all later reads see the same keys;
    ids may be null or shared."""
    return table(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: that of the least id, null last."""
    docs = keyed(docs)
    groups = near_duplicates(docs, id_col=ROW).select(ROW, "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(ROW))
    kept = groups.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order).alias("first"))
    return docs.join(kept.select(F.col(f"first.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose tiles cover half of a benchmark item or more."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it; ids repeat with it."""
    docs = keyed(docs)
    taken = mix(docs, row_col=ROW).where("copies > 0").select(ROW, F.col("copies").cast("int").alias("__copies"))
    return docs.join(taken, ROW).drop(ROW).withColumn("__copies", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as blocks; per document what was read back from them."""
    return read_blocks(*write_blocks(docs, tokenizer_path()))


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Models, signatures and tokens aren't SQL; tests/llm/test_pipeline.py holds each stage against
#: a brute-force version on its own input, and run() against the tokenizer's ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
