"""Token counts with the whole-token shortcut (see ``pieces``).

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null.
Repeated rows are counted row by row.  An empty table gives an empty result, and
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.pieces import coder


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``tokenizer`` is the path of the vocabulary file, opened by each Python worker.
    The plan is one scan and one Arrow map: no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        for b in batches:
            texts = b.column(2)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([code.count(t.as_py()) for t in texts], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
