"""Entry assembly (S13-S15): an entry is a head line and the lines after it that are no heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscope.functions.parse import parse

#: Bytes after which no more lines are added, and characters that are kept.
MESSAGE = 4000
#: Lines of one block: groups are counted per block first, then across blocks.
BLOCK = 100_000


def joined(message: Column, more: Column) -> Column:
    """The message with the lines after it (structs with _bytes, the bytes before, and _raw)."""
    room = F.lit(MESSAGE) - F.octet_length(message)
    kept = F.transform(F.filter(more, lambda x: x["_bytes"] < room), lambda x: x["_raw"])
    text = F.when(F.size(F.coalesce(kept, F.array().cast("array<string>"))) > 0, F.concat_ws("\n", F.concat(F.array(message), kept))).otherwise(message)
    return F.when(F.length(text) > MESSAGE, F.concat(F.left(text, F.lit(MESSAGE)), F.lit("…"))).otherwise(text)


def assemble(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries from (source, ord, value), and skipped lines (source, ord).

    Only lines that are no heads move: they are gathered per entry and joined to the heads.
    """
    parsed = parse(lines.withColumn("_raw", F.regexp_replace("value", "[\r\n]+$", "")))
    head = F.col("level").isNotNull()
    cut = parsed.withColumn("_block", F.floor(F.col("ord") / BLOCK))
    in_block = Window.partitionBy("source", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_head", F.max(F.when(head, F.col("ord"))).over(in_block))
    # the last head of the blocks before, for lines before a block's first head
    lasts = cut.groupBy("source", "_block").agg(F.max("_head").alias("_last"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.withColumn("_before", F.max("_last").over(before)).select("source", "_block", "_before")
    cut = cut.join(lasts, ["source", "_block"]).withColumn("_head", F.coalesce("_head", "_before"))
    more = cut.where(~head).select("source", "ord", "_head", "_block", "_raw")
    skipped = more.where(F.col("_head").isNull() & (F.trim("_raw") != "")).select("source", "ord")
    size = F.octet_length("_raw") + 1
    # a line with that many bytes before it in its own block is over the ceiling whatever comes
    # before, so an entry of any length leaves few lines a block for the sum across blocks
    before = lambda *by: F.coalesce(F.sum(size).over(Window.partitionBy("source", "_head", *by).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = more.where(F.col("_head").isNotNull()).withColumn("_bytes", before("_block")).where(F.col("_bytes") < MESSAGE)
    more = more.withColumn("_bytes", before())
    gathered = more.where(F.col("_bytes") < MESSAGE).groupBy("source", F.col("_head").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "_bytes", "_raw"))).alias("_more"))
    heads = cut.where(head).drop("_block", "_head", "_before", "_raw")
    with_more = heads.join(gathered, ["source", "ord"], "left")
    return with_more.withColumn("message", joined(F.col("message"), F.col("_more"))).drop("_more"), skipped
