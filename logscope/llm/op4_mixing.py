"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: the sources, sorted by code point with null
last, weigh 5, 2, 1 and so on again, share ``budget`` times all words by weight,
and none gets more than ``max_copies`` times its words; what a full source leaves
goes to the others by weight.

Inside a source each document expects ``r * p / mean(p)`` copies, where r is the
source's target over its words and the preference p falls with the document's size
(never above ``max_copies``).  The whole part is taken for certain.  The rest is an
inclusion probability, and one more copy is drawn by Pareto order sampling:
documents are ranked by the odds of a uniform number over the inclusion odds, and
taken in that order up to the words the source still needs (the document at the
edge counts if that comes nearer).  The uniform number is a hash of the id and a
seed, so reruns and any partitioning agree.

The running sum in rank order is never one sort of a source: ranks are dealt into
equal steps, sums per step find the step at the edge, and only that step's documents
are ranked against each other.

Nulls: a null text has size 0 and takes 0 words; a null source is a source of its own;
a null id hashes as the empty string.  Rows alike in all of this rank alike and are
ordered by size.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logscope.llm.common import table, word_count

#: Steps of the rank: first over all documents, then inside the step at the edge.
STEPS = 1024
#: Most rows of a table of one row a source that are broadcast; beyond that it is joined by
#: shuffle, where Spark splits the hot sources.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_copies: int = 2) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    Filling by weight up to the limits: in the order of limit over weight the first
    sources are full.  The level (words a unit of weight) that is left when the first k
    are full rises with k as long as those are really over it, then falls: its largest
    value is the level of the sources that are not full.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    every, order = Window.partitionBy(), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size").cast("double") * max_copies)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(every) * F.lit(budget))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_words") - F.col("full_before")) / F.col("weight_from"))
        .withColumn("final_level", F.max("level").over(every))
    )
    share = F.when(F.col("ratio") < F.col("final_level"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("final_level")))
    return w.select("source", "source_size", F.coalesce(share, F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, max_copies: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: DataFrame | None = None, row_col: str | None = None) -> DataFrame:
    """id, source, size, source_size, target, copies, taken for every row of ``docs``; with
    ``row_col``, a key that tells rows apart where ids don't, that column too."""
    row = [row_col] if row_col else []
    uniform = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = table(docs.select(*row, F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), uniform.alias("u")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0))
    shares = targets(sums.select("source", "source_size"), weights, budget, max_copies)
    sums = sums.select("source", "n", mean.alias("mean_size")).withColumnRenamed("source", "s2")
    per = shares.join(sums, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    # preference 1.1 for the shortest documents down to 0.9 for the longest
    wide = rows.join(_per_source(per.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    wide = wide.withColumn("p", F.lit(1.1) - F.lit(0.2) * F.col("size") / (F.col("size") + F.col("mean_size")))
    norm = wide.groupBy("source").agg((F.sum(F.round(F.col("p") * F.col("size") * 1000).cast("long")) / 1000.0 / F.greatest(F.sum("size"), F.lit(1))).alias("p_mean")).withColumnRenamed("source", "s2")
    wide = wide.join(_per_source(norm), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    expected = F.least(F.lit(float(max_copies)), ratio * F.col("p") / F.col("p_mean"))
    wide = wide.withColumn("expected", F.when(F.col("size") > 0, expected).otherwise(F.lit(0.0)))
    wide = wide.withColumn("whole", F.floor("expected").cast("long"))
    odds_in = (F.col("expected") - F.col("whole") + 1e-9) / (F.lit(1.0) - (F.col("expected") - F.col("whole")) + 1e-9)
    q = F.col("u") / (1 - F.col("u")) / odds_in
    can = (F.col("whole") < max_copies) & (F.col("size") > 0)
    wide = wide.withColumn("rank", F.when(can, q / (1 + q)))
    wide = wide.withColumn("step", F.floor(F.col("rank") * STEPS).cast("int")).withColumn("fine", F.floor(F.col("rank") * STEPS * STEPS).cast("long") % STEPS)
    wide = table(wide.drop("p", "p_mean", "mean_size", "n", "expected", "u"), "ranked")

    # words still to draw, and the step where the running sum passes them
    need = wide.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("need"))
    first = table(_edge(wide.where("rank is not null").groupBy("source", "step").agg(F.sum("size").alias("w")), need, "step"), "edges")
    inner = wide.where("rank is not null").join(_per_source(first.withColumnRenamed("source", "s2")), F.col("source").eqNullSafe(F.col("s2")) & (F.col("step") == F.col("edge"))).drop("s2")
    second = _edge(inner.groupBy("source", "fine").agg(F.sum("size").alias("w")), first.select("source", F.col("left").alias("need")), "fine")
    second = second.select(F.col("source").alias("s3"), F.col("edge").alias("edge2"), F.col("left").alias("left2"))
    first = first.select(F.col("source").alias("s2"), "edge")
    placed = wide.join(_per_source(first), F.col("source").eqNullSafe(F.col("s2")), "left").join(_per_source(second), F.col("source").eqNullSafe(F.col("s3")), "left")
    at_edge = (F.col("step") == F.col("edge")) & (F.col("fine") == F.col("edge2"))
    sure = F.col("rank").isNotNull() & ((F.col("step") < F.coalesce("edge", F.lit(STEPS))) | ((F.col("step") == F.col("edge")) & (F.col("fine") < F.coalesce("edge2", F.lit(STEPS)))))
    placed = placed.withColumn("at_edge", F.coalesce(at_edge, F.lit(False)))
    here = Window.partitionBy("source").orderBy("rank", "size", "id", *row).rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("at_edge").withColumn("running", F.sum("size").over(here))
    edge = edge.withColumn("extra", (F.col("running") - F.col("size") / 2.0 <= F.col("left2")).cast("long")).drop("running")
    rest = placed.where(~F.col("at_edge")).withColumn("extra", F.coalesce(sure, F.lit(False)).cast("long"))
    copies = F.col("whole") + F.col("extra")
    return edge.unionByName(rest).select(*row, F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _per_source(df: DataFrame) -> DataFrame:
    """A table of one row a source, broadcast up to ``BROADCAST_SOURCES`` rows, so that the
    documents of a hot source stay where they are."""
    df = table(df, "sources")
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def _edge(sums: DataFrame, need: DataFrame, step: str) -> DataFrame:
    """source, edge, left: the step of each source in which the running sum passes
    ``need``, and the words left to draw there; no row where all steps fit."""
    need = need.withColumnRenamed("source", "s9")
    run = sums.join(need, F.col("source").eqNullSafe(F.col("s9"))).drop("s9")
    run = run.withColumn("upto", F.sum("w").over(Window.partitionBy("source").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))
    over = run.where(F.col("upto") > F.col("need"))
    return over.groupBy("source").agg(F.min_by(F.struct(F.col(step).alias("edge"), (F.col("need") - (F.col("upto") - F.col("w"))).alias("left")), F.col(step)).alias("e")).select("source", "e.edge", "e.left")
