"""Connected components of a table of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscope.llm.common import table


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of ``links`` (a, b).

    Each round every node takes the smallest label among itself and its neighbours,
    then the label of its label; rounds end when nothing changes.  Labels only fall
    and always name a node of the same component.  The labels are written between
    rounds, and only the number of changes reaches the driver.
    """
    both = table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = table(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        lower = table(lower, "lower")
        jump = lower.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        after = table(lower.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label")), "labels")
        if after.where("label < old").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
