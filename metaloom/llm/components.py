"""Connected components of a link table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.llm.base import saved


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of links(u, v), the smallest node that is reachable from it.

    Each round, a node takes the smallest label among its own, its neighbours' and its label's; the rounds grow with
    the logarithm of the longest path.  Every round's table is written to the shared folder, so lineage stays short.
    Minima are taken before rows move, so a node with very many links costs one row for each task.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = saved(both.filter(F.col("u") != F.col("v")).distinct(), "links")
    labels = saved(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("v"), F.col("label").alias("theirs"))
        near = both.join(of, "v").groupBy("u").agg(F.min("theirs").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        # The old label's own node is told of the smaller label as well, so that whole trees hook at once.
        told = step.filter(F.col("low") < F.col("was")).groupBy("was").agg(F.min("low").alias("told"))
        step = step.join(told.withColumnRenamed("was", "node"), "node", "left").select("node", "was", F.least("low", F.coalesce("told", "low")).alias("low"))
        step = saved(step, "labels")
        up = step.select(F.col("node").alias("low"), F.col("low").alias("up"))
        labels = saved(step.join(up, "low").select("node", "was", F.col("up").alias("label")), "labels")
        moved = labels.filter(F.col("label") != F.col("was")).limit(1).count()
        labels = labels.select("node", "label")
        if not moved:
            return labels
