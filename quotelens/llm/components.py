"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.plans.checkpoints import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of `links` (a, b); label is the smallest node it reaches.

    Each round every node takes the smallest label among itself and its neighbours and then the
    label of that label, so paths halve. Labels have one row per node; joins that meet a hub or
    a frequent label can be split, and the minimum per node is combined before the shuffle.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = written(links.where("a <> b").select(ways.alias("way")).select("way.*").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("near")).select(
        F.col("a").alias("node"), F.least("a", "near").alias("label"), F.lit(True).alias("moved")
    ), "labels")
    while not labels.where("moved").isEmpty():
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("seen"))
        near = both.join(seen, "b").groupBy("a").agg(F.min("seen").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("step")
        )
        target = labels.select(F.col("node").alias("step"), F.col("label").alias("far"))
        labels = written(stepped.join(target, "step").select(
            "node", F.least("step", "far").alias("label"), (F.least("step", "far") < F.col("old")).alias("moved")
        ), "labels")
    return labels.select("node", "label")
