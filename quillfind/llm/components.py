"""Connected components of a graph of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, comp): of each linked node the least node that it reaches.

    Each round takes the least label of the neighbours, then the label of the label, until none
    changes; labels are written between rounds. Sums of a hub's neighbours are combined before the
    exchange, and joins read written tables, so that skewed hubs can be split at run time.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = materialize(both.distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")).withColumn("changed", F.lit(True)), "labels")
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("found")), "b").groupBy(F.col("a").alias("node")).agg(F.min("found").alias("found"))
        step = labels.select("node", "comp").join(near, "node").select("node", "comp", F.least("comp", "found").alias("found"))
        jump = labels.select(F.col("node").alias("found"), F.col("comp").alias("far"))
        step = step.join(jump, "found").select("node", F.least("found", "far").alias("next"), "comp")
        after = materialize(step.select("node", F.col("next").alias("comp"), (F.col("next") < F.col("comp")).alias("changed")), "labels")
        release(labels)
        labels = after
    release(both)
    return labels.drop("changed")
