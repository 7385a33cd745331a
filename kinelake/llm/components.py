"""Connected components by smallest label, in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for each end of an edge (``a``, ``b``): label is the smallest id reachable.

    A round hangs every vertex below the smallest label among its neighbours
    (combined on the map side), then halves the paths by looking labels up in
    the table itself. The labels of hubs, vertices with over a thousandth of all
    edges (two thousand at most), are broadcast to their edges, so no task gathers
    those. Each round is written to the shared folder; the number of rounds grows
    with the logarithm of a component's width, and the driver sees one count a round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = common.staged(both, "edges")
    hubs = common.staged(both.groupBy("b").agg(F.count("*").alias("n")).filter(F.col("n") >= common.large_enough(both.count())).select(F.col("b").alias("v")), "hubs")
    labels = common.staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        known = labels.join(F.broadcast(hubs.withColumn("hub", F.lit(True))), "v", "left").select(F.col("v").alias("b"), F.col("label").alias("l"), F.coalesce("hub", F.lit(False)).alias("hub"))
        near = common.join_hot(both, known, ["b"], F.col("hub")).groupBy("a").agg(F.min("l").alias("near"))
        hung = labels.join(near, labels["v"] == near["a"], "left").select("v", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("up"))
        jumped = hung.join(up, hung["next"] == up["u"], "left").select("v", "label", F.least("next", F.coalesce("up", "next")).alias("next"))
        new = common.staged(jumped, "labels")
        if new.filter("label != next").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", F.col("next").alias("label"))
