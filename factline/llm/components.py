"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.tables import cut, hot_keys, join_groups


def components(edges: DataFrame) -> DataFrame:
    """Label (columns v, label) of every node in edges (a, b): the smallest node it reaches.

    Each round takes the least label among neighbours and then jumps along labels, so rounds
    grow with the logarithm of a path's length. Every round is cut into the checkpoint folder;
    nothing but a count reaches the driver. Hubs, and labels of large components, are hot keys:
    join_groups keeps them apart. Null ends and self-loops are left out.
    """
    links = edges.filter("a <> b").select("a", "b")
    links = cut(links.union(links.select("b", "a")).toDF("a", "b").distinct())
    labels = cut(links.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    hubs = hot_keys(links, ["b"])
    while True:
        near = join_groups(links, labels.withColumnRenamed("v", "b"), ["b"], hubs).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        least = cut(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("p")))
        new = cut(join_groups(least, least.select(F.col("v").alias("p"), F.col("p").alias("label")), ["p"], hot_keys(least, ["p"])).select("v", "old", "label"))
        if not new.filter("old <> label").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")
