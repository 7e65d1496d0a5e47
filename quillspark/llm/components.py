"""Connected components of a graph that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, c): for every vertex of edges (x, y), the smallest vertex that it is connected with.

    Each round takes the smallest label among a vertex and its neighbours, then follows labels once
    (pointer jumping), and writes the labels in the shared folder.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels = written(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("c")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, both.x == labels.v).groupBy(F.col("y").alias("v")).agg(F.min("c").alias("m"))
        low = labels.join(heard, "v", "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("l"))
        up = labels.select(F.col("v").alias("l"), F.col("c").alias("p"))
        new = written(low.join(up, "l", "left").select("v", F.least("l", F.coalesce("p", "l")).alias("c"), (F.least("l", F.coalesce("p", "l")) != F.col("c")).alias("moved")), "labels")
        labels = new.select("v", "c")
        if not new.where("moved").take(1):
            return labels
    raise RuntimeError("components did not settle")
