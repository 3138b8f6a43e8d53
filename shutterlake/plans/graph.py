"""Connected components by label propagation with pointer jumping, in DataFrames.

A round moves every node to the least label among its own and its neighbours', then to the label of
that label; components of diameter d settle in about log d rounds. Each round is checkpointed in the
shared folder, so lost executors cost a round and plans stay short.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: computed once, whatever uses it."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="shutterlake-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of undirected edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "m").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("n"), F.col("component").alias("jump"))
        moved = moved.join(up, F.col("c") == F.col("n")).select("node", F.least("c", "jump").alias("component"), "was")
        moved = checkpointed(moved)
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels
