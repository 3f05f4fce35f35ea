"""Connected components over an edge table."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir. Where that is unset and everything runs in this process (as in
    tests), in a temporary folder; on a cluster without the setting it is an error."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="waymark-"))
    return df.checkpoint(eager=True)


#: Rows of a table up to which it is joined by broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df (already computed), with a broadcast hint if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: src, dst -> node, component (the smallest node that can be reached).

    Each round a node takes the smallest label among its neighbours and its own, and then the label of its label, so
    long chains halve. Aggregations combine before the shuffle; labels stay in Spark, only the number of changes comes
    to the driver. Rounds end when nothing changes. Null ends and loops are dropped; no edges give no rows.
    """
    both = edges.where("src is not null and dst is not null and src != dst")
    both = cut(both.select("src", "dst").union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", F.col("component").alias("before"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(jump, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        changed = step.where("component != before").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
