"""Connected components of a table of links, by rounds of least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.llm._common import discard, written


def components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link: node, label (its least node). `links` has two columns of one orderable type.

    Each round a node takes the least label among its neighbours and then its label's label; labels are a written table
    between rounds, so the plan stays short. Null ends and loops are ignored, repeated links count once.
    """
    a, b = links.columns
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = written(pairs.union(pairs.select("other", "node")).distinct(), "links")
    labels = written(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label"), F.col("label").alias("was"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = written(nearer.join(far, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was"), "labels")
        discard(labels)
        if not after.where("label <> was").limit(1).count():
            discard(both)
            out = after.drop("was")
            out.written_to = after.written_to
            return out
        labels = after
