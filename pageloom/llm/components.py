"""Connected components of links, by smallest labels and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.session import Scratch


def components(links: DataFrame, a: str, b: str, scratch: Scratch, name: str) -> DataFrame:
    """``node``, ``root`` (the smallest node it is connected with) for every node of a link.

    Each round takes the smallest label among neighbours, then the label's own
    label; rounds end when no label changes, after about the logarithm of the
    longest path. Rounds are written tables, so nothing is recomputed.
    """
    both = scratch.keep(
        links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).distinct(), f"{name}-links")
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
            .join(labels, "node").select("node", F.col("root").alias("was"), F.least("near", "root").alias("root")))
        jumped = (
            near.join(labels.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("node", "was", F.least("root", "top").alias("root")))
        now = scratch.keep(jumped, f"{name}-{turn}")
        if now.filter("root <> was").isEmpty():
            return now.select("node", "root")
        labels = now.select("node", "root")
