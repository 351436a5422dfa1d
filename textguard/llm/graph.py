"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textguard.llm.common import discard, written


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its least node.

    Each round takes the least label among a node's neighbours (a combined
    aggregation, so a node with very many links is no hot spot) and then the
    label of that label, which doubles the distance that labels travel. Rounds
    go on until none changes. Every round is written to the shared folder, and the
    one before it removed.

    Defined cases: no links, no rows; a link from a node to itself makes it a
    component; repeated and reversed links count once; links with a null are
    left out.
    """
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(links.select(F.col(b), F.col(a)))
    both = written(both.distinct(), "links")
    labels = labels_table = written(both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        new = labels.join(near.withColumnRenamed("src", "node"), "node").select("node", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("further"))
        new = new.join(jump, "best").select("node", F.least("best", "further").alias("new"), "label")
        new, old = written(new, "labels"), labels_table
        discard(old)
        labels_table = new
        moved = new.where("new < label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not moved:
            discard(both)
            return labels.withColumnRenamed("label", "component")
