"""Connected components of a graph of links, by joins and checkpoints.

Labels are passed along links and then along labels (pointer jumping), so the number of rounds grows
with the logarithm of a chain's length. Each round is written to the shared folder, which also cuts
the lineage. The links never pass through the driver; only the count of changed rows does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchsafe.llm.common import settle


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node of its component."""
    x, y = F.col(a).alias("node"), F.col(b).alias("other")
    edges = links.select(x, y).union(links.select(F.col(b), F.col(a))).where("node != other")
    edges = settle(edges.distinct(), "edges")
    labels = settle(
        edges.groupBy("node").agg(F.min("other").alias("root"))
        .select("node", F.least("node", "root").alias("root")),
        "labels",
    )
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("root").alias("_theirs"))
        near = edges.join(of_other, "other").groupBy("node").agg(F.min("_theirs").alias("_near"))
        best = labels.join(near, "node").select(
            "node", "root", F.least("root", "_near").alias("_best")
        )
        # a root that learns of a lesser one passes it on to all that point to it
        up = best.groupBy("root").agg(F.min("_best").alias("_up"))
        lower = best.join(up, "root").select(
            "node", F.col("root").alias("_old"), F.least("_best", "_up").alias("_to")
        )
        above = labels.select(F.col("node").alias("_to"), F.col("root").alias("_above"))
        step = settle(
            lower.join(above, "_to", "left").select(
                "node", "_old", F.least("_to", F.coalesce("_above", "_to")).alias("root")
            ),
            "labels",
        )
        labels = step.select("node", "root")
        if step.where("root != _old").isEmpty():
            return labels
