"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relish.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """``node, label`` for each node of a link; the label is the least node that links lead to.

    Each round gives a node the least label around it and then the label of its label, so the number of rounds grows with
    the logarithm of a group's width.  Every round is a written table of one row a node.  NULL ends are left out.
    After ``rounds`` of them, if given, nodes of one label are linked, but a wide group may still have several labels.
    """
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node is not null and other is not null and node != other")
    both = materialize(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"), F.lit(True).alias("moved")), "labels")
    done = 0
    while done != rounds and not labels.filter("moved").isEmpty():
        done += 1
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("near"))
        around = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.select("node", "label").join(around, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        labels = materialize(stepped.join(jump, "to").select("node", F.least("to", "beyond").alias("label"), (F.least("to", "beyond") < F.col("label")).alias("moved")), "labels")
    return labels.select("node", "label")
