"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Every round a node takes the smallest label among its own and its neighbours', then the
    label of that label, so chains shorten by half. Rounds go on until no label changes. A
    node with very many links costs its neighbours' rows only: minima combine before the
    shuffle, and AQE splits a skewed side of the join.
    """
    both = save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                                F.col("a").alias("b")))
                .filter("a <> b").distinct(), "component-links")
    labels = save(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("component")), "component-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(
            F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("component").alias("was"), F.least("component", "low").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        step = save(lower.join(jump, "up", "left").select(
            "node", F.least("up", "top").alias("component"),
            (F.least("up", "top") < F.col("was")).alias("changed")), "component-labels")
        labels = step.select("node", "component")
        if not step.filter("changed").limit(1).count():
            return labels
