"""Connected components of links by hooking and pointer jumping; nothing is collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import durable


def components(links: DataFrame) -> DataFrame:
    """``links`` (``a``, ``b`` long) to ``node``, ``label`` (the least node of its component), for each node that
    has a link. Each round every node hooks to its least neighbour, pointers are doubled until they end at roots,
    and the links are contracted to roots; the nodes of a component at least halve in a round. A root of many nodes is a
    hot key of these joins: both sides are written tables, so that Spark's adaptive execution splits its rows."""
    edges = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = durable(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        while True:
            above = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = durable(up.join(above, "to").select("node", "next", (F.col("next") != F.col("to")).alias("moved")), "jumps")
            up = jumped.select("node", F.col("next").alias("to"))
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = up.select("node", F.col("to").alias("label"))
        else:
            over = up.select(F.col("node").alias("label"), "to")
            labels = durable(labels.join(over, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias(end), "to"), end).drop(end).withColumnRenamed("to", end)
        edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
