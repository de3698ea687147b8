"""Connected components of a table of links, by labels that spread and then jump.

Each node's label is the smallest it has seen. A round takes the smallest label among a
node's own and its neighbours', then the label of that label, so that paths halve. Rounds
end when none changed. Every round is written to the shared folder, and only a count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node."""
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = scratch.table(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct(), "edges")
    state = scratch.table(edges.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = edges.join(state.withColumnsRenamed({"node": "y", "label": "seen"}), "y").groupBy("x").agg(F.min("seen").alias("seen"))
        spread = state.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("label", "seen").alias("next"), "label")
        jump = state.withColumnsRenamed({"node": "next", "label": "far"})
        after = scratch.table(spread.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")), "labels")
        still = after.filter("moved").limit(1).count() == 0
        scratch.drop(state)
        state = after.select("node", "label")
        if still:
            return state.withColumnRenamed("label", "component")
