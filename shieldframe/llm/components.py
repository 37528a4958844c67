"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shieldframe.llm.scratch import attach, checkpoint


def _star(edges: DataFrame) -> DataFrame:
    """edges (u, v): joins each u's least neighbour (or itself) to each of its rows as m; a hub's rows are dealt to many tasks."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return attach(edges, least, "u", F.col("v"))


def connected_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Rows (node, label) for every node of the undirected `edges` (u, v), label the least node of its component. Nodes are of
    any one type that has an order.

    Each round links every node's larger neighbours to its least one (large star), then its smaller ones
    (small star), so chains shorten by a factor each round and nothing is gathered per node; group minima are
    combined before the shuffle and the rows of a hub are split (see `attach`). Self-loops and repeated edges are
    allowed; null ends are dropped. Raises if it hasn't settled after `most_rounds`.
    """
    edges = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    now = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _star(large)
        now = checkpoint(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        )
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first()
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
