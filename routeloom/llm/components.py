"""Connected components of a graph in DataFrame operations.

Each round: labels point to labels (pointer jumping), every node takes the least label that a neighbour's label points
to, and hands it to its own label (hooking). Rounds grow with the logarithm of the longest path. Each round is written
to the shared folder, so a lost executor costs one round.

Hot nodes: all joins are plain joins that AQE may split; minima are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): of each node of edges (a, b: long) the smallest node that it reaches."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = cut(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("f")), "labels")
    total = _sum(labels)
    for _ in range(ROUNDS):
        if total is None:
            return labels.select("node", F.col("f").alias("component"))
        parents = labels.select(F.col("node").alias("p"), F.col("f").alias("gf"))
        jumped = labels.join(parents, F.col("f") == F.col("p")).select("node", "f", "gf")
        offered = both.join(jumped.select(F.col("node").alias("v"), "gf"), "v").groupBy("u").agg(F.min("gf").alias("m"))
        both_ways = jumped.join(offered, F.col("node") == F.col("u")).select(F.explode(F.array(F.struct("node", F.least("f", "gf", "m").alias("f")), F.struct(F.col("f").alias("node"), F.col("m").alias("f")))).alias("x"))
        new = cut(both_ways.select("x.*").groupBy("node").agg(F.min("f").alias("f")), "labels")
        forget(labels)
        labels, before, total = new, total, _sum(new)
        if total == before:
            forget(both)
            return labels.select("node", F.col("f").alias("component"))
    raise RuntimeError(f"no end after {ROUNDS} rounds")


def _sum(labels: DataFrame):
    """Labels only ever fall, so an equal sum means that none did."""
    return labels.agg(F.sum(F.col("f").cast("decimal(20,0)")).alias("s")).first()["s"]
