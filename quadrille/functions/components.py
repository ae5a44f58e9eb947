"""Connected components over an edge table, as a DataFrame fixpoint.

Alternating large-star and small-star rounds: each round hangs every node on
the smallest node it sees, so long chains shrink in a logarithmic number of
rounds. Every round is written to the shared folder, which cuts lineage and
survives lost executors. A hub's neighbours are never gathered in one place:
both stars are a ``min`` aggregation and an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them (edges have u > v)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) for every endpoint; the component is its smallest node.

    Self-loops give a component of one node; null endpoints are ignored.
    """
    a, b = F.col(left), F.col(right)
    raw = materialise(edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now, before = raw.where("u <> v"), None
    for _ in range(MAX_ROUNDS):
        now = materialise(_small_star(_large_star(now)))
        total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = raw.where("u = v").select(F.col("u").alias("node")).distinct()
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    return stars.unionByName(alone.join(stars, "node", "left_anti").select("node", F.col("node").alias("component")))
