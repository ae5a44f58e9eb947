"""Components of many small graphs at once, with a distributed way for large ones.

Meshes are dealt into buckets of bounded size and each bucket is labelled by a
vectorised kernel in one shuffle. A mesh with more links than a bucket may
hold goes through the distributed fixpoint instead, with equal results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.batches import by_batch
from quadrille.functions.components import connected_components
from quadrille.functions.shared import dealt, materialise

LINKS_PER_BUCKET = 500_000


def label(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node index of every node's component, by minimum hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low, new = np.minimum(x, y), root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        root = new


def _bucket(links: pd.DataFrame) -> pd.DataFrame:
    # Hashed, so that only different numbers are sorted; the order of places is that of nodes within a mesh.
    of_mesh, meshes = pd.factorize(np.tile(links["mesh_id"].to_numpy(np.int64), 2))
    of_value, values = pd.factorize(np.concatenate([links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64)]), sort=True)
    place, nodes = pd.factorize(of_mesh * len(values) + of_value, sort=True)
    root = label(place[: len(links)], place[len(links) :], len(nodes))
    node = values[nodes % max(1, len(values))]
    return pd.DataFrame({"mesh_id": meshes[nodes // max(1, len(values))], "node": node, "component": node[root]})


def components_by_mesh(links: DataFrame, per_bucket: int = LINKS_PER_BUCKET, parts: int | None = None) -> DataFrame:
    """(mesh_id, node, component) of ``links(mesh_id, a, b)``; a component is its smallest node, ids are not null.

    With ``parts`` the links lie by ``mesh_id`` in so many partitions and every mesh is small: meshes are
    labelled where they lie, without a shuffle of the links, and the result is dealt the same way.
    """
    schema = "mesh_id long, node long, component long"
    if parts:
        found = by_batch(lambda side: _bucket(side[0]), schema, links.select("mesh_id", "a", "b"))
        return dealt(materialise(found), parts)
    links = materialise(links)  # counted first, then dealt
    sizes = links.groupBy("mesh_id").count()
    total, largest = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    buckets = max(1, -(-total // per_bucket), min(links.sparkSession.sparkContext.defaultParallelism, total // 20_000))
    spread = links.withColumn("_p", F.pmod(F.xxhash64("mesh_id"), F.lit(buckets)))
    if largest <= per_bucket:
        return dealt(spread.groupBy("_p").applyInPandas(_bucket, schema))
    small = spread.join(sizes.where(F.col("count") <= per_bucket), "mesh_id", "left_semi").groupBy("_p").applyInPandas(_bucket, schema)
    big = links.join(sizes.where(F.col("count") > per_bucket), "mesh_id", "left_semi").select(F.struct("mesh_id", F.col("a").alias("n")).alias("a"), F.struct("mesh_id", F.col("b").alias("n")).alias("b"))
    found = connected_components(big, "a", "b")
    return dealt(small.unionByName(found.select("node.mesh_id", F.col("node.n").alias("node"), F.col("component.n").alias("component"))))
