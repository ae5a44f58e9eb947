"""Fingerprints of meshes and order-dependent dedup by them, in batch and as a stream."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.batches import by_batch
from quadrille.functions.shared import materialise
from quadrille.operators import geometry as G
from quadrille.operators import mesh as M
from quadrille.operators.mesh import Mesh

KEY = ["n_vertices", "n_edges", "n_faces", "n_boundary_edges", "n_boundary_vertices", "euler", "n_irregular", "max_degree", "min_degree", "n_interior_low", "n_interior_high"]
TOLERANCE = 0.05


def _principal(rows: pd.DataFrame, at: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """(rows by mesh and vertex, centred points, axes of every mesh by rising moment, mesh of every row); a mesh's rows begin at ``at``."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows = rows.iloc[np.lexsort([rows["v_id"], of])]
    x = rows[["x", "y", "z"]].to_numpy(np.float64)
    x = x - (np.add.reduceat(x, at[:-1]) / np.diff(at)[:, None])[of]
    return rows, x, np.linalg.eigh(np.add.reduceat(x[:, :, None] * x[:, None, :], at[:-1]))[1], of


def _turned(x: np.ndarray, axes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Points in the axes of their mesh."""
    return sum(x[:, k, None] * axes[of, k] for k in range(3))


def _extents(side: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame:
    """Box sides in principal axes over the longest one, for every mesh of a batch."""
    rows, x, axes, of = _principal(*side)
    y, at = _turned(x, axes, of), side[1][:-1]
    s = np.sort(np.maximum.reduceat(y, at) - np.minimum.reduceat(y, at), axis=1)[:, ::-1]
    s = s / np.where(s[:, :1] > 0, s[:, :1], 1.0)
    return pd.DataFrame({"mesh_id": rows["mesh_id"].to_numpy()[at], "sx": s[:, 0], "sy": s[:, 1], "sz": s[:, 2]})


def principal_sides(m: Mesh) -> DataFrame:
    """(mesh_id, sx, sy, sz): box sides in principal axes over the longest, falling; a batch of meshes at a time."""
    return by_batch(_extents, "mesh_id long, sx double, sy double, sz double", m.vertices.select("mesh_id", "v_id", "x", "y", "z"))


def fingerprints(m: Mesh) -> DataFrame:
    """(mesh_id, eleven counts, sx, sy, sz)."""
    inner = lambda n: F.count_if(~F.col("boundary") & (F.col("degree") == n))
    t = M.topology(m, F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), inner(3).alias("n_interior_low"), inner(5).alias("n_interior_high"))
    return t.join(principal_sides(m), "mesh_id").select("mesh_id", *KEY, "sx", "sy", "sz")


def close(a: tuple, b: tuple, tolerance: float = TOLERANCE) -> bool:
    return max(abs(x - y) / max(abs(y), 1e-12) for x, y in zip(a, b, strict=True)) < tolerance


class Sizes:
    """Sizes kept so far, by cells of their logarithms: what is close to a size lies in the cells around its own."""

    def __init__(self, tolerance: float = TOLERANCE):
        self.tolerance, self.width, self.cells, self.n = tolerance, -math.log(1 - tolerance), {}, 0

    def _cell(self, size: tuple) -> tuple[int, ...]:
        return tuple(math.floor(math.log(max(x, 1e-12)) / self.width) for x in size)

    def keep(self, name, size: tuple) -> None:
        self.cells.setdefault(self._cell(size), []).append((self.n, name, size))
        self.n += 1

    def first_close(self, size: tuple):
        """Name of the earliest kept size that this one repeats, or None."""
        around = itertools.product(*((c - 1, c, c + 1) for c in self._cell(size)))
        return min(((n, name) for c in around for n, name, s in self.cells.get(c, ()) if close(size, s, self.tolerance)), default=(0, None))[1]


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """First come stays: a mesh goes if it is close to one kept before it, in the order of ``arrival``; stored ones stay."""
    kept, out = Sizes(), []
    for r in rows.sort_values(["stored", "arrival", "mesh_id"], ascending=[False, True, True]).itertuples(index=False):
        size = (r.sx, r.sy, r.sz)
        if r.stored:
            kept.keep(r.mesh_id, size)
            continue
        twin = kept.first_close(size)
        if twin is None:
            kept.keep(r.mesh_id, size)
        out.append((r.mesh_id, r.mesh_id if twin is None else twin))
    return pd.DataFrame(out, columns=["mesh_id", "keep_id"])


def dedup(prints: DataFrame, arrival: str = "mesh_id", known: DataFrame | None = None) -> DataFrame:
    """(mesh_id, keep_id): the earlier mesh that a mesh repeats, or itself.

    Meshes come in the order of the column ``arrival``, ids breaking ties; those of ``known``,
    with the same columns, came before and stay. Which of several stays depends on the
    order, so the meshes of one key (eleven counts) are one task's work.
    """
    columns = lambda df, stored: df.select("mesh_id", *KEY, "sx", "sy", "sz", F.col(arrival).cast("long").alias("arrival"), F.lit(stored).alias("stored"))
    rows = columns(prints, False)
    if known is not None:
        rows = rows.unionByName(columns(known, True))
    return rows.groupBy(*KEY).applyInPandas(_greedy, "mesh_id long, keep_id long")


def dedup_with_database(prints: DataFrame, folder: str, arrival: str = "mesh_id") -> DataFrame:
    """``dedup`` against the fingerprints that earlier runs left in ``folder``, to which the newly kept ones are added.

    ``folder`` is a Parquet table that driver and executors share; meshes that are in it
    already are neither tested nor added again. Two runs over two halves, in
    order, give what one gives over both.
    """
    spark = prints.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder) if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) else None
    prints = prints.select("mesh_id", *KEY, "sx", "sy", "sz", *([arrival] if arrival != "mesh_id" else []))
    if known is not None:
        prints = prints.join(known.select("mesh_id"), "mesh_id", "left_anti")
    prints = materialise(prints)
    out = materialise(dedup(prints, arrival, known))
    prints.join(out.where("mesh_id = keep_id").select("mesh_id"), "mesh_id", "left_semi").write.mode("append").parquet(folder)
    return out


def principal_frame(m: Mesh) -> DataFrame:
    """Vertices centred, turned to principal axes (signs by the largest entry) and scaled by the largest radius."""

    def run(side: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame:
        rows, x, axes, of = _principal(*side)
        axes = axes[:, :, ::-1]
        largest = np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)
        y = _turned(x, axes * np.where(largest < 0, -1, 1), of)
        y = y / np.maximum(np.maximum.reduceat(np.linalg.norm(y, axis=1), side[1][:-1]), 1e-300)[of, None]
        return pd.DataFrame({"mesh_id": rows["mesh_id"], "v_id": rows["v_id"], "x": y[:, 0], "y": y[:, 1], "z": y[:, 2]})

    return by_batch(run, "mesh_id long, v_id long, x double, y double, z double", m.vertices.select("mesh_id", "v_id", "x", "y", "z"))


def area_by_mesh(m: Mesh) -> DataFrame:
    return G.face_facts(m).groupBy("mesh_id").agg(F.sum("area").alias("area"))
