"""Rotation index of loops: signed turning in the fitted plane, over two pi."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.operators import loops as L
from quadrille.operators.geometry import face_facts
from quadrille.operators.mesh import Mesh


def rotation_indices(points: np.ndarray, closed: bool) -> np.ndarray:
    """Absolute turning numbers of polylines of one length (loops, n, 3), each projected on its principal plane."""
    if points.shape[1] < 3:
        return np.zeros(len(points))
    centred = points - points.mean(1, keepdims=True)
    axes = np.linalg.eigh(centred.transpose(0, 2, 1) @ centred)[1]  # the first is the plane's normal
    xy = centred @ axes[:, :, 1:]
    step = np.diff(np.concatenate([xy, xy[:, :2]], axis=1) if closed else xy, axis=1)
    size = np.linalg.norm(step, axis=2)
    step = step / np.where(size > 0, size, 1)[:, :, None]
    a, b = step[:, :-1], step[:, 1:]
    turn = np.arccos(np.clip((a * b).sum(2), -1, 1)) * np.where(a[:, :, 0] * b[:, :, 1] - a[:, :, 1] * b[:, :, 0] < 0, -1, 1)
    return np.abs(turn.sum(1)) / (2 * np.pi)


def rotation_index(points: np.ndarray, closed: bool) -> float:
    """Absolute turning number of a polyline projected on its principal plane."""
    return float(rotation_indices(np.asarray(points, float)[None], closed)[0])


def in_order(links: list[tuple[int, int]]) -> tuple[list[int], bool]:
    """Nodes of a path or cycle of links, in walking order from its smallest tip (or node), and whether it closes.

    A node met by more than two links is passed straight on by the order of its links.
    """
    at: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(links):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    tips = sorted(n for n, x in at.items() if len(x) == 1)
    start = tips[0] if tips else min(at)
    order, used, node = [start], set(), start
    while True:
        nxt = next((i for i in at[node] if i not in used), None)
        if nxt is None:
            return (order[:-1], True) if len(order) > 1 and order[-1] == start else (order, False)
        used.add(nxt)
        a, b = links[nxt]
        node = b if node == a else a
        order.append(node)


def _turning(rows: pd.DataFrame) -> pd.DataFrame:
    """Loops are ordered one by one and turned all at once, those of one length together."""
    rows = rows.sort_values(["mesh_id", "loop_id", "a", "b"])
    a, b = rows["a"].tolist(), rows["b"].tolist()
    places = np.concatenate([rows[["ax", "ay", "az"]].to_numpy(np.float64), rows[["bx", "by", "bz"]].to_numpy(np.float64)])
    names = rows[["mesh_id", "loop_id"]].to_numpy(np.int64)
    first = np.nonzero(np.r_[True, (names[1:] != names[:-1]).any(1)])[0] if len(rows) else np.zeros(0, np.int64)
    alike: dict[tuple[int, bool], tuple[list[int], list[list[int]]]] = {}
    for i, (start, end) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(rows)], strict=False)):
        place = {n: k for k, n in enumerate(a[start:end], start)} | {n: k for k, n in enumerate(b[start:end], len(rows) + start)}
        order, closed = in_order(list(zip(a[start:end], b[start:end], strict=True)))
        which, spots = alike.setdefault((len(order), closed), ([], []))
        which.append(i)
        spots.append([place[n] for n in order])
    shut, turned = np.zeros(len(first), bool), np.zeros(len(first))
    for (_, closed), (which, spots) in alike.items():
        shut[which], turned[which] = closed, rotation_indices(places[np.array(spots)], closed)
    return pd.DataFrame({"mesh_id": names[first, 0], "loop_id": names[first, 1], "closed": shut, "rotation": turned})


LINKS_PER_BUCKET = 200_000


def _by_loop(links: DataFrame) -> DataFrame:
    links = materialise(links)  # counted, then dealt
    buckets = max(1, -(-links.count() // LINKS_PER_BUCKET), min(links.sparkSession.sparkContext.defaultParallelism, 64))
    return links.withColumn("_p", F.pmod(F.xxhash64("mesh_id", "loop_id"), F.lit(buckets))).groupBy("_p").applyInPandas(_turning, "mesh_id long, loop_id long, closed boolean, rotation double")


def edge_loop_rotation(m: Mesh, loops: DataFrame | None = None) -> DataFrame:
    """(mesh_id, loop_id, closed, rotation) over the vertices of every edge loop."""
    loops = m.once("edge_loops", lambda: L.edge_loops(m), in_place=False) if loops is None else loops
    pos = lambda k, n: m.vertices.select("mesh_id", F.col("v_id").alias(k), *(F.col(c).alias(n + c) for c in "xyz"))
    return _by_loop(loops.select("mesh_id", "loop_id", F.col("lo").alias("a"), F.col("hi").alias("b")).join(pos("a", "a"), ["mesh_id", "a"]).join(pos("b", "b"), ["mesh_id", "b"]))


def face_loop_rotation(m: Mesh) -> DataFrame:
    """(mesh_id, loop_id, closed, rotation) over the face centroids of every face loop."""
    links = L.face_loop_links(m)
    loops = L.face_loops(m).join(links, ["mesh_id", "face_id", "way"])
    c = face_facts(m).select("mesh_id", "face_id", *(F.col(f"c.{x}").alias(x) for x in "xyz"))
    # Faces of a loop follow each other over the edges that two of its links share.
    ends = loops.select("mesh_id", "loop_id", "face_id", F.explode(F.array("a", "b")).alias("e"))
    met = ends.groupBy("mesh_id", "loop_id", "e").agg(F.min("face_id").alias("a"), F.max("face_id").alias("b")).where("a < b")
    pos = lambda k: c.select("mesh_id", F.col("face_id").alias(k), *(F.col(x).alias(k + x) for x in "xyz"))
    return _by_loop(met.select("mesh_id", "loop_id", "a", "b").join(pos("a"), ["mesh_id", "a"]).join(pos("b"), ["mesh_id", "b"]))


def loop_ratios(stats: DataFrame, turning: DataFrame, prefix: str, limit: float = 1.1) -> DataFrame:
    """(mesh_id, <prefix>ratio, <prefix>spiral): weight shares of simple loops that hardly turn, and of loops that spiral."""
    r = stats.join(turning, ["mesh_id", "loop_id"], "left").na.fill(0.0, ["rotation"])
    share = lambda c, n: F.coalesce(F.sum(F.when(c, F.col("weight")).otherwise(0.0)) / F.when(F.sum("weight") > 0, F.sum("weight")), F.lit(1.0)).alias(n)
    return r.groupBy("mesh_id").agg(share((F.col("n_crossed") == 0) & (F.col("rotation") <= limit), f"{prefix}ratio"), share(F.col("rotation") >= limit, f"{prefix}spiral"))
