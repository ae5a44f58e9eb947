"""Running a function of one mesh's arrays for every mesh."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrille.functions.batches import by_batch
from quadrille.operators.mesh import Mesh

Kernel = Callable[[int, np.ndarray, list[list[int]], np.ndarray], pd.DataFrame]


def per_mesh(m: Mesh, kernel: Kernel, schema: str) -> DataFrame:
    """``kernel(mesh_id, positions, faces, face_ids)`` of each mesh; face corners index the positions (vertices by id)."""

    def run(vertices: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        vertices, faces = vertices.sort_values("v_id"), faces.sort_values("face_id")
        if not len(faces):
            return pd.DataFrame([], columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
        place = {int(v): i for i, v in enumerate(vertices["v_id"])}
        return kernel(int(faces["mesh_id"].iloc[0]), vertices[["x", "y", "z"]].to_numpy(np.float64), [[place[int(v)] for v in f] for f in faces["verts"]], faces["face_id"].to_numpy())

    return by_mesh(run, schema, m.vertices.select("mesh_id", "v_id", "x", "y", "z"), m.faces.select("mesh_id", "face_id", "verts"))


def by_mesh(run: Callable[..., pd.DataFrame], schema: str, *tables: DataFrame) -> DataFrame:
    """``run`` on the rows that every mesh has in each of the tables (none: an empty frame)."""

    def one_by_one(*sides: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame | None:
        cuts = [at.tolist() for _, at in sides]
        out = [run(*(f.iloc[at[k] : at[k + 1]] for (f, _), at in zip(sides, cuts, strict=True))) for k in range(len(cuts[0]) - 1)]
        out = [o for o in out if len(o)]
        return pd.concat(out, ignore_index=True) if out else None

    return by_batch(one_by_one, schema, *tables)


def edge_faces(faces: list[list[int]]) -> dict[tuple[int, int], list[int]]:
    """Faces at every undirected edge, in face order."""
    out: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(faces):
        for a, b in zip(f, f[1:] + f[:1], strict=True):
            out.setdefault((min(a, b), max(a, b)), []).append(i)
    return out


def face_graph(faces: list[list[int]]) -> list[list[int]]:
    """Faces across the edges of every face, sorted."""
    near: list[set[int]] = [set() for _ in faces]
    for fs in edge_faces(faces).values():
        for a in fs:
            near[a].update(x for x in fs if x != a)
    return [sorted(n) for n in near]


def vertex_rings(faces: list[list[int]]) -> dict[int, list[int]]:
    """Faces around every interior vertex in turning order, from the spoke with the smallest vertex."""
    step: dict[int, dict[int, int]] = {}
    for i, f in enumerate(faces):
        for k, x in enumerate(f):
            step.setdefault(x, {})[f[(k + 1) % len(f)]] = i
    after = {(i, x): f[k - 1] for i, f in enumerate(faces) for k, x in enumerate(f)}
    out = {}
    for x, spokes in sorted(step.items()):
        first = at = min(spokes)
        ring = []
        while at in spokes and len(ring) < len(spokes):
            ring.append(spokes[at])
            at = after[spokes[at], x]
        if at == first and len(ring) == len(spokes):
            out[x] = ring
    return out
