"""Poisson-disk samples: area draws thinned in five rounds over a grid of cells.

Meshes are thinned many at a time. Draws are sorted
into cubes of the radius; in each round every cell offers its next draw, which
stays unless a kept one of the 27 cells around is nearer than the radius. Cells are
coloured by their place modulo three in each axis, so cells of one colour never see each other
and a colour is one step over arrays.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrille.functions.batches import by_batch
from quadrille.operators.mesh import Mesh

RAW_FACTOR, RADIUS, ROUNDS = 6, 0.75, 5
FACES_PER_BUCKET = 100_000
_AROUND = np.array([(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])


def fans(sizes: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles, face of each) of polygons laid end to end in ``corners``, fanned out from their first corner."""
    start = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - 2, 0)
    face = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(face)) - np.repeat(np.cumsum(n) - n, n)
    first = start[face]
    return corners[np.stack([first, first + k + 1, first + k + 2], axis=1)], face


def thin(x: np.ndarray, mesh: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which draws stay; those of a mesh stand together, ``radius`` is by draw."""
    low = np.full((int(mesh.max(initial=-1)) + 1, 3), np.inf)
    np.minimum.at(low, mesh, x)
    cell = np.floor((x - low[mesh]) / radius[:, None]).astype(np.int64) + 1
    span = cell.max(initial=0) + 2
    key = ((mesh * span + cell[:, 0]) * span + cell[:, 1]) * span + cell[:, 2]
    cells, of = np.unique(key, return_inverse=True)
    order = np.argsort(of, kind="stable")
    turn = np.empty(len(x), np.int64)
    turn[order] = np.arange(len(x)) - np.searchsorted(of[order], np.arange(len(cells)))[of[order]]
    steps = (_AROUND[:, 0] * span + _AROUND[:, 1]) * span + _AROUND[:, 2]
    near = np.searchsorted(cells, cells[:, None] + steps)
    near = np.where(cells[np.minimum(near, len(cells) - 1)] == cells[:, None] + steps, near, len(cells))
    kept = np.full((3, len(cells) + 1, ROUNDS), np.inf)  # the row behind the last stands for cells without draws
    stays, colour = np.zeros(len(x), bool), (cell % 3) @ (9, 3, 1)
    for r in range(ROUNDS):
        offered = np.flatnonzero(turn == r)
        for c in range(27):
            mine = offered[colour[offered] == c]
            if len(mine):
                around, d = near[of[mine]], 0.0
                for axis in range(3):
                    apart = kept[axis, around, : r + 1]
                    apart -= x[mine, axis][:, None, None]
                    apart *= apart
                    d = d + apart
                mine = mine[d.min((1, 2)) >= radius[mine] ** 2]
                kept[:, of[mine], r] = x[mine].T
                stays[mine] = True
    return stays


def draw(p: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(places, triangle, barycentric, radius) of raw draws by area from one mesh's triangles."""
    area = np.linalg.norm(np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), axis=1) / 2
    total = area.sum()
    if not total > 0:
        return np.zeros((0, 3)), np.zeros(0, np.int64), np.zeros((0, 3)), 0.0
    rng = np.random.default_rng(seed)
    tri = np.searchsorted(np.cumsum(area), rng.random(RAW_FACTOR * n) * total, side="right").clip(0, len(p) - 1)
    u = rng.random((len(tri), 2))
    r = np.sqrt(u[:, 0])
    bary = np.stack([1 - r, r * (1 - u[:, 1]), r * u[:, 1]], 1)
    return (p[tri] * bary[:, :, None]).sum(1), tri, bary, RADIUS * math.sqrt(total / n)


def poisson(v: np.ndarray, faces: list[list[int]], n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(positions, triangle, barycentric, radius) of about ``n`` samples of one mesh no two of which are closer than the radius."""
    t, _ = fans(np.array([len(f) for f in faces]), np.concatenate([np.asarray(f) for f in faces]))
    x, tri, bary, radius = draw(v[t], n, seed)
    stays = thin(x, np.zeros(len(x), np.int64), np.full(len(x), radius))
    return x[stays], tri[stays], bary[stays], radius


def _batch(n: int, seed: int, per_bucket: int):
    def bucket(vertices: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        vertices, faces = vertices.sort_values(["mesh_id", "v_id"]), faces.sort_values(["mesh_id", "face_id"])
        names, of_face = np.unique(faces["mesh_id"].to_numpy(np.int64), return_inverse=True)
        sizes = faces["verts"].str.len().to_numpy(np.int64)
        corners = np.concatenate([np.zeros(0, np.int64), *faces["verts"]]).astype(np.int64)
        ids, at = np.unique(np.concatenate([corners, vertices["v_id"].to_numpy(np.int64)]), return_inverse=True)
        own = vertices["mesh_id"].to_numpy(np.int64)
        known = np.isin(own, names)
        place = np.searchsorted(names, own[known]) * len(ids) + at[len(corners) :][known]  # ascending, as the vertices are
        pos = vertices[["x", "y", "z"]].to_numpy(np.float64)[known]
        tri, face = fans(sizes, np.searchsorted(place, np.repeat(of_face, sizes) * len(ids) + at[: len(corners)]))
        of = of_face[face]
        starts = np.searchsorted(of, np.arange(len(names) + 1))
        drawn = [draw(pos[tri[a:b]], n, int.from_bytes(hashlib.sha256(f"{seed}|{name}".encode()).digest()[:8], "big")) for name, a, b in zip(names, starts, starts[1:])]
        mesh = np.repeat(np.arange(len(names)), [len(d[0]) for d in drawn])
        x, t, bary = (np.concatenate([np.zeros((0, *shape)), *(d[k] for d in drawn)]) for k, shape in ((0, (3,)), (1, ()), (2, (3,))))
        radius = np.array([d[3] for d in drawn])[mesh] if len(names) else np.zeros(0)
        stays = thin(x, mesh, radius) if len(x) else np.zeros(0, bool)
        mesh, x, bary = mesh[stays], x[stays], bary[stays]
        first = np.searchsorted(mesh, np.arange(len(names)))
        return pd.DataFrame({"mesh_id": names[mesh], "s_id": np.arange(len(mesh)) - first[mesh], "tri_id": t[stays].astype(np.int64), **dict(zip("xyz", x.T)), **{f"b{k}": bary[:, k] for k in range(3)}, "radius": radius[stays]})

    def run(vertices: tuple[pd.DataFrame, np.ndarray], faces: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame:
        (v, v_at), (f, f_at) = vertices, faces
        cuts = [0, *(np.flatnonzero(np.diff(f_at[:-1] // per_bucket)) + 1).tolist(), len(f_at) - 1]
        return pd.concat([bucket(v.iloc[v_at[a] : v_at[b]], f.iloc[f_at[a] : f_at[b]]) for a, b in zip(cuts, cuts[1:])], ignore_index=True)

    return run


def poisson_samples(m: Mesh, n: int, seed: int = 7) -> DataFrame:
    """(mesh_id, s_id, tri_id, x, y, z, b0, b1, b2, radius); a mesh's draws depend on seed and mesh only.

    A mesh is one task's work; meshes with about FACES_PER_BUCKET faces are thinned at a time, where they lie.
    """
    schema = "mesh_id long, s_id long, tri_id long, x double, y double, z double, b0 double, b1 double, b2 double, radius double"
    return by_batch(_batch(n, seed, FACES_PER_BUCKET), schema, m.vertices.select("mesh_id", "v_id", "x", "y", "z"), m.faces.select("mesh_id", "face_id", "verts"))
