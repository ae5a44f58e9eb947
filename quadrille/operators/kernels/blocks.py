"""Random block solids: seeded voxel growth, removal of non-manifold contacts, exposed faces as quads."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
BOX = list(itertools.product((0, 1), repeat=3))


def _whole(part: set) -> bool:
    """Whether cells hang together by face steps."""
    return not part or len(_reached(part, min(part))) == len(part)


def _contacts(cells: set) -> list[set]:
    """Occupied cells around every lattice vertex that is not manifold, in order.

    A vertex is manifold if the occupied cells among its eight hang together by
    face steps, and so do the empty ones.
    """
    out = []
    for o in sorted({(c[0] - d[0], c[1] - d[1], c[2] - d[2]) for c in cells for d in BOX}):
        box = {(o[0] + d[0], o[1] + d[1], o[2] + d[2]) for d in BOX}
        if not _whole(box & cells) or not _whole(box - cells):
            out.append(box & cells)
    return out


def _reached(cells: set, start: tuple) -> set:
    """Cells that face steps reach from a start."""
    reached, work = {start}, [start]
    while work:
        x = work.pop()
        for d in FACES:
            y = (x[0] + d[0], x[1] + d[1], x[2] + d[2])
            if y in cells and y not in reached:
                reached.add(y)
                work.append(y)
    return reached


def grow_cells(size: int, blocks: int, seed: int, tunnels: int = 0) -> list[tuple[int, int, int]]:
    """Cells of a solid grown from the centre, without non-manifold contacts."""
    rng, cells = np.random.default_rng(seed), {(size // 2,) * 3}
    for _ in range(blocks):
        for _ in range(100):
            c, d = sorted(cells)[rng.integers(len(cells))], FACES[rng.integers(6)]
            n = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
            if all(0 <= x < size for x in n) and n not in cells:
                cells.add(n)
                break
    # Every round takes cells away, so this ends; what loses the centre goes too.
    centre = (size // 2,) * 3
    while bad := _contacts(cells):
        cells = _reached(cells - {max(bad[0] - {centre})}, centre)
    return sorted(dig(cells, tunnels, rng))


def _removable(cells: set, c: tuple) -> bool:
    """Whether a solid without the cell hangs together and stays manifold at the cell's eight corners."""
    left = cells - {c}
    for d in BOX:
        box = {(c[0] - d[0] + e[0], c[1] - d[1] + e[1], c[2] - d[2] + e[2]) for e in BOX}
        if not _whole(box & left) or not _whole(box - left):
            return False
    return bool(left) and _whole(left)


def dig(cells: set, tunnels: int, rng: np.random.Generator) -> set:
    """The solid after straight runs of cells left it, each from an exposed cell inwards while cells can go."""
    for _ in range(tunnels):
        open_ = [(c, d) for c in sorted(cells) for d in FACES if (c[0] - d[0], c[1] - d[1], c[2] - d[2]) not in cells]
        c, d = open_[rng.integers(len(open_))]
        while c in cells and _removable(cells, c):
            cells = cells - {c}
            c = (c[0] + d[0], c[1] + d[1], c[2] + d[2])
    return cells


def cells(spark: SparkSession, meshes: int, size: int = 8, blocks: int = 8, seed: int = 0, tunnels: int = 0) -> DataFrame:
    """(mesh_id, i, j, k): occupied cells of seeded solids."""

    def run(batches):
        for batch in batches:
            rows = [(int(m), *c) for m in batch["id"] for c in grow_cells(size, blocks, seed * 1_000_003 + int(m), tunnels)]
            if rows:
                yield pd.DataFrame(rows, columns=["mesh_id", "i", "j", "k"])

    return spark.range(meshes).mapInPandas(run, "mesh_id long, i long, j long, k long")


def exposed_quads(c: DataFrame, size: int) -> DataFrame:
    """(mesh_id, cell, side, verts): faces between an occupied cell and an empty one, wound outwards.

    A left-anti join of (cell, direction) against the cells; vertex ids are lattice places.
    """
    n = size + 1
    # Corner offsets of each direction's quad, counter-clockwise from outside.
    quads = {0: [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)], 1: [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)], 2: [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)], 3: [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)], 4: [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)], 5: [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)]}
    vid = lambda o: ((F.col("i") + o[0]) * n + F.col("j") + o[1]) * n + F.col("k") + o[2]
    side = lambda s, d: F.struct(F.lit(s).alias("side"), (F.col("i") + d[0]).alias("ni"), (F.col("j") + d[1]).alias("nj"), (F.col("k") + d[2]).alias("nk"), F.array(*(vid(o) for o in quads[s])).alias("verts"))
    out = c.select("mesh_id", ((F.col("i") * n + F.col("j")) * n + F.col("k")).alias("cell"), F.explode(F.array(*(side(s, d) for s, d in enumerate(FACES)))).alias("q")).select("mesh_id", "cell", "q.*")
    taken = c.select("mesh_id", F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"))
    return out.join(taken, ["mesh_id", "ni", "nj", "nk"], "left_anti").select("mesh_id", "cell", "side", "verts")
