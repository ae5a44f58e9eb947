"""Triangles to quads: growth of quad patches, its repair, and minimum-weight matching.

Which pairs of triangles make a quad, and how regular a one, is a join over all
meshes (``quality.mergeable_quads``). A kernel sees the dual graph of one mesh
alone: its faces and the pairs of faces that share an edge, with their
regularity where they may merge. Chosen pairs become quads by a join again.

Growth starts at the most regular pair and prefers candidates next to quads made
already. What it leaves is repaired by shifting: along the shortest chain of
quads that leads from one left-over triangle to another every quad gives one of
its triangles to the next, so both ends find a partner. Matching takes the pairs
of least total irregularity that use every triangle, where there are such.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators import mesh as M
from quadrille.operators import quality as Q
from quadrille.operators.kernels.matching import minimum_matching
from quadrille.operators.mesh import Mesh, prepared

#: Weight of a pair that makes no quad: over that of any that does, as deviations from 90 degrees sum to 360 at most. A fixed value, like the hundredth of a degree that weights are cut to.
NO_QUAD, STEPS = 100_000, 100

Pairs = dict[tuple[int, int], float]


def dual_graph(m: Mesh) -> DataFrame:
    """(mesh_id, f0, f1, regularity): faces across an edge, null where they make no quad; a face with itself for every face."""
    pairs = M.edges(m).where("n_faces = 2 AND f0 <> f1").select("mesh_id", "f0", "f1").distinct()
    # Faces that share several edges may merge over the best.
    good = Q.mergeable_quads(m).groupBy("mesh_id", "f0", "f1").agg(F.min("regularity").alias("regularity"))
    own = m.faces.select("mesh_id", F.col("face_id").alias("f0"), F.col("face_id").alias("f1"), F.lit(None).cast("double").alias("regularity"))
    return pairs.join(good, ["mesh_id", "f0", "f1"], "left").select("mesh_id", "f0", "f1", "regularity").unionByName(own)


def grow(n: int, found: Pairs, beside: list[list[int]]) -> list[int]:
    """Partner of every face (-1: none) by best-first growth; every face is used once at most."""
    at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for pair in sorted(found):
        for f in pair:
            at[f].append(pair)
    match = [-1] * n
    for seed in sorted(found, key=lambda p: (found[p], p)):
        heap = [(found[seed], seed)]
        while heap:
            _, (f, g) = heapq.heappop(heap)
            if match[f] >= 0 or match[g] >= 0:
                continue
            match[f], match[g] = g, f
            for x in {y for t in (f, g) for y in beside[t] if match[y] < 0}:
                for pair in at[x]:
                    if match[pair[0]] < 0 and match[pair[1]] < 0:
                        heapq.heappush(heap, (found[pair], pair))
    return match


def shift(n: int, found: Pairs, match: list[int]) -> list[int]:
    """A matching of most pairs, by shortest chains from left-over faces; regular pairs are tried first."""
    near: list[list[int]] = [[] for _ in range(n)]
    for f, g in sorted(found, key=lambda p: (found[p], p)):
        near[f].append(g)
        near[g].append(f)
    return maximum_matching(n, near, {f: g for f, g in enumerate(match) if f < g})


def maximum_matching(n: int, near: list[list[int]], start: dict[int, int] | None = None) -> list[int]:
    """Partner of every node (-1: none) in a maximum matching, by breadth-first search with blossom contraction."""
    match = [-1] * n
    for a, b in (start or {}).items():
        match[a], match[b] = b, a

    def augment(root: int) -> bool:
        parent, base, seen, queue = [-1] * n, list(range(n)), [False] * n, [root]
        seen[root] = True

        def meet(a: int, b: int) -> int:
            path = set()
            while True:
                a = base[a]
                path.add(a)
                if match[a] < 0:
                    break
                a = parent[match[a]]
            while base[b] not in path:
                b = parent[match[base[b]]]
            return base[b]

        def mark(x: int, top: int, child: int, inside: set[int]) -> None:
            while base[x] != top:
                inside |= {base[x], base[match[x]]}
                parent[x] = child
                child, x = match[x], parent[match[x]]

        for a in queue:
            for b in near[a]:
                if base[a] == base[b] or match[a] == b:
                    continue
                if b == root or match[b] >= 0 and parent[match[b]] >= 0:
                    top, inside = meet(a, b), set()
                    mark(a, top, b, inside)
                    mark(b, top, a, inside)
                    for i in range(n):
                        if base[i] in inside:
                            base[i] = top
                            if not seen[i]:
                                seen[i] = True
                                queue.append(i)
                elif parent[b] < 0:
                    parent[b] = a
                    if match[b] < 0:
                        while b >= 0:
                            p, after = parent[b], match[parent[b]]
                            match[b], match[p] = p, b
                            b = after
                        return True
                    seen[match[b]] = True
                    queue.append(match[b])
        return False

    for r in range(n):
        if match[r] < 0:
            augment(r)
    return match


def match_all(n: int, found: Pairs, beside: list[list[int]]) -> list[int] | None:
    """Partner of every face in a perfect matching of the dual graph of least weight, or None where there is none."""
    weight = lambda f, g: int(STEPS * found.get((f, g), NO_QUAD))
    return minimum_matching(n, [(f, g, weight(f, g)) for f in range(n) for g in beside[f] if f < g])


def pair_up(dual: DataFrame, method: str) -> DataFrame:
    """(mesh_id, f0, f1): the pairs to merge of every mesh; ``grow``, ``shift`` (growth, then shifting) or ``match``.

    A mesh is one task's work. ``match`` leaves a mesh without a perfect matching as it is.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        faces, at = np.unique(rows[["f0", "f1"]].to_numpy(np.int64), return_inverse=True)
        at = at.reshape(-1, 2)
        n, beside, found = len(faces), [[] for _ in faces], {}
        for (f, g), r in zip(np.sort(at, axis=1).tolist(), rows["regularity"], strict=True):
            if f != g:
                beside[f].append(g)
                beside[g].append(f)
                if r == r:  # not missing
                    found[f, g] = float(r)
        if method == "match":
            match = match_all(n, found, beside) or [-1] * n
        else:
            match = grow(n, found, beside)
            match = shift(n, found, match) if method == "shift" else match
        chosen = [(f, g) for f, g in enumerate(match) if f < g and (f, g) in found]
        return pd.DataFrame({"mesh_id": rows["mesh_id"].iloc[0], "f0": [int(faces[f]) for f, _ in chosen], "f1": [int(faces[g]) for _, g in chosen]})

    return dual.groupBy("mesh_id").applyInPandas(run, "mesh_id long, f0 long, f1 long")


def to_quads(m: Mesh, method: str = "grow") -> DataFrame:
    """(mesh_id, face_id, verts): pairs become quads under their first triangle's id, the rest stays.

    ``grow``, ``shift`` or ``match`` as in ``pair_up``; ``shift`` then merges the two quads around
    a vertex of degree 2. ``both``: growth, and the matching where that makes more quads.
    """
    m = prepared(m)
    dual = m.once("dual_graph", lambda: dual_graph(m))
    edges = m.once("mergeable", lambda: Q.mergeable_edges(m))

    def merged(method: str) -> DataFrame:
        pairs = pair_up(dual, method).join(edges, ["mesh_id", "f0", "f1"])
        one = pairs.groupBy("mesh_id", "f0", "f1").agg(F.min(F.struct("lo", "hi", "far0", "far1")).alias("e")).select("mesh_id", "f0", "f1", "e.*")
        return Q.merge_pairs(m, one).faces

    if method == "shift":
        return Q.drop_valence_two(prepared(Mesh(m.vertices, merged("shift")))).faces
    if method != "both":
        return merged(method)
    grown, matched = m.once("grown", lambda: merged("grow")), m.once("matched", lambda: merged("match"))
    size = lambda faces, name: faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(name))
    better = size(grown, "g").join(size(matched, "m"), "mesh_id").where("m < g").select("mesh_id")
    return grown.join(better, "mesh_id", "left_anti").unionByName(matched.join(better, "mesh_id", "left_semi"))
