"""Closed forms, dual implementations and metamorphic checks of the mesh operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.functions.components import connected_components
from quadrille.functions.local_components import components_by_mesh
from quadrille.operators import arcs
from quadrille.operators import dedup as D
from quadrille.operators import geometry as G
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators import nearest
from quadrille.operators import quality as Q
from quadrille.operators import spatial as X
from quadrille.operators import subdivision as S
from quadrille.functions.shared import materialise
from quadrille.operators.kernels import blocks, matching, rotation, sampling, trimerge
from quadrille.plans.derived import dims, mesh

VERTS = "mesh_id long, v_id long, x double, y double, z double"
FACES = "mesh_id long, face_id long, verts array<long>"


def build(spark, meshes):
    """A mesh table from {mesh_id: (positions, faces)}."""
    v = [(m, i, *map(float, p)) for m, (pos, _) in meshes.items() for i, p in enumerate(pos)]
    f = [(m, i, list(map(int, x))) for m, (_, faces) in meshes.items() for i, x in enumerate(faces)]
    return M.Mesh(spark.createDataFrame(v, VERTS), spark.createDataFrame(f, FACES))


def cube(n):
    """The surface of a cube with n by n quads a side."""
    ids, pos, faces = {}, [], []

    def at(*p):
        if p not in ids:
            ids[p] = len(pos)
            pos.append(p)
        return ids[p]

    for axis in range(3):
        for side in (0, n):
            for i in range(n):
                for j in range(n):
                    def p(a, b):
                        c = [0, 0, 0]
                        c[axis], c[(axis + 1) % 3], c[(axis + 2) % 3] = side, a, b
                        return at(*c)
                    q = [p(i, j), p(i + 1, j), p(i + 1, j + 1), p(i, j + 1)]
                    faces.append(q if side else q[::-1])
    return pos, faces


def radial(seed, flips=40):
    """Radial quadrangulation of a flipped octahedron-based triangulation: loops that often cross themselves."""
    rng = random.Random(seed)
    tris = [(0, 2, 4), (2, 1, 4), (1, 3, 4), (3, 0, 4), (2, 0, 5), (1, 2, 5), (3, 1, 5), (0, 3, 5)]
    pos = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    for _ in range(6):
        i = rng.randrange(len(tris))
        a, b, c = tris.pop(i)
        n = len(pos)
        pos.append(tuple(np.mean([pos[a], pos[b], pos[c]], axis=0) * 1.1))
        tris += [(a, b, n), (b, c, n), (c, a, n)]
    for _ in range(flips):
        half = {(t[k], t[(k + 1) % 3]): i for i, t in enumerate(tris) for k in range(3)}
        (a, b), i = rng.choice(sorted(half.items()))
        j = half[b, a]
        p, q = next(x for x in tris[i] if x not in (a, b)), next(x for x in tris[j] if x not in (a, b))
        if p == q or (p, q) in half or (q, p) in half:
            continue
        tris[i], tris[j] = (p, a, q), (q, b, p)
    half = {(t[k], t[(k + 1) % 3]): i for i, t in enumerate(tris) for k in range(3)}
    base = len(pos)
    pos += [tuple(np.mean([pos[x] for x in t], axis=0)) for t in tris]
    return pos, [(a, base + half[b, a], b, base + i) for (a, b), i in sorted(half.items()) if a < b]


def test_closed_forms(spark, sf):
    t = {r["mesh_id"]: r for r in M.topology(mesh(spark, sf, "part")).collect()}
    g = {r["mesh_id"]: r for r in M.genus_table(mesh(spark, sf, "part")).collect()}
    for r in dims(spark, sf, "part").collect():
        a, b, x, y = r["a"], r["b"], t[r["mesh_id"]], g[r["mesh_id"]]
        v = {0: (a + 1) * (b + 1), 1: a * (b + 1), 2: a * b}.get(r["kind"], (a + 1) ** 2 - (a - 1))
        assert (x["n_vertices"], x["n_faces"], y["n_components"]) == (v, a * b, 1)
        assert (y["n_boundaries"], y["genus"]) == {0: (1, 0), 1: (2, 0), 2: (0, 1), 3: (2, 0)}[r["kind"]]


def test_cubes(spark):
    m = build(spark, {n: cube(n) for n in (1, 2, 3)})
    t = {r["mesh_id"]: r for r in M.topology(m).collect()}
    charts = {r["mesh_id"]: r["n_charts"] for r in L.chart_distribution(m).collect()}
    loops = {r["mesh_id"]: r["n"] for r in L.face_loop_stats(m).groupBy("mesh_id").agg(F.count("*").alias("n")).collect()}
    for n in (1, 2, 3):
        assert (t[n]["n_vertices"], t[n]["n_edges"], t[n]["n_faces"], t[n]["n_irregular"], charts[n], loops[n]) == (6 * n * n + 2, 12 * n * n, 6 * n * n, 8, 6, 3 * n)


def walked_loops(faces):
    """Face loops by walking from side to side; each is the multiset of its faces."""
    half = {(f[k], f[(k + 1) % 4]): (i, k) for i, f in enumerate(faces) for k in range(4)}
    seen, out = set(), []
    for a, b in sorted({(min(e), max(e)) for e in half}):
        if (a, b) in seen:
            continue
        loop, members = [], set()
        for start in ((a, b), (b, a)):
            e = start
            while e in half:
                i, k = half[e]
                if (i, k % 2) in members:
                    break
                members.add((i, k % 2))
                loop.append(i)
                f = faces[i]
                e = (f[(k + 3) % 4], f[(k + 2) % 4])
                seen.add((min(e), max(e)))
        seen.add((a, b))
        if len(loop) >= 2:
            out.append(tuple(sorted(loop)))
    return sorted(out)


def test_face_loops_against_walker(spark):
    meshes = {s: radial(s) for s in range(40)}
    got = {}
    for r in L.face_loops(build(spark, meshes)).groupBy("mesh_id", "loop_id").agg(F.sort_array(F.collect_list("face_id")).alias("f")).collect():
        got.setdefault(r["mesh_id"], []).append(tuple(r["f"]))
    crossing = 0
    for s, (_, faces) in meshes.items():
        want = walked_loops(faces)
        assert sorted(got[s]) == want
        crossing += any(len(set(x)) < len(x) for x in want)
    assert crossing >= 20


def test_winding_and_concatenation(spark):
    m = build(spark, {s: radial(s) for s in range(6)})
    base = sorted((r["mesh_id"], round(r["fratio"], 9), round(r["eratio"], 9)) for r in L.simple_ratios(m).collect())
    back = sorted((r["mesh_id"], round(r["fratio"], 9), round(r["eratio"], 9)) for r in L.simple_ratios(M.reversed_mesh(m)).collect())
    assert base == back
    one = M.concatenated(m, F.lit(0).cast("long"))
    assert M.face_components(one).select("comp_id").distinct().count() == 6


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(2500)] + [(10_000 + i, 10_001 + i) for i in range(400)] + [(None, 3), (20_000, 20_000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: root(x) for x in list(parent)}
    links = df.where("src IS NOT NULL").selectExpr("src % 3 AS mesh_id", "src AS a", "dst AS b").where("a < 10000 OR a >= 10000")
    small = {(r["mesh_id"], r["node"], r["component"]) for r in components_by_mesh(links).collect()}
    large = {(r["mesh_id"], r["node"], r["component"]) for r in components_by_mesh(links, per_bucket=500).collect()}
    assert small == large


def test_nonmanifold(spark):
    cones = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)], [(0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 5), (0, 5, 6), (0, 6, 4)])
    book = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, -1, 0)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)])
    fold = ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2, 1)])
    got = {r["mesh_id"]: r for r in M.nonmanifold(build(spark, {1: cones, 2: book, 3: fold, 4: cube(2)})).collect()}
    assert got[1]["broken_star"] == 1 and got[2]["crowded_edge"] == 1 and got[3]["repeated_corner"] == 1
    assert got[4]["repeated_corner"] + got[4]["crowded_edge"] + got[4]["crowded_boundary"] + got[4]["broken_star"] == 0


def test_weld(spark):
    pos, faces = cube(3)
    torn = ([pos[v] for f in faces for v in f], [list(range(4 * i, 4 * i + 4)) for i in range(len(faces))])
    m, _ = X.weld(build(spark, {1: torn}))
    t = M.topology(m).first()
    assert (t["n_vertices"], t["n_faces"], t["n_boundary_edges"]) == (56, 54, 0)
    same = ([(1, 1, 1)] * 500, [(0, 1, 2)])
    assert X.weld(build(spark, {1: same}))[1].select("rep").distinct().count() == 1


def test_subdivision(spark):
    m = build(spark, {1: cube(2)})
    for out in (S.split_quads(m), S.catmull_clark(m)):
        t = M.topology(out).first()
        assert (t["n_vertices"], t["n_edges"], t["n_faces"], t["euler"], t["n_boundary_edges"]) == (98, 192, 96, 2, 0)
    assert L.chart_distribution(S.split_quads(m)).first()["n_charts"] == 6
    area = D.area_by_mesh(S.split_quads(m)).first()["area"]
    assert area == pytest.approx(24.0)
    assert S.levels_for(50_000, 100, 1) == 5


def test_rotation_index():
    t = np.linspace(0, 2 * np.pi, 40, endpoint=False)
    circle = np.stack([np.cos(t), np.sin(t), 0 * t], 1)
    assert rotation.rotation_index(circle, True) == pytest.approx(1.0)
    assert rotation.rotation_index(np.stack([np.cos(2 * t), np.sin(2 * t), 0 * t], 1), True) == pytest.approx(2.0)
    assert rotation.rotation_index(circle[:1], True) == 0


def test_poisson():
    pos, faces = cube(2)
    x, tri, bary, r = sampling.poisson(np.array(pos, float), faces, 200, 3)
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.eye(len(x)) * 9
    assert d.min() >= r - 1e-12 and len(x) > 60 and np.allclose(bary.sum(1), 1) and len(tri) == len(x)


def test_thinning_is_first_fit_by_rounds():
    """Kept draws keep their distance, every other of the first five of a cell is too near to a kept one, and meshes do not mix."""
    rng = np.random.default_rng(4)
    mesh = np.repeat([0, 1, 2], [900, 50, 1])
    x = rng.random((len(mesh), 3)) * np.array([3.0, 0.2, 1.0])[mesh][:, None]
    radius = np.array([0.4, 0.07, 1.0])[mesh]
    stays = sampling.thin(x, mesh, radius)
    for k in range(3):
        own = np.flatnonzero(mesh == k)
        kept = own[stays[own]]
        d = np.linalg.norm(x[own][:, None] - x[kept][None], axis=2)
        assert (d + 9 * (own[:, None] == kept[None]))[stays[own]].min() >= radius[own[0]]
        cell = np.floor((x[own] - x[own].min(0)) / radius[own[0]])
        seen: dict = {}
        for i, c in enumerate(map(tuple, cell)):
            seen[c] = seen.get(c, 0) + 1
            assert stays[own[i]] or seen[c] > sampling.ROUNDS or d[i].min() < radius[own[0]]


def test_poisson_samples_of_many_meshes(spark, monkeypatch):
    shapes = {i: cube(1 + i % 3) for i in range(20)} | {50: ([(0, 0, 0), (1, 0, 0), (2, 0, 0)], [(0, 1, 2)])}
    m = build(spark, shapes)
    one = {tuple(r) for r in sampling.poisson_samples(m, 40).collect()}
    monkeypatch.setattr(sampling, "FACES_PER_BUCKET", 10)
    assert {tuple(r) for r in sampling.poisson_samples(m, 40).collect()} == one and {r[0] for r in one} == set(range(20))
    for i, (pos, faces) in list(shapes.items())[:3]:
        mine = [r for r in one if r[0] == i]
        t, _ = sampling.fans(np.array([len(f) for f in faces]), np.concatenate(faces))
        for r in mine:
            assert np.allclose(np.array(r[3:6]), (np.array(pos, float)[t[r[2]]] * np.array(r[6:9])[:, None]).sum(0))


def test_matching_is_maximum():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(2, 9)
        near = [[] for _ in range(n)]
        for a in range(n):
            for b in range(a):
                if rng.random() < 0.35:
                    near[a].append(b)
                    near[b].append(a)
        match = trimerge.maximum_matching(n, near)
        assert all(m < 0 or (match[m] == i and m in near[i]) for i, m in enumerate(match))

        def best(free):
            if not free:
                return 0
            a = min(free)
            return max([best(free - {a})] + [1 + best(free - {a, b}) for b in near[a] if b in free])

        assert sum(m >= 0 for m in match) // 2 == best(frozenset(range(n)))


def test_minimum_matching():
    """Least weight of a perfect matching, against trying all of them."""
    import functools
    import random

    rng = random.Random(5)
    for _ in range(1500):
        n, share, top = rng.choice([2, 4, 6, 8, 10, 12]), rng.choice([0.25, 0.4, 0.7, 1]), rng.choice([1, 3, 10, 36_000, 10_000_000])
        w = {(i, j): rng.randint(0, top) for i in range(n) for j in range(i + 1, n) if rng.random() < share}

        @functools.cache
        def least(taken):
            if taken == (1 << n) - 1:  # noqa: B023
                return 0
            i = next(k for k in range(n) if not taken >> k & 1)  # noqa: B023
            return min((w[i, j] + least(taken | 1 << i | 1 << j) for j in range(i + 1, n) if not taken >> j & 1 and (i, j) in w), default=float("inf"))  # noqa: B023

        match = matching.minimum_matching(n, [(i, j, x) for (i, j), x in w.items()])
        assert (match is None) == (least(0) == float("inf"))
        if match:
            assert all(match[match[i]] == i != match[i] for i in range(n))
            assert sum(w[i, j] for i, j in enumerate(match) if i < j) == least(0)
    assert matching.minimum_matching(3, [(0, 1, 1), (1, 2, 1)]) is None and matching.minimum_matching(0, []) == []


def test_triangles_to_quads(spark):
    m = build(spark, {1: cube(2), 2: ([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])})
    t = M.Mesh(m.vertices, G.quads_to_triangles(m))
    for method in ("match", "shift"):
        q = trimerge.to_quads(t, method).collect()
        assert sorted((r["mesh_id"], len(r["verts"])) for r in q) == [(1, 4)] * 24 + [(2, 3)], method
    corners = sorted(tuple(sorted(r["verts"])) for r in trimerge.to_quads(t, "grow").where("mesh_id = 1").collect())
    assert len({c for f in corners for c in f}) == 26


def test_least_weight_and_fewest_left_over(spark, sf):
    """Matched pairs weigh no more than those of growth, and shifting leaves no more triangles than it, none where a perfect matching of quads exists."""
    m = mesh(spark, sf, "part")
    dual = materialise(trimerge.dual_graph(M.prepared(M.Mesh(m.vertices, G.quads_to_triangles(m)))))
    faces = {r["mesh_id"]: r["n"] for r in dual.where("f0 = f1").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    scored = lambda method: {r["mesh_id"]: (r["n"], r["w"]) for r in trimerge.pair_up(dual, method).join(dual, ["mesh_id", "f0", "f1"]).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.sum("regularity").alias("w")).collect()}
    grown, shifted, matched = scored("grow"), scored("shift"), scored("match")
    assert set(grown) == set(shifted) >= set(matched)
    assert all(shifted[k][0] >= grown[k][0] for k in grown) and any(shifted[k][0] > grown[k][0] for k in grown)
    full = [k for k in matched if 2 * matched[k][0] == faces[k]]
    assert full and all(shifted[k][0] == matched[k][0] and matched[k][1] <= shifted[k][1] + 0.01 * faces[k] for k in full)


def test_blocks(spark):
    q = blocks.exposed_quads(blocks.cells(spark, 8, size=8, blocks=12, seed=3), 8)
    m = M.Mesh(spark.createDataFrame([], VERTS), q.select("mesh_id", (F.col("cell") * 6 + F.col("side")).alias("face_id"), "verts"))
    bad = M.nonmanifold(m).collect()
    assert len(bad) == 8 and all(r["crowded_edge"] == 0 and r["broken_star"] == 0 for r in bad)
    assert M.edges(m).where("n_faces <> 2").count() == 0


def prints(spark, sizes):
    """Fingerprints of one key with the given sizes, arriving in order; ids fall."""
    rows = [(1000 - i, *([1] * len(D.KEY)), *map(float, s), i) for i, s in enumerate(sizes)]
    return spark.createDataFrame(rows, f"mesh_id long, {', '.join(f'{k} long' for k in D.KEY)}, sx double, sy double, sz double, came long")


def test_dedup_by_arrival_and_in_two_runs(spark, tmp_path):
    rng = np.random.default_rng(6)
    sizes = [(1.0, *sorted(rng.uniform(0.4, 1.0, 2), reverse=True)) for _ in range(300)] + [(1.0, 0.0, 0.0)] * 2
    kept, want = [], {}
    for i, s in enumerate(sizes):
        twin = next((k for k, o in kept if D.close(s, o)), None)
        kept += [] if twin is not None else [(1000 - i, s)]
        want[1000 - i] = 1000 - i if twin is None else twin
    p = prints(spark, sizes)
    assert {r["mesh_id"]: r["keep_id"] for r in D.dedup(p, "came").collect()} == want
    first, second = (D.dedup_with_database(p.where(half), f"{tmp_path}/db", "came").collect() for half in ("came < 120", "came >= 120"))
    assert {r["mesh_id"]: r["keep_id"] for r in first + second} == want
    assert D.dedup_with_database(p, f"{tmp_path}/db", "came").where("mesh_id <> keep_id").count() == len(want) - len(kept)
    assert spark.read.parquet(f"{tmp_path}/db").count() == len(kept)


def test_a_hot_key_is_not_scanned_in_full():
    import time

    import pandas as pd

    rng = np.random.default_rng(7)
    n = 100_000
    rows = pd.DataFrame({"mesh_id": np.arange(n), "sx": 1.0, "sy": rng.uniform(1e-6, 1.0, n) ** 4, "sz": rng.uniform(1e-6, 1.0, n) ** 8, "arrival": np.arange(n), "stored": False})
    began = time.time()
    out = D._greedy(rows)
    assert time.time() - began < 60 and len(out) == n and 1000 < (out["mesh_id"] == out["keep_id"]).sum()


def test_dedup_batch_and_stream(spark, sf, tmp_path):
    from quadrille.streaming.fingerprints import dedup_stream

    p = D.fingerprints(mesh(spark, sf, "part"))
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    p = spark.read.parquet(str(tmp_path / "in"))
    want = {(r["mesh_id"], r["keep_id"]) for r in D.dedup(p).collect()}
    stream = dedup_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("dedup_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["mesh_id"], r["keep_id"]) for r in spark.table("dedup_out").collect()} == want
    kept = {k for _, k in want}
    assert {(r["mesh_id"], r["keep_id"]) for r in D.dedup(p.where(F.col("mesh_id").isin(list(kept)))).collect()} == {(k, k) for k in kept}


# ---- keep rule, nearest triangles, labels ----
KEPT = {"n_faces": 17, "bridge": False, "max_singular_in_face": 2, "max_bend": 60.0, "max_interior_degree": 8, "max_boundary_degree": 3, "n_interior_singular": 1, "size_ratio": 0.21, "fratio_new": 0.6, "min_area_ratio": 0.001, "min_border": 0.02}


def test_dataset_filter_by_clause(spark):
    worse = {"n_faces": 16, "bridge": True, "max_singular_in_face": 3, "max_bend": 60.1, "max_interior_degree": 9, "max_boundary_degree": 4, "n_interior_singular": 0, "size_ratio": 0.2, "fratio_new": 0.59, "min_area_ratio": 0.0009, "min_border": 0.019}
    rows = [(0, *KEPT.values())] + [(1 + i, *{**KEPT, k: v}.values()) for i, (k, v) in enumerate(worse.items())]
    kinds = "mesh_id long, n_faces long, bridge boolean, max_singular_in_face long, max_bend double, max_interior_degree long, max_boundary_degree long, n_interior_singular long, size_ratio double, fratio_new double, min_area_ratio double, min_border double"
    assert [r["mesh_id"] for r in Q.dataset_filter(spark.createDataFrame(rows, kinds)).collect()] == [0]


def test_nearest_triangle(spark):
    rng = np.random.default_rng(8)
    tris, points = rng.normal(size=(40, 3, 3)), rng.normal(size=(30, 3))
    tris[0, 2] = tris[0, 1]  # a flat one
    rows = [(1, i, *(tuple(float(x) for x in p) for p in t)) for i, t in enumerate(tris)]
    point = "struct<x:double,y:double,z:double>"
    t = spark.createDataFrame(rows, f"mesh_id long, item_id long, p0 {point}, p1 {point}, p2 {point}")
    q = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)], "mesh_id long, q_id long, qx double, qy double, qz double")
    got = {r["q_id"]: r["distance"] for r in nearest.nearest_triangle(q, t).collect()}
    u = np.linspace(0, 1, 161)
    a, b = (x.ravel() for x in np.meshgrid(u, u))
    w = np.stack([1 - np.maximum(a, b), np.minimum(a, b), np.abs(a - b)], 1)  # barycentric weights all over a triangle
    for i, p in enumerate(points):
        best = min(np.sqrt((((w @ x) - p) ** 2).sum(1).min()) for x in tris)
        assert got[i] <= best + 1e-9 and got[i] >= best - 0.03


def test_component_labels(spark):
    faces = spark.createDataFrame([(1, 7, [0, 1, 2]), (1, 8, [1, 0, 3]), (1, 3, [4, 5, 6]), (2, 0, [0, 1, 2])], "mesh_id long, face_id long, verts array<long>")
    m = M.Mesh(spark.createDataFrame([], "mesh_id long, v_id long, x double, y double, z double"), faces)
    assert sorted(map(tuple, M.component_labels(m).collect())) == [(1, 3, 0), (1, 7, 1), (1, 8, 1), (2, 0, 0)]


# ---- cut complexes, arcs with direction ----


def ring(n, rows, closed=False, twist=False):
    """A band of quads n around and ``rows`` across; ``closed`` a torus, ``twist`` a band of one row joined half turned."""
    import math

    tube = lambda j: (3 + math.cos(6.28318 * j / rows), math.sin(6.28318 * j / rows)) if closed else (3 + j / 10, j * 1.1)
    pos = [(math.cos(6.28318 * i / n) * tube(j)[0], math.sin(6.28318 * i / n) * tube(j)[0], tube(j)[1]) for i in range(n) for j in range(rows if closed else rows + 1)]
    across = rows if closed else rows + 1
    at = lambda i, j: (i % n) * across + ((1 - j if twist and i == n else j) % across)
    return pos, [(at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)) for i in range(n) for j in range(rows)]


def test_cut_complex_has_four_sided_charts(spark):
    m = M.prepared(build(spark, {1: ring(12, 3), 2: ring(13, 11, closed=True), 3: cube(3)}))
    cut = materialise(arcs.cut_complex(m))
    charts = materialise(L.charts(m, cut))
    corners = materialise(arcs.chart_corners(m, cut, charts))
    per = {(r["mesh_id"], r["chart_id"]): r["count"] for r in corners.groupBy("mesh_id", "chart_id").count().collect()}
    assert set(per.values()) == {4}
    assert [sum(k[0] == i for k in per) for i in (1, 2, 3)] == [2, 4, 6]
    groups = arcs.arc_groups(corners)
    assert {r["mesh_id"]: (r["a"], r["g"]) for r in groups.groupBy("mesh_id").agg(F.countDistinct("arc_id").alias("a"), F.countDistinct("group_id").alias("g")).collect()} == {1: (6, 3), 2: (8, 4), 3: (12, 3)}
    # The second cut of a ring lies opposite to the first.
    axial = cut.where("mesh_id = 1 AND abs(hi - lo) = 1").select(F.expr("lo div 4").alias("i")).distinct().collect()
    assert abs(axial[0]["i"] - axial[1]["i"]) == 6


def test_signed_components_by_hand(spark):
    import random

    rng, links, want = random.Random(3), [], {}
    for mesh_id in range(6):
        way = {n: rng.choice([-1, 1]) for n in range(40)}
        mine = [(mesh_id, a, b, way[a] * way[b]) for a in range(40) for b in range(40) if a % 5 == b % 5 and rng.random() < 0.3]
        links += mine
        for n in {x for _, a, b, _ in mine for x in (a, b)}:
            group = n % 5
            want[mesh_id, n] = (group, way[n] * way[group])
    got = arcs.signed_components(spark.createDataFrame(links, "mesh_id long, a long, b long, sign int"))
    found = {(r["mesh_id"], r["node"]): (r["group_id"], r["sign"]) for r in got.collect()}
    assert {k: v for k, v in want.items() if found[k][0] == v[0]} and found == {k: v if found[k][0] == v[0] else found[k] for k, v in want.items()}
    odd = spark.createDataFrame([(1, 1, 2, 1), (1, 2, 3, 1), (1, 1, 3, -1)], "mesh_id long, a long, b long, sign int")
    with pytest.raises(Exception, match="turns against itself"):
        arcs.signed_components(odd).collect()


def test_arcs_of_a_twisted_band_turn_against_themselves(spark):
    m = M.prepared(build(spark, {1: ring(9, 1, twist=True)}))
    faces = m.faces.select("mesh_id", "face_id", F.col("face_id").alias("chart_id"))
    with pytest.raises(Exception, match="turns against itself"):
        arcs.arc_groups(arcs.chart_corners(m, M.edges(m), faces)).collect()


def test_feature_lines_are_walked_in_order(spark):
    """A lens of two arcs and a chord between two junctions, a closed square, an open chain, and a ring that hangs on one junction."""
    edges = {1: [(0, 5), (5, 1), (0, 6), (6, 1), (0, 1)], 2: [(3, 7), (7, 4), (4, 9), (9, 3)], 3: [(8, 2), (2, 5)], 4: [(0, 1), (1, 2), (2, 3), (3, 1), (1, 9)]}
    rows = [(k, min(e), max(e)) for k, x in edges.items() for e in x]
    got = {}
    for r in arcs.feature_lines(spark.createDataFrame(rows + rows[:2], "mesh_id long, lo long, hi long")).orderBy("pos").collect():
        got.setdefault((r["mesh_id"], r["line"]), []).append(r["v_id"])
    assert sorted((k[0], tuple(v)) for k, v in got.items()) == [(1, (0, 1)), (1, (0, 5, 1)), (1, (0, 6, 1)), (2, (3, 7, 4, 9, 3)), (3, (5, 2, 8)), (4, (0, 1)), (4, (1, 2, 3, 1)), (4, (1, 9))]


def test_derived_meshes_are_dealt_by_id_and_never_broadcast(spark, sf):
    """Joins of derived tables, whose size Spark underrates, do not go through the driver; a partition holds whole meshes, few of them."""
    m = mesh(spark, sf)
    plan = M.edges(m).join(m.vertices.withColumnRenamed("v_id", "lo"), ["mesh_id", "lo"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" not in M.face_components(m).join(m.faces, ["mesh_id", "face_id"])._jdf.queryExecution().executedPlan().toString()
    places = m.faces.select("mesh_id", F.spark_partition_id().alias("p")).distinct()
    assert places.groupBy("mesh_id").count().where("count > 1").isEmpty()
    assert places.select("p").distinct().count() > 1
    used = M.corners(m).select("mesh_id", "v_id").distinct()
    assert m.vertices.select("mesh_id", "v_id").exceptAll(used).isEmpty() and used.exceptAll(m.vertices.select("mesh_id", "v_id")).isEmpty()


def test_generated_code_of_derived_meshes_is_short_enough_to_be_compiled(spark, sf):
    """A generated method of over 8,000 bytes is interpreted by the JVM for good; half-edges took 11,728."""
    m = mesh(spark, sf)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    for table in (M.halfedges(m), M.edges(m), G.face_points(m)):
        code = debug.codegenStringSeq(table.sortWithinPartitions("mesh_id")._jdf.queryExecution().sparkPlan()).iterator()
        while code.hasNext():
            assert code.next()._3().maxMethodCodeSize() < 8_000


def test_links_of_edge_loops_take_one_row_of_fixed_width_a_vertex(spark, sf, monkeypatch):
    """No list of the edges at a vertex is gathered; the links through regular vertices are those of the grid."""
    seen = {}
    monkeypatch.setattr(L, "components_by_mesh", lambda links, **_: seen.setdefault("links", links).select("mesh_id", F.col("a").alias("node"), F.col("b").alias("component")))
    rows = [(1, j * 4 + i, [j * 5 + i, j * 5 + i + 1, j * 5 + i + 6, j * 5 + i + 5]) for j in range(2) for i in range(4)]
    faces = spark.createDataFrame(rows, "mesh_id long, face_id long, verts array<long>")
    L.edge_loops(M.Mesh(faces.selectExpr("mesh_id", "explode(verts) AS v_id").distinct(), faces))
    plan = seen["links"]._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "lambdafunction" not in plan
    found = {(r["a"], r["b"]) for r in seen["links"].where("a <> b").collect()}
    key = lambda a, b: min(a, b) * L.SPAN + max(a, b)
    want = {(key(v - 1, v), key(v, v + 1)) for r in (0, 5, 10) for v in range(r + 1, r + 4)} | {(key(v - 5, v), key(v, v + 5)) for v in range(5, 10)}
    assert found == want


def test_loops_of_one_length_turn_at_once(spark):
    """The same figures as one by one, closed or open, flat or short."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7):
        p = rng.normal(size=(5, n, 3))
        for closed in (False, True):
            one = [rotation.rotation_index(x, closed) for x in p]
            assert np.allclose(rotation.rotation_indices(p, closed), one, atol=1e-9)
    ring = np.array([[np.cos(t), np.sin(t), 0.0] for t in np.linspace(0, 2 * np.pi, 12, endpoint=False)])
    assert np.allclose(rotation.rotation_indices(np.stack([ring, ring * 3]), True), 1.0)


def test_kernels_take_many_meshes_at_a_time(spark):
    """Meshes reach Python many to a batch; one that a table lacks gives an empty frame, and nulls keep their rows."""
    from quadrille.operators.kernels.base import by_mesh

    left = spark.createDataFrame([(i, j, None if j else float(i)) for i in range(50) for j in range(i % 3 + 1)], "mesh_id long, n long, x double")
    right = spark.createDataFrame([(i, [i, i]) for i in range(25, 75)], "mesh_id long, verts array<long>")

    def run(a, b):
        known = a if len(a) else b
        return pd.DataFrame({"mesh_id": [known["mesh_id"].iloc[0]], "rows": [len(a)], "missing": [int(a["x"].isna().sum()) if len(a) else -1], "verts": [list(b["verts"].iloc[0]) if len(b) else None]})

    out = by_mesh(run, "mesh_id long, rows long, missing long, verts array<long>", left, right)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString() and "FlatMapCoGroups" not in out._jdf.queryExecution().toString()
    got = {r["mesh_id"]: (r["rows"], r["missing"], r["verts"]) for r in out.collect()}
    assert got == {i: (i % 3 + 1 if i < 50 else 0, i % 3 if i < 50 else -1, [i, i] if i >= 25 else None) for i in range(75)}


def test_principal_axes_of_many_meshes_at_once(spark):
    """Frames and sides of a batch equal those of each mesh alone, a single point and a line among them."""
    rng = np.random.default_rng(11)
    points = {i: rng.normal(size=(n, 3)) * (3, 2, 1) for i, n in enumerate([40, 1, 25, 3, 60] * 8)} | {90: np.array([[0.0, 0, 0], [1, 2, 3], [2, 4, 6]])}
    m = M.Mesh(spark.createDataFrame([(i, k, *map(float, p)) for i, x in points.items() for k, p in enumerate(x)], VERTS), spark.createDataFrame([], FACES))
    frame, sides = D.principal_frame(m), D.principal_sides(m)
    for df in (frame, sides):
        assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    sides = {r["mesh_id"]: (r["sx"], r["sy"], r["sz"]) for r in sides.collect()}
    got = {(r["mesh_id"], r["v_id"]): (r["x"], r["y"], r["z"]) for r in frame.collect()}
    assert sides.keys() == points.keys() and len(got) == sum(map(len, points.values()))
    for i, p in points.items():
        x = p - p.mean(0)
        axes = np.linalg.eigh(x.T @ x)[1]
        side = np.sort(np.ptp(x @ axes, axis=0))[::-1]
        assert np.allclose(sides[i], side / side[0] if side[0] > 0 else side, atol=1e-7)
        axes = axes[:, ::-1] * np.where(axes[:, ::-1][np.abs(axes[:, ::-1]).argmax(0), range(3)] < 0, -1, 1)
        want = x @ axes / max(np.linalg.norm(x, axis=1).max(), 1e-300)
        found = np.array([got[i, k] for k in range(len(p))])
        assert np.allclose(np.abs(found) if i == 90 else found, np.abs(want) if i == 90 else want, atol=1e-7)


def test_topology_and_fingerprints_make_the_edges_once(spark, sf):
    m = mesh(spark, sf)
    for df in (M.topology(m), D.fingerprints(m)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") == 1


def test_components_of_dealt_meshes_stay_in_place(spark, sf, monkeypatch):
    """Links that lie by mesh are labelled without a shuffle, as they are in buckets."""
    from quadrille.functions import local_components

    m = mesh(spark, sf)
    links = M.face_adjacency(m).where("face_id % 3 > 0").select("mesh_id", F.col("face_id").alias("a"), F.col("across").alias("b"))
    want = {tuple(r) for r in components_by_mesh(links).collect()}
    seen = []
    monkeypatch.setattr(local_components, "materialise", lambda df: seen.append(df) or materialise(df))
    assert {tuple(r) for r in components_by_mesh(links, parts=m.parts).collect()} == want
    assert [df.columns for df in seen] == [["mesh_id", "node", "component"]]  # labels are written, not links
    assert [df._jdf.queryExecution().toString().count("Exchange hashpartitioning") for df in seen] == [links._jdf.queryExecution().toString().count("Exchange hashpartitioning")]


def test_samples_and_files_are_made_where_the_meshes_lie(spark, sf):
    """No shuffle but the dealing of the meshes, and nothing written in between."""
    from quadrille.sources import formats
    from quadrille.sources.meshes import files

    m = mesh(spark, sf)
    for df in (sampling.poisson_samples(m, 16), files(m, "off", "stl")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMap" not in plan and "quadrille-" not in plan
        assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    # Ids with gaps are made dense, in any number of meshes; a mesh may lack faces.
    v = spark.createDataFrame([(i, 10 * k + i, float(k), 0.1, -2.5e-7 * i) for i in range(9) for k in (3, 0, 1, 2)], VERTS)
    f = spark.createDataFrame([(i, j, [10 * k + i for k in (0, 1, 2 + j)]) for i in range(1, 9) for j in (1, 0)], FACES)
    got = {r["mesh_id"]: formats.decode(r["name"], bytes(r["content"])) for r in files(M.Mesh(v, f), "obj").collect()}
    assert got.keys() == set(range(9))
    for i, (x, faces) in got.items():
        assert np.allclose(x, [[float(k), 0.1, -2.5e-7 * i] for k in range(4)], rtol=1e-15, atol=0) and faces == ([[0, 1, 2], [0, 1, 3]] if i else [])


def test_cluster_sets_of_edges_gather_no_lists(spark, sf):
    """Sets of vertices are taken as bits in rows of fixed width, without a gathered set that is sorted or a broadcast; every edge stays."""
    from quadrille.plans.queries_mesh import QUERIES

    found = QUERIES["m3_u2_cluster_sets"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Broadcast" not in plan and plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    ends, at = {}, {}
    for r in mesh(spark, sf).faces.collect():
        for v, w in zip(r["verts"], r["verts"][1:] + r["verts"][:1], strict=True):
            ends[r["mesh_id"], min(v, w), max(v, w)] = True
            at.setdefault((r["mesh_id"], v), set()).add(r["face_id"] % 5)
    want = {(m, a, b, ",".join(map(str, sorted(at[m, a] & at[m, b] or at[m, a] | at[m, b])))) for m, a, b in ends}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_vertex_star_gathers_corners_once(spark, sf):
    """Faces and ring come of one list of corners, without edges and a join; repeated corners count as they do along the edges."""
    plan = M.vertex_star(mesh(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "Join" not in plan
    faces = {1: [[0, 1, 4, 3], [1, 2, 5, 4]], 2: [[3, 3, 7], [7, 3, 9, 3]], 3: [[5]], 4: [[2, 8], [8, 2, 1]], 5: [*cube(2)[1]]}
    got = {(r["mesh_id"], r["v_id"]): (r["faces"], r["ring"]) for r in M.vertex_star(build(spark, {m: ([], f) for m, f in faces.items()})).collect()}
    want = {}
    for m, found in faces.items():
        sides = {(min(e), max(e)) for f in found for e in zip(f, [*f[1:], f[0]], strict=True)}
        for v in {v for f in found for v in f}:
            want[m, v] = sorted(i for i, f in enumerate(found) for x in f if x == v), sorted([b for a, b in sides if a == v] + [a for a, b in sides if b == v])
    assert got == want


def test_whole_topology_counts_components_boundaries_and_genus(spark, sf):
    """Kinds of derived meshes by their shape, and two cubes of one mesh as two components."""
    from quadrille.plans.queries_mesh import QUERIES

    t = {r["mesh_id"]: (r["n_components"], r["n_boundaries"], r["genus"]) for r in QUERIES["mesh_topology_large"](spark, sf).collect()}
    for r in dims(spark, sf, "part").collect():
        assert t[r["mesh_id"]] == {0: (1, 1, 0), 1: (1, 2, 0), 2: (1, 0, 1), 3: (1, 2, 0)}[r["kind"]]
    two = M.concatenated(build(spark, {1: cube(1), 2: cube(2)}), F.lit(0).cast("long"))
    r = M.whole_topology(two).first()
    assert (r["n_components"], r["n_boundaries"], r["genus"], r["euler"]) == (2, 0, 0, 4)


def test_exploded_meshes_are_never_broadcast_and_other_queries_keep_the_threshold(spark, sf):
    """Joins behind joins and unions carry no hint; the session's own threshold comes back for the queries of other tables."""
    from quadrille.functions.shared import guessed_broadcasts
    from quadrille.plans.queries_mesh import QUERIES

    guessed_broadcasts(spark)
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in ("m1_catmull_clark", "m2_split_topology", "m2_split_quads"):
        assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString(), name
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    guessed_broadcasts(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == own != "-1"


def test_faces_split_in_place_as_by_joins(spark, sf):
    """Dealt meshes are cut many at a time, with the ids that joins give; also polygons of other sizes and gaps in the ids."""
    rows = lambda m: {(r["mesh_id"], r["face_id"]): list(r["verts"]) for r in S.split_quads(m).faces.collect()}
    m = mesh(spark, sf)
    assert "BatchEvalPython" not in (plan := S.split_quads(m).faces._jdf.queryExecution().sparkPlan().toString()) and "MapInArrow" in plan
    odd = M.Mesh(m.vertices, m.faces.where("face_id % 5 <> 2").selectExpr("mesh_id", "face_id", "IF(face_id % 4 = 1, slice(verts, 1, 3), verts) AS verts"), parts=m.parts)
    for x in (m, odd):
        assert rows(x) == rows(M.Mesh(x.vertices, x.faces))
