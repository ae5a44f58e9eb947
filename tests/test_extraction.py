"""Chart splitting, re-tiling and quad extraction against closed forms and brute force."""

import numpy as np
import pytest
from test_meshes import build, cube

from quadrille.operators import loops as L
from quadrille.operators.kernels import blocks, charts, clusters, extraction, tiling
from quadrille.operators.kernels.base import edge_faces


def ring(n, r=1.0):
    a = np.linspace(0, 2 * np.pi, n + 1)[:-1]
    return np.c_[r * np.cos(a), r * np.sin(a), 0 * a]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_cube_charts_halve(n):
    """Six charts of n by n: 12 arcs, one ring each way and chart cut, so (n + 1)^2 quads a side on a closed surface."""
    pos, faces = cube(n)
    p, chart = np.array(pos, float), [i // (n * n) for i in range(len(faces))]
    assert len(charts.arcs(faces, chart)) == 12
    cuts = charts.splits(p, faces, chart)
    points, new, parent, kept = charts.cut(p, faces, cuts)
    assert len(new) == 6 * (n + 1) ** 2 and {len(f) for f in new} == {4} and kept == len(pos)
    e = edge_faces(new)
    assert {len(x) for x in e.values()} == {2} and len({v for f in new for v in f}) - len(e) + len(new) == 2
    assert len(points) == len({v for f in new for v in f}) and sorted(set(parent)) == list(range(len(faces)))
    if n % 2:
        assert all(abs(s - 0.5) < 1e-9 for s in cuts.values())


def test_cut_takes_points_into_other_faces():
    """A triangle beside a cut quad gets the inserted point as a corner."""
    pos = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (2, 0.5, 0)], float)
    _, new, parent, _ = charts.cut(pos, [[0, 1, 2, 3], [1, 4, 2]], charts.splits(pos, [[0, 1, 2, 3], [1, 4, 2]], [0, 1]))
    assert [len(f) for f, p in zip(new, parent, strict=True) if p == 0] == [4] * 4
    # Its other two sides form an arc of their own, cut at one of them.
    assert [len(f) for f, p in zip(new, parent, strict=True) if p == 1][0] >= 4


def test_diagonals_alternate(spark):
    """In a grid all diagonals meet neighbours' ends: every interior vertex has 4 or 8 triangles."""
    n = 5
    pos = [(i, j, 0) for i in range(n + 1) for j in range(n + 1)]
    faces = [[i * (n + 1) + j, (i + 1) * (n + 1) + j, (i + 1) * (n + 1) + j + 1, i * (n + 1) + j + 1] for i in range(n) for j in range(n)]
    m = build(spark, {0: (pos, faces)})
    rows = charts.alternating_triangles(m, m.faces.selectExpr("mesh_id", "face_id", "0L AS chart_id")).collect()
    assert len(rows) == 2 * n * n and len({r["face_id"] for r in rows}) == len(rows)
    met = {}
    for r in rows:
        for v in r["verts"]:
            met[v] = met.get(v, 0) + 1
    assert {met[i * (n + 1) + j] for i in range(1, n) for j in range(1, n)} == {4, 8}


def test_even_polygons_hexagons_and_flanked_hexagons():
    t = tiling.Tiling(ring(8), [list(range(8))])
    assert tiling.retile(t)["fan"] == 1 and sorted(len(f) for f in t.faces.values()) == [4] * 4 and len(set.intersection(*map(set, t.faces.values()))) == 1
    t = tiling.Tiling(ring(6), [list(range(6))])
    assert tiling.retile(t)["hexagon"] == 1 and sorted(len(f) for f in t.faces.values()) == [4, 4]
    pos = np.array([(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 1, 0), (1, 1, 0), (0, 1, 0), (1, -0.5, 0), (1, 1.5, 0)], float)
    t = tiling.Tiling(pos, [[0, 1, 2, 3, 4, 5], [0, 6, 2, 1], [3, 7, 5, 4]])
    assert tiling.retile(t)["flanked"] == 1 and len(t.faces) == 2 and 1 not in t.at and 4 not in t.at


@pytest.mark.parametrize("f,g", [([0, 1, 2, 3, 4], [2, 1, 5]), ([4, 3, 2, 1, 0], [5, 1, 2]), ([0, 1, 2, 3, 4], [1, 2, 5])])
def test_pentagon_and_triangle(f, g):
    pos = np.array([(0, 0, 0), (1, 0, 0), (1, 1, 0), (0.5, 1.5, 0), (0, 1, 0), (1.6, 0.5, 0)], float)
    t = tiling.Tiling(pos, [f, g])
    assert tiling.retile(t)["pentagon"] == 1
    assert sorted(len(x) for x in t.faces.values()) == [4, 4] and {v for x in t.faces.values() for v in x} == set(range(6))


def test_degree_six_keeps_the_surface():
    """Whatever is chosen, the outline of the region and its manifoldness stay, and skew does not rise."""
    rng, applied = np.random.default_rng(5), 0
    for _ in range(200):
        spokes, far = ring(6) * rng.uniform(0.3, 2, (6, 1)), ring(6) @ [[0.866, 0.5, 0], [-0.5, 0.866, 0], [0, 0, 1]] * rng.uniform(0.8, 3, (6, 1))
        pos = np.concatenate([np.zeros((1, 3)), np.stack([spokes, far], 1).reshape(12, 3)])
        faces = [[0, 1 + 2 * j, 2 + 2 * j, 1 + 2 * ((j + 1) % 6)] for j in range(6)]
        t = tiling.Tiling(pos, faces)
        before = np.mean([t.skew(f) for f in faces])
        if not tiling._degree_six(t, 0):
            continue
        applied += 1
        new = list(t.faces.values())
        assert len(new) == 7 and np.mean([t.skew(f) for f in new]) <= before + 1e-6
        rim = lambda fs: {e for e, x in edge_faces(fs).items() if len(x) == 1}
        assert rim(new) == rim(faces) and max(map(len, edge_faces(new).values())) == 2
        sides = [(a, b) for f in new for a, b in zip(f, f[1:] + f[:1], strict=True)]
        assert len(set(sides)) == len(sides)  # one winding throughout
    assert applied


def test_collapse_draws_short_edges_and_keeps_topology():
    """A hexagonal tiling of the plane with some edges made short: those go, the rest of the disc stays one."""
    pos, ids, faces = [], {}, []

    def at(x, y):
        k = (round(x, 6), round(y, 6))
        if k not in ids:
            ids[k] = len(pos)
            pos.append((x, y, 0.0))
        return ids[k]

    for i in range(4):
        for j in range(4):
            cx, cy = 3 ** 0.5 * (i + (j % 2) / 2), 1.5 * j
            faces.append([at(cx + np.cos(np.pi / 6 + k * np.pi / 3), cy + np.sin(np.pi / 6 + k * np.pi / 3)) for k in range(6)])
    t = tiling.Tiling(np.array(pos), faces)
    euler = lambda: len(t.at) - len(t.edges()) + len(t.faces)
    assert euler() == 1
    assert tiling.collapse_edges(t) > 0
    assert euler() == 1 and max(len(t.beside(*e)) for e in t.edges()) == 2 and min(len(set(f)) for f in t.faces.values()) >= 3
    assert all(len(set(f)) == len(f) for f in t.faces.values())


def test_collapse_leaves_fixed_quads_and_pinched_polygons():
    t = tiling.Tiling(ring(4), [[0, 1, 2, 3]])
    assert tiling.collapse_edges(t) == 0
    t = tiling.Tiling(ring(6), [[0, 1, 2, 0, 3, 4]] * 2 + [[0, 1, 2]] * 5)
    assert tiling.collapse_edges(t) == 0
    assert tiling.retile(tiling.Tiling(np.zeros((0, 3)), [])) == dict.fromkeys(("flanked", "fan", "hexagon", "triangles", "pentagon", "six"), 0)


def test_nearest_on_triangles_against_samples():
    """No sampled position of any triangle is nearer than the one found, which lies on a triangle."""
    rng = np.random.default_rng(3)
    tri, p = rng.normal(size=(12, 3, 3)), rng.normal(size=(40, 3)) * 2
    tri[3, 1] = tri[3, 0]  # a triangle without area
    found = extraction.nearest_on(p, tri)
    w = rng.dirichlet([0.5] * 3, 6000)
    dense = np.einsum("sk,tkd->tsd", w, tri).reshape(-1, 3)
    best = np.sqrt(((p[:, None] - dense[None]) ** 2).sum(2)).min(1)
    got = np.linalg.norm(found - p, axis=1)
    assert (got <= best + 1e-9).all() and (best - got < 0.3).all()
    assert np.allclose(extraction.nearest_on(found, tri), found, atol=1e-9)


def test_vertex_clusters_and_runs(spark):
    assert extraction.runs([1, 1, 2, 2, 1]) == [2, 1]
    assert extraction.runs([3, 3]) == [3]
    pos, faces = cube(2)
    m = build(spark, {0: (pos, faces)})
    whole = extraction.vertex_clusters(m, m.faces.selectExpr("mesh_id", "face_id", "0L AS cluster")).collect()
    assert len(whole) == 26 and all(r["clusters"] == [0] and r["manifold"] for r in whole)
    sides = extraction.vertex_clusters(m, m.faces.selectExpr("mesh_id", "face_id", "face_id div 4 AS cluster")).collect()
    assert sorted(len(r["clusters"]) for r in sides) == [1] * 6 + [2] * 12 + [3] * 8


def test_dual_and_polygons_of_a_cube(spark):
    """Sides as clusters: six polygons of four corners; the dual is an octahedron."""
    m = build(spark, {0: cube(3)})
    labels = m.faces.selectExpr("mesh_id", "face_id", "face_id div 9 AS cluster")
    p = extraction.polygon_mesh(m, labels).faces.collect()
    assert sorted(len(r["verts"]) for r in p) == [4] * 6
    d = extraction.dual_mesh(m, labels)
    assert d.vertices.count() == 6 and sorted(len(r["verts"]) for r in d.faces.collect()) == [3] * 8


def test_extract_cube(spark):
    """Fields that peak in the middle of every side bring back the six sides, each split in four, on the cube."""
    m = build(spark, {7: cube(5)})
    field = clusters.chart_fields(m, m.faces.selectExpr("mesh_id", "face_id", "face_id div 25 AS chart_id"))
    q = extraction.extract_quads(m, field)
    assert q.faces.count() == 24
    xyz = np.array([(r["x"], r["y"], r["z"]) for r in q.vertices.collect()])
    assert len(xyz) == 26 and np.allclose(np.minimum(xyz, 5 - xyz).min(1), 0, atol=1e-9)


def test_points_at(spark):
    rows = [(0, 0, i, 10 + i, float(x), 0.0, 0.0) for i, x in enumerate((0, 1, 2, 6, 12))]
    path = spark.createDataFrame(rows, "mesh_id long, loop_id long, pos long, v_id long, x double, y double, z double")
    r = L.points_at(path, third=1 / 3, middle=0.5).collect()
    assert [tuple(x) for x in r] == [(0, 0, 12.0, 13, 13)]


def test_tunnels():
    for seed in range(8):
        plain, dug = (set(blocks.grow_cells(8, 40, seed, n)) for n in (0, 6))
        assert dug <= plain and dug and not blocks._contacts(dug) and blocks._whole(dug)


def test_framed_edges_of_a_square_tube(spark):
    """No vertex is singular, so the base complex is empty; borders and the four corner lines frame four charts."""
    pos = [(*xy, z) for z in range(4) for xy in ((0, 0), (1, 0), (1, 1), (0, 1))]
    faces = [[4 * z + k, 4 * z + (k + 1) % 4, 4 * z + 4 + (k + 1) % 4, 4 * z + 4 + k] for z in range(3) for k in range(4)]
    m = build(spark, {0: (pos, faces)})
    assert L.complex_edges(m).count() == 0
    framed = L.framed_edges(m)
    assert framed.count() == 12 + 8
    assert L.charts(m, framed).select("chart_id").distinct().count() == 4
    assert L.framed_edges(m, sharp=10.0).where("n_faces = 2").count() == 0


def test_chart_fields_fall_from_the_middle_in_both_directions(spark):
    """A chart of 3 by 5 unit quads beside one of 1 by 5; a ring of quads in one chart is at its middle all the way round."""
    pos = [(x, y, 0) for x in range(5) for y in range(6)]
    faces = [[6 * i + j, 6 * i + j + 6, 6 * i + j + 7, 6 * i + j + 1] for i in range(4) for j in range(5)]
    ring = [(*xy, z) for z in range(4) for xy in ((0, 0), (1, 0), (1, 1), (0, 1))]
    tube = [[4 * z + k, 4 * z + (k + 1) % 4, 4 * z + 4 + (k + 1) % 4, 4 * z + 4 + k] for z in range(3) for k in range(4)]
    m = build(spark, {0: (pos, faces), 1: (ring, tube)})
    label = m.faces.selectExpr("mesh_id", "face_id", "IF(mesh_id = 0 AND face_id >= 15, 1L, 0L) AS chart_id")
    got = {(r["mesh_id"], r["face_id"]): (r["cdf"], r["dcdf"]) for r in clusters.chart_fields(m, label).collect()}
    for i in range(4):
        for j in range(5):
            c0, c1 = abs(2 * (i + 0.5) / 3 - 1) if i < 3 else 0.0, abs(2 * (j + 0.5) / 5 - 1)
            assert np.allclose(got[0, 5 * i + j], (min(1 - c0, 1 - c1), min(c0, c1)))
    for z in range(3):
        for k in range(4):
            assert np.allclose(got[1, 4 * z + k], (1 - abs(2 * (z + 0.5) / 3 - 1), 0))


def test_chart_fields_query_depends_on_charts(spark, sf):
    from quadrille.plans.queries_kernels import QUERIES

    rows = QUERIES["n7_n10_chart_fields"](spark, sf).collect()
    assert len({r["cdf"] for r in rows}) > 5 and any(0 < r["dcdf"] < r["cdf"] for r in rows)
