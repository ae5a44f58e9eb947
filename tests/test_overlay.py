"""Overlaid labels with absorption, and components that only welding saves, against doing it by hand."""

from collections import defaultdict

from pyspark.sql import functions as F

from quadrille.operators import mesh as M
from quadrille.operators import spatial as X
from quadrille.operators.overlay import absorb, overlay, overlay_labels
from tests.test_meshes import build, cube, ring


def absorbed_by_hand(faces, area, labels, wanted):
    """Clusters by walking, then rounds of joining the best-ranked neighbour that is in."""
    at = defaultdict(list)
    for i, f in enumerate(faces):
        for a, b in zip(f, f[1:] + f[:1]):
            at[min(a, b), max(a, b)].append(i)
    near = defaultdict(set)
    for fs in at.values():
        for x in fs:
            near[x] |= {y for y in fs if y != x}
    cluster = {}
    for i in range(len(faces)):
        if i not in cluster:
            work = [i]
            cluster[i] = i
            for x in work:
                for y in near[x]:
                    if y not in cluster and labels[y] == labels[x]:
                        cluster[y] = i
                        work.append(y)
    size = defaultdict(float)
    for i, c in cluster.items():
        size[c] += area[i]
    order = sorted(size, key=lambda c: (-round(size[c], 9), c))
    rank = {c: k for k, c in enumerate(order)}
    label = {c: k for c, k in rank.items() if k < wanted}
    while True:
        new = {}
        for c in order:
            if c not in label:
                inside = [cluster[y] for x in cluster if cluster[x] == c for y in near[x] if cluster[y] in label]
                if inside:
                    new[c] = label[min(inside, key=rank.get)]
        if not new:
            return cluster, {i: label.get(c, -1) for i, c in cluster.items()}
        label |= new


def test_overlay_labels(spark):
    import random

    import numpy as np

    rng = random.Random(9)
    shapes = {1: cube(5), 2: ring(14, 6), 3: ring(9, 2)}
    shapes[4] = ([*cube(2)[0], *[(x + 9, y, z) for x, y, z in cube(1)[0]]], [*map(tuple, cube(2)[1]), *(tuple(v + len(cube(2)[0]) for v in f) for f in cube(1)[1])])
    m = build(spark, shapes)
    labels = {k: [(rng.randrange(2), rng.randrange(3)) for _ in f] for k, (_, f) in shapes.items()}
    frame = spark.createDataFrame([(k, i, a, b) for k, x in labels.items() for i, (a, b) in enumerate(x)], "mesh_id long, face_id long, a int, b int")
    clusters = {(r["mesh_id"], r["face_id"]): r["cluster"] for r in overlay(m, frame).collect()}
    few = spark.createDataFrame([(k, 1 + k % 2) for k in shapes], "mesh_id long, n long")
    got = {(r["mesh_id"], r["face_id"]): r["label"] for r in absorb(m, overlay(m, frame), few).collect()}
    whole = {(r["mesh_id"], r["face_id"]): r["label"] for r in overlay_labels(m, frame, 2).collect()}
    for k, (pos, faces) in shapes.items():
        pos, faces = np.array(pos, float), [list(map(int, f)) for f in faces]
        area = [float(np.linalg.norm(sum(np.cross(pos[f[j]], pos[f[(j + 1) % 4]]) for j in range(4))) / 2) for f in faces]
        for have, wanted in ((got, 1 + k % 2), (whole, 2 * len({a for a, _ in labels[k]}))):
            by_hand, want = absorbed_by_hand(faces, area, labels[k], wanted)
            assert {i: clusters[k, i] for i in range(len(faces))} == by_hand
            assert {i: have[k, i] for i in range(len(faces))} == want, k
    assert -1 in {got[4, i] for i in range(len(shapes[4][1]))} | {0} and len(got) == sum(len(f) for _, f in shapes.values())


def test_only_welding_saves_a_slit_tube(spark):
    pos, faces = ring(8, 4)
    slit_pos = [*pos, *pos[:5]]
    slit = [tuple(v + len(pos) if i // 4 == 7 and v < 5 and v != 2 else v for v in f) for i, f in enumerate(faces)]
    crossed = ([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, -1, 0)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)])
    m = M.prepared(build(spark, {1: (slit_pos, slit), 2: (pos, faces), 3: crossed}))
    count = lambda out: {r["mesh_id"]: r["count"] for r in out.faces.groupBy("mesh_id").count().collect()}
    assert count(X.manifold_part(m)) == {2: 32}
    saved = X.manifold_part(m, retry=True)
    assert count(saved) == {1: 32, 2: 32}
    whole = M.edges(saved).where("mesh_id = 1").agg(F.count_if(F.col("n_faces") == 1).alias("rim"), F.count_if(F.col("n_faces") == 2).alias("inner")).first()
    assert (whole["rim"], whole["inner"]) == (16, 8 * 3 + 32)
    assert count(X.manifold_merge(m, fast=False)) == {1: 32, 2: 32}
