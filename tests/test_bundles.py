"""Tensor bundles written and read again by the data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import geometry as G
from quadrille.operators import mesh as M
from quadrille.sources import bundles
from tests.test_meshes import build, cube, ring


@pytest.mark.parametrize("kind", ["npz", "bin"])
def test_objects_round_trip(spark, tmp_path, kind):
    shapes = {k: (cube(1 + k % 2) if k % 3 else ring(5, 2)) for k in range(9)}
    m = build(spark, shapes)
    m = M.Mesh(m.vertices, G.quads_to_triangles(m))
    bundles.write(bundles.objects(m, F.col("mesh_id") % 4), f"{tmp_path}/b", kind)
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == [f"{i}.{kind}" for i in range(4)]
    v, f = bundles.meshes(bundles.read(spark, f"file://{tmp_path}/b"))
    found = {(r["bundle"], r["object"], r["v_id"]): (r["x"], r["y"], r["z"]) for r in v.collect()}
    for k, (pos, _) in shapes.items():
        for i, p in enumerate(pos):
            assert np.allclose(found[str(k % 4), k // 4, i], p, atol=1e-6 if kind == "bin" else 0)
    assert len(found) == sum(len(p) for p, _ in shapes.values())
    want = {(str(r["mesh_id"] % 4), r["mesh_id"] // 4, tuple(r["verts"])) for r in m.faces.collect()}
    assert {(r["bundle"], r["object"], tuple(r["verts"])) for r in f.collect()} == want


def test_fields_are_held_and_checked(spark, tmp_path):
    np.savez(tmp_path / "a.npz", cdf=np.array([-0.5, 0.5, 1.5]), dcdf=np.array([0.0, 0.25, 2.0]), offset=np.ones((3, 3)), invT=np.eye(4))
    (tmp_path / "empty.npz").write_bytes(b"")
    t = bundles.read(spark, str(tmp_path))
    assert {(r["tensor"], r["count"]) for r in t.groupBy("tensor").count().collect()} == {("cdf", 3), ("dcdf", 3), ("offset", 3), ("invT", 4)}
    sizes = lambda v, f: spark.createDataFrame([("a", v, f)], "bundle string, n_vertices long, n_faces long")
    for fits in ((7, 3), (2, 1)):
        rows = {r["row"]: (r["cdf"], r["dcdf"], r["offset"], r["offsetc"]) for r in bundles.fields(t, sizes(*fits)).collect()}
        assert rows == {0: (0.0, 0.0, [1.0] * 3, None), 1: (0.5, 0.25, [1.0] * 3, None), 2: (1.0, 1.0, [1.0] * 3, None)}
    with pytest.raises(Exception, match="do not fit"):
        bundles.fields(t, sizes(1, 1)).collect()
