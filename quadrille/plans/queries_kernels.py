"""Queries of the order-dependent kernels, formats and generators; SQL only where closed forms exist."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quadrille.functions.local_components import components_by_mesh
from quadrille.functions.shared import materialise, shared_dir
from quadrille.operators import arcs as A
from quadrille.operators import dedup as D
from quadrille.operators import geometry as G
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators import overlay as O
from quadrille.operators import spatial as X
from quadrille.operators.kernels import blocks, clusters, rotation, sampling, trimerge
from quadrille.plans.derived import BENDS, SIDES, mesh, sql_prefix
from quadrille.plans.queries_mesh import r6
from quadrille.sources import bundles, formats
from quadrille.sources.meshes import files

PART = sql_prefix("part")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def triangles(spark, d, source="part"):
    m = mesh(spark, d, source)
    return M.Mesh(m.vertices, G.quads_to_triangles(m))


@query("a11_edge_loop_rotation")
def a11(spark, d):
    r = rotation.edge_loop_rotation(mesh(spark, d))
    return r.select("mesh_id", "loop_id", "closed", F.round("rotation", 4).alias("rotation"))


@query("a11_face_loop_rotation")
def a11_faces(spark, d):
    r = rotation.face_loop_rotation(mesh(spark, d))
    return r.select("mesh_id", "loop_id", "closed", F.round("rotation", 4).alias("rotation"))


@query("a7_a8_loop_ratios")
def a7(spark, d):
    m = M.prepared(mesh(spark, d))
    f = rotation.loop_ratios(L.face_loop_stats(m), rotation.face_loop_rotation(m), "f")
    e = rotation.loop_ratios(L.edge_loop_stats(m), rotation.edge_loop_rotation(m), "e")
    return f.join(e, "mesh_id").select("mesh_id", *(r6(F.col(c)).alias(c) for c in ("fratio", "fspiral", "eratio", "espiral")))


@query("a20_loop_summary")
def a20(spark, d):
    """Weight-averaged rotation of the edge loops of every mesh."""
    m = M.prepared(mesh(spark, d))
    r = L.edge_loop_stats(m).join(rotation.edge_loop_rotation(m), ["mesh_id", "loop_id"])
    return r.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_loops"), r6(F.sum(F.col("weight") * F.col("rotation")) / F.sum("weight")).alias("rotation"))


@query("l1_poisson_samples")
def l1(spark, d):
    return sampling.poisson_samples(mesh(spark, d), 64).select("mesh_id", "s_id", "tri_id", r6(F.col("b0")).alias("b0"), r6(F.col("b1")).alias("b1"))


@query("a14_fingerprints")
def a14(spark, d):
    p = D.fingerprints(mesh(spark, d))
    return p.select("mesh_id", *D.KEY, *(r6(F.col(c)).alias(c) for c in ("sx", "sy", "sz")))


@query("l2_dedup")
def l2(spark, d):
    return D.dedup(D.fingerprints(mesh(spark, d)))


@query("m9_principal_frame")
def m9(spark, d):
    return D.principal_frame(mesh(spark, d)).select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("n1_n2_grow_quads")
def n1(spark, d):
    q = trimerge.to_quads(triangles(spark, d), "grow")
    return q.groupBy("mesh_id").agg(F.count_if(F.size("verts") == 4).alias("quads"), F.count_if(F.size("verts") == 3).alias("triangles"))


@query("n2_shifted_quads")
def n2(spark, d):
    """Growth alone, and with its repair: what is left over, and vertices of degree 2 inside."""
    t = M.prepared(triangles(spark, d))
    left = lambda q, name: q.groupBy("mesh_id").agg(F.count_if(F.size("verts") == 3).alias(name))
    shifted = M.Mesh(t.vertices, materialise(trimerge.to_quads(t, "shift")))
    two = M.vertex_facts(M.edges(shifted)).groupBy("mesh_id").agg(F.count_if((F.col("degree") == 2) & ~F.col("boundary")).alias("degree_two"))
    return left(trimerge.to_quads(t, "grow"), "grown").join(left(shifted.faces, "shifted"), "mesh_id").join(two, "mesh_id")


@query("n4_match_quads")
def n4(spark, d):
    """Perfect matchings of least weight; a mesh that has none keeps its triangles."""
    q = trimerge.to_quads(triangles(spark, d), "match")
    return q.groupBy("mesh_id").agg(F.count_if(F.size("verts") == 4).alias("quads"), F.count_if(F.size("verts") == 3).alias("triangles"))


@query("n6_loop_quad_pipeline")
def n6(spark, d):
    """Triangles to quads, kept where every face became one, then deduplicated by fingerprint."""
    t = M.compacted(triangles(spark, d))
    q = trimerge.to_quads(t, "both")
    pure = q.groupBy("mesh_id").agg(F.every(F.size("verts") == 4).alias("pure")).where("pure").select("mesh_id")
    m = M.Mesh(t.vertices.join(pure, "mesh_id", "left_semi"), q.join(pure, "mesh_id", "left_semi"))
    return D.dedup(D.fingerprints(m))


@query("n25_block_solids")
def n25(spark, d):
    """Exposed quads of seeded solids, with topology; closed surfaces have an even Euler number."""
    q = blocks.exposed_quads(blocks.cells(spark, 24), 8)
    faces = q.select("mesh_id", (F.col("cell") * 6 + F.col("side")).alias("face_id"), "verts")
    v = q.select("mesh_id", F.explode("verts").alias("v_id")).distinct().select("mesh_id", "v_id", *(F.lit(0.0).alias(c) for c in "xyz"))
    return M.topology(M.Mesh(v, faces)).select("mesh_id", "n_vertices", "n_edges", "n_faces", "n_boundary_edges", "euler")


@query("n7_n10_chart_fields")
def n7(spark, d):
    m = mesh(spark, d)
    f = clusters.chart_fields(m, L.charts(m))
    return f.select("mesh_id", "face_id", "chart_id", r6(F.col("cdf")).alias("cdf"), r6(F.col("dcdf")).alias("dcdf"))


def _seeds(m):
    c = L.charts(m)
    return clusters.seed_faces(m, clusters.chart_fields(m, c))


@query("n11_seed_faces")
def n11(spark, d):
    return _seeds(mesh(spark, d))


@query("n12_cluster_growth")
def n12(spark, d):
    m = mesh(spark, d)
    return clusters.grow_clusters(m, _seeds(m))


@query("g11_cluster_colours")
def g11(spark, d):
    m = mesh(spark, d)
    return clusters.colour_clusters(m, m.faces.select("mesh_id", "face_id", (F.col("face_id") % 5).alias("cluster")))


@query("n16_cluster_polygons")
def n16(spark, d):
    m = mesh(spark, d)
    return clusters.cluster_polygons(m, clusters.grow_clusters(m, _seeds(m))).select("mesh_id", "cluster", F.size("verts").alias("corners"))


@query("n18_overlay_labels")
def n18(spark, d):
    """Two labellings overlaid; of the parts the largest stay, four for each first label, and absorb the rest."""
    m = M.prepared(mesh(spark, d))
    labels = m.faces.select("mesh_id", "face_id", (F.col("face_id") % 2).alias("a"), (F.col("face_id") % 3 % 2).alias("b"))
    return O.overlay_labels(m, labels)


@query("n18_overlay_clusters", PART + SIDES + """, lk AS (SELECT DISTINCT mesh_id, face_id AS a, pair_face AS b FROM sides WHERE pair_face IS NOT NULL AND face_id % 2 = pair_face % 2 AND face_id % 3 % 2 = pair_face % 3 % 2),
reach AS (SELECT mesh_id, face_id, face_id AS seen FROM grid UNION SELECT r.mesh_id, r.face_id, lk.b FROM reach r JOIN lk ON lk.mesh_id = r.mesh_id AND lk.a = r.seen)
SELECT mesh_id, face_id, min(seen) AS cluster FROM reach GROUP BY 1, 2""")
def n18_clusters(spark, d):
    """Two labellings overlaid: parts that hang together with both labels equal."""
    m = M.prepared(mesh(spark, d))
    return O.overlay(m, m.faces.select("mesh_id", "face_id", (F.col("face_id") % 2).alias("a"), (F.col("face_id") % 3 % 2).alias("b")))


@query("m5_dual", PART + "SELECT mesh_id, count(*) FILTER (NOT boundary) AS n FROM deg GROUP BY 1 HAVING count(*) FILTER (NOT boundary) > 0")
def m5(spark, d):
    return clusters.dual(mesh(spark, d)).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"))


@query("n15_feature_lines")
def n15(spark, d):
    """Sharp and border edges by the line they lie on; lines end where other than two of them meet."""
    m = mesh(spark, d)
    e = G.dihedral_angles(m).where("dihedral < 130").select("mesh_id", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi")).distinct()
    key = L.edge_key(F.col("lo"), F.col("hi"))
    ends = e.select("mesh_id", key.alias("e"), F.explode(F.array("lo", "hi")).alias("v"))
    through = ends.groupBy("mesh_id", "v").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("n = 2")
    links = through.select("mesh_id", "a", "b").unionByName(e.select("mesh_id", key.alias("a"), key.alias("b")))
    return components_by_mesh(links).groupBy("mesh_id", F.col("component").alias("line")).agg(F.count(F.lit(1)).alias("n_edges"))


_OPPOSITE = """, sl AS (
  SELECT mesh_id, least(v0, v1) * 2147483648 + greatest(v0, v1) AS a, least(v3, v2) * 2147483648 + greatest(v3, v2) AS b, CASE WHEN (v0 < v1) = (v3 < v2) THEN 1 ELSE -1 END AS s FROM quads
  UNION ALL SELECT mesh_id, least(v1, v2) * 2147483648 + greatest(v1, v2), least(v0, v3) * 2147483648 + greatest(v0, v3), CASE WHEN (v1 < v2) = (v0 < v3) THEN 1 ELSE -1 END FROM quads),
pairs AS MATERIALIZED (SELECT mesh_id, a, b, s FROM sl UNION SELECT mesh_id, b, a, s FROM sl),
ring AS (SELECT DISTINCT mesh_id, a AS e, a AS seen, 1 AS s FROM pairs UNION SELECT r.mesh_id, e, b, r.s * pairs.s FROM ring r JOIN pairs ON pairs.mesh_id = r.mesh_id AND pairs.a = r.seen)
SELECT mesh_id, e AS arc_id, min(seen) AS group_id, CAST(arg_min(s, seen) AS INT) AS sign FROM ring GROUP BY 1, 2"""


@query("g9_arc_groups", PART + _OPPOSITE)
def g9(spark, d):
    """Arcs over opposite sides of charts and the way they run, every quad a chart and every edge an arc."""
    m = M.prepared(mesh(spark, d))
    e = M.edges(m)
    corners = A.chart_corners(m, e, m.faces.select("mesh_id", "face_id", F.col("face_id").alias("chart_id")))
    return A.arc_groups(materialise(corners))


#: By kind and, for the folded square, side 4 or not. Grid, cylinder and torus follow from their shape; the rows of the folded square
#: are what the operator gave (vertices - arcs + charts is 0 there, as for the whole surface).
_CUT = "(VALUES (0, NULL, 1, 4, 4, 2), (1, NULL, 2, 4, 6, 3), (2, NULL, 4, 4, 8, 4), (3, TRUE, 4, 7, 11, 3), (3, FALSE, 6, 10, 16, 4)) AS k(kind, four, n_charts, n_corners, n_arcs, n_groups)"


@query("g7_cut_complex", PART + f"SELECT mesh_id, CAST(n_charts AS BIGINT) AS n_charts, CAST(n_corners AS BIGINT) AS n_corners, CAST(n_arcs AS BIGINT) AS n_arcs, CAST(n_groups AS BIGINT) AS n_groups, TRUE AS four_sided FROM dims d JOIN {_CUT} ON k.kind = d.kind AND (four IS NULL OR four = (d.a = 4))")
def g7_cut(spark, d):
    """The base complex with closed loops cut: charts, their corners, arcs and groups of opposite arcs; four-sided all."""
    m = M.prepared(mesh(spark, d))
    cut = materialise(A.cut_complex(m))
    labels = materialise(L.charts(m, cut))
    corners = materialise(A.chart_corners(m, cut, labels))
    n = lambda df, c, name: df.groupBy("mesh_id").agg(F.countDistinct(c).alias(name))
    sides = labels.select("mesh_id", "chart_id").distinct().join(corners.groupBy("mesh_id", "chart_id").agg(F.count(F.lit(1)).alias("n")), ["mesh_id", "chart_id"], "left")
    four = sides.groupBy("mesh_id").agg(F.every(F.coalesce(F.col("n") == 4, F.lit(False))).alias("four_sided"))
    groups = A.arc_groups(corners)
    return n(labels, "chart_id", "n_charts").join(n(corners, "v_id", "n_corners"), "mesh_id").join(n(A.arcs(m, cut), "arc_id", "n_arcs"), "mesh_id").join(n(groups, "group_id", "n_groups"), "mesh_id").join(four, "mesh_id")


@query("l6_label_components", PART + """, sz AS (SELECT mesh_id, mesh_id % 16 AS into_, a * b AS nf FROM dims),
b AS (SELECT into_ AS mesh_id, nf, coalesce(sum(nf) OVER w, 0) AS df, row_number() OVER w0 - 1 AS label FROM sz WINDOW w AS (PARTITION BY into_ ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0 AS (PARTITION BY into_ ORDER BY mesh_id))
SELECT mesh_id, CAST(df + f AS BIGINT) AS face_id, label FROM b, unnest(range(nf)) AS t(f)""")
def l6(spark, d):
    """Objects put together of many parts: welding that keeps degenerate faces, then a label from 0 for every component in the order of its first face."""
    m = mesh(spark, d)
    apart = m.vertices.withColumn("x", F.col("x") + F.expr("mesh_id div 16") * 20.0)
    m, _ = X.weld(M.concatenated(M.Mesh(apart, m.faces), F.col("mesh_id") % 16), keep_degenerate=True)
    return M.component_labels(M.Mesh(m.vertices, materialise(m.faces))).select("mesh_id", "face_id", "label")


@query("s_k_format_round_trips", PART + "SELECT mesh_id, f AS format, count(*) AS n_faces FROM grid, unnest(['off', 'obj', 'ply', 'vtk', 'vtp', 'wrl']) AS t(f) GROUP BY 1, 2")
def round_trips(spark, d):
    """Every mesh written in each polygon format and read again, within single precision."""
    m = mesh(spark, d)

    def reread(batches):
        for batch in batches:
            out = []
            for mesh_id, name, raw in zip(batch["mesh_id"], batch["name"], batch["content"], strict=True):
                v, f = formats.decode(name, bytes(raw))
                assert np.isfinite(v).all()
                out.append((mesh_id, name.rpartition(".")[2], len(f)))
            if out:
                yield pd.DataFrame(out, columns=["mesh_id", "format", "n_faces"])

    return files(m, "off", "obj", "ply", "vtk", "vtp", "wrl").mapInPandas(reread, "mesh_id long, format string, n_faces long")


@query("k1_triangle_formats", PART + "SELECT mesh_id, f AS format, 2 * count(*) AS n_triangles FROM grid, unnest(['stl', 'glb']) AS t(f) GROUP BY 1, 2")
def k1(spark, d):
    m = mesh(spark, d)

    def reread(batches):
        for batch in batches:
            out = [(i, n.rpartition(".")[2], len(formats.decode(n, bytes(c))[1])) for i, n, c in zip(batch["mesh_id"], batch["name"], batch["content"], strict=True)]
            if out:
                yield pd.DataFrame(out, columns=["mesh_id", "format", "n_triangles"])

    return files(m, "stl", "glb").mapInPandas(reread, "mesh_id long, format string, n_triangles long")


@query("s16_k13_bundles", PART + """, w AS (SELECT mesh_id, mesh_id % 16 AS bundle, row_number() OVER (PARTITION BY mesh_id % 16 ORDER BY mesh_id) - 1 AS object FROM dims)
SELECT CAST(bundle AS VARCHAR) AS bundle, CAST(object AS BIGINT) AS object, CAST(row_number() OVER (PARTITION BY mesh_id ORDER BY v_id) - 1 AS BIGINT) AS v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM w JOIN vertices USING (mesh_id)""")
def bundles_round_trip(spark, d):
    """All meshes as objects of 16 tensor bundles, written and read again: every vertex that a face uses, with its place."""
    m = mesh(spark, d)
    folder = f"{shared_dir(spark)}/bundles-{uuid.uuid4().hex}"
    bundles.write(bundles.objects(m, F.col("mesh_id") % 16), folder)
    v, f = bundles.meshes(bundles.read(spark, folder))
    used = f.select("bundle", "object", F.explode("verts").alias("v_id")).distinct()
    return v.join(used, ["bundle", "object", "v_id"], "left_semi").select("bundle", "object", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("n15_feature_polylines", PART + SIDES + BENDS + """, fe AS MATERIALIZED (SELECT DISTINCT mesh_id, least(v0, v1) AS lo, greatest(v0, v1) AS hi, least(v0, v1) * 2147483648 + greatest(v0, v1) AS e FROM bends WHERE dihedral < 130),
fw AS MATERIALIZED (SELECT mesh_id, e, lo AS v, hi AS o FROM fe UNION ALL SELECT mesh_id, e, hi, lo FROM fe),
fn AS MATERIALIZED (SELECT mesh_id, v, count(*) AS n FROM fw GROUP BY 1, 2),
fl AS MATERIALIZED (SELECT DISTINCT x.mesh_id, x.e AS a, y.e AS b FROM fw x JOIN fw y ON y.mesh_id = x.mesh_id AND y.v = x.v JOIN fn ON fn.mesh_id = x.mesh_id AND fn.v = x.v AND n = 2),
fr AS (SELECT mesh_id, e, e AS seen FROM fe UNION SELECT r.mesh_id, r.e, fl.b FROM fr r JOIN fl ON fl.mesh_id = r.mesh_id AND fl.a = r.seen),
ln AS MATERIALIZED (SELECT mesh_id, e, min(seen) AS line FROM fr GROUP BY 1, 2),
st AS (SELECT ln.mesh_id, line, coalesce(min(v) FILTER (n <> 2), min(v)) AS v, count(DISTINCT ln.e) AS size FROM ln JOIN fw USING (mesh_id, e) JOIN fn USING (mesh_id, v) GROUP BY 1, 2),
wk AS (SELECT mesh_id, line, size, 0 AS pos, v AS v_id, CAST(NULL AS BIGINT) AS came FROM st
  UNION ALL SELECT w.mesh_id, w.line, w.size, w.pos + 1, x.o, x.e FROM wk w JOIN LATERAL (SELECT o, fw.e FROM fw JOIN ln USING (mesh_id, e) WHERE fw.mesh_id = w.mesh_id AND ln.line = w.line AND fw.v = w.v_id AND fw.e IS DISTINCT FROM w.came ORDER BY o LIMIT 1) x ON TRUE WHERE w.pos < w.size)
SELECT mesh_id, line, CAST(pos AS BIGINT) AS pos, v_id FROM wk""")
def n15_lines(spark, d):
    """Sharp and border edges as polylines between the vertices where other than two of them meet."""
    m = M.prepared(mesh(spark, d))
    sharp = G.dihedral_angles(m).where("dihedral < 130").select("mesh_id", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"))
    return A.feature_lines(sharp)
