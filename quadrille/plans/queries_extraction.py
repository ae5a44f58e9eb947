"""Queries of chart splitting, re-tiling and quad extraction; SQL where closed forms exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators.kernels import blocks, charts, clusters, extraction, tiling
from quadrille.operators.subdivision import smooth
from quadrille.plans.derived import dims, mesh, sql_prefix
from quadrille.plans.queries_mesh import r6

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


def stripes(m: M.Mesh, n: int):
    """A labelling that needs no growth: face ids by remainder."""
    return m.faces.select("mesh_id", "face_id", (F.col("face_id") % n).alias("cluster"))


def blocks_field(spark, d, m: M.Mesh):
    """A field with a peak in the middle of every block of three by three quads."""
    b = dims(spark, d, "part").select("mesh_id", "b")
    label = m.faces.join(b, "mesh_id").selectExpr("mesh_id", "face_id", "face_id div b div 3 * 1000 + face_id % b div 3 AS chart_id")
    return materialise(clusters.chart_fields(m, label))


def sides(m: M.Mesh):
    """Polygons of every mesh by their number of sides."""
    n = F.size("verts")
    return m.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"), F.count_if(n == 3).alias("triangles"), F.count_if(n == 4).alias("quads"), F.count_if(n > 4).alias("larger"))


@query("g8_loop_points", PART + """, path AS (SELECT v.*, v_id % (b + 1) AS loop_id, v_id // (b + 1) AS pos FROM vertices v JOIN dims USING (mesh_id) WHERE kind = 0),
steps AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)), 0.0) AS step FROM path WINDOW w AS (PARTITION BY mesh_id, loop_id ORDER BY pos)),
run AS (SELECT *, sum(step) OVER (PARTITION BY mesh_id, loop_id ORDER BY pos) AS run, sum(step) OVER (PARTITION BY mesh_id, loop_id) AS total FROM steps)
SELECT mesh_id, loop_id, round(max(total), 6) AS length, min_by(v_id, pos) FILTER (run >= total / 3.0) AS third, min_by(v_id, pos) FILTER (run >= total * 0.5) AS middle, min_by(v_id, pos) FILTER (run >= total * 2.0 / 3.0) AS two_thirds FROM run GROUP BY ALL""")
def g8(spark, d):
    """Vertices at a third, a half and two thirds of the lines of grids."""
    m = mesh(spark, d)
    b = dims(spark, d, "part").where("kind = 0").select("mesh_id", "b")
    path = m.vertices.join(b, "mesh_id").selectExpr("mesh_id", "v_id % (b + 1) AS loop_id", "v_id div (b + 1) AS pos", "v_id", "x", "y", "z")
    return L.points_at(path, third=1 / 3, middle=0.5, two_thirds=2 / 3).withColumn("length", r6(F.col("length")))


@query("g7_framed_complex")
def g7(spark, d):
    """Edges and charts of the base complex with border and sharp loops."""
    m = mesh(spark, d)
    framed = materialise(L.framed_edges(m))
    n = framed.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("loop_id").alias("n_loops"))
    c = L.charts(m, framed).groupBy("mesh_id").agg(F.countDistinct("chart_id").alias("n_charts"))
    return c.join(n, "mesh_id", "left").na.fill(0, ["n_edges", "n_loops"])


@query("g7_n7_halved_charts")
def n7(spark, d):
    """Base-complex charts cut at the middles of their arcs."""
    m = mesh(spark, d)
    out, labels = charts.halved(m, L.charts(m))
    return sides(out).join(labels.groupBy("mesh_id").agg(F.countDistinct("chart_id").alias("n_charts")), "mesh_id")


@query("n7_halved_quads", PART + "SELECT mesh_id, face_id AS chart_id, CAST(4 AS BIGINT) AS n_quads FROM grid")
def n7_quads(spark, d):
    """Every quad a chart: each is cut in four."""
    m = mesh(spark, d)
    _, labels = charts.halved(m, m.faces.select("mesh_id", "face_id", F.col("face_id").alias("chart_id")))
    return labels.groupBy("mesh_id", "chart_id").agg(F.count(F.lit(1)).alias("n_quads"))


@query("n8_alternating_triangles", PART + "SELECT mesh_id, face_id AS parent, CAST(2 AS BIGINT) AS n_triangles FROM grid")
def n8(spark, d):
    m = mesh(spark, d)
    return charts.alternating_triangles(m, L.charts(m)).groupBy("mesh_id", "parent").agg(F.count(F.lit(1)).alias("n_triangles"))


@query("p15_vertex_clusters")
def p15(spark, d):
    m = mesh(spark, d)
    return extraction.vertex_clusters(m, stripes(m, 5))


@query("n16_n22_retiled_polygons")
def n16(spark, d):
    """Cluster polygons after edge collapse and re-tiling."""
    m = mesh(spark, d)
    f = blocks_field(spark, d, m)
    return sides(tiling.refined(extraction.polygon_mesh(m, clusters.grow_clusters(m, clusters.seed_faces(m, f, 1)))))


@query("n17_dual_polygons")
def n17(spark, d):
    m = mesh(spark, d)
    return sides(extraction.dual_mesh(m, stripes(m, 7)))


@query("n20_projected", PART + "SELECT mesh_id, v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vertices")
def n20(spark, d):
    """Vertices on the source stay where they are."""
    m = mesh(spark, d)
    return extraction.projected(m, m).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("n20_smoothed_projected")
def n20_smoothed(spark, d):
    m = mesh(spark, d)
    return extraction.projected(smooth(m, 0.5), m).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("n23_extracted_quads")
def n23(spark, d):
    m = mesh(spark, d)
    return sides(extraction.extract_quads(m, blocks_field(spark, d, m), rings=1))


@query("n23_extracted_quads_dual")
def n23_dual(spark, d):
    m = mesh(spark, d)
    return sides(extraction.extract_quads(m, blocks_field(spark, d, m), rings=1, dual=True))


@query("n25_tunnels")
def n25(spark, d):
    """Exposed quads of seeded solids with tunnels, with topology."""
    q = blocks.exposed_quads(blocks.cells(spark, 24, blocks=40, tunnels=6), 8)
    v = q.select("mesh_id", F.explode("verts").alias("v_id")).distinct().select("mesh_id", "v_id", *(F.lit(0.0).alias(c) for c in "xyz"))
    return M.topology(M.Mesh(v, q.select("mesh_id", (F.col("cell") * 6 + F.col("side")).alias("face_id"), "verts"))).select("mesh_id", "n_vertices", "n_edges", "n_faces", "n_boundary_edges", "euler")
