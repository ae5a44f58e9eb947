"""Filter, join, aggregate, sort, set and spatial queries with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise, table
from quadrille.functions.vec import V3, point_triangle
from quadrille.operators import geometry as G
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators import nearest
from quadrille.operators import quality as Q
from quadrille.operators import spatial as X
from quadrille.operators import subdivision as S
from quadrille.plans.derived import BENDS, SIDES, TRIANGLES, dims, mesh, sql_prefix
from quadrille.plans.queries_mesh import _COMPLEX, _EDGE_STATS, _FACE_LOOPS, r6

PART, NATION = sql_prefix("part"), sql_prefix("nation")
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def joined(c):
    return F.concat_ws(",", c.cast("array<string>"))


# ---- filters ----
_SING = "CASE WHEN boundary THEN degree <> 3 ELSE degree <> 4 END"


@query("p5_shape_stats", PART + f""", s AS (SELECT mesh_id, count(*) FILTER ({_SING} AND NOT boundary) AS n_interior_singular, count(*) FILTER ({_SING} AND boundary) AS n_boundary_singular, coalesce(max(degree) FILTER (NOT boundary), 0) AS max_interior_degree, coalesce(max(degree) FILTER (boundary), 0) AS max_boundary_degree FROM deg GROUP BY 1),
b AS (SELECT e.mesh_id, bool_or(x.boundary AND y.boundary) AS bridge FROM edges e JOIN deg x ON x.mesh_id = e.mesh_id AND x.v_id = lo JOIN deg y ON y.mesh_id = e.mesh_id AND y.v_id = hi WHERE n = 2 GROUP BY 1),
f AS (SELECT mesh_id, max(c) AS m FROM (SELECT c.mesh_id, face_id, count(*) AS c FROM corners c JOIN deg g ON g.mesh_id = c.mesh_id AND g.v_id = c.v_id WHERE {_SING} GROUP BY 1, 2) GROUP BY 1)
SELECT mesh_id, n_interior_singular, n_boundary_singular, max_interior_degree, max_boundary_degree, coalesce(bridge, false) AS bridge, coalesce(m, 0) AS max_singular_in_face FROM s LEFT JOIN b USING (mesh_id) LEFT JOIN f USING (mesh_id)""")
def p5(spark, d):
    return Q.shape_stats(mesh(spark, d)).drop("max_bend")


_FIGURES = """WITH f AS (SELECT CAST(p_partkey AS BIGINT) AS mesh_id, 12 + p_partkey % 97 AS n_faces, p_partkey % 11 = 0 AS bridge, p_size % 4 AS max_singular_in_face, CAST(p_partkey % 73 AS DOUBLE) AS max_bend, 3 + p_partkey % 7 AS max_interior_degree, 2 + p_size % 3 AS max_boundary_degree, p_partkey % 5 AS n_interior_singular,
CAST((1 + p_partkey % 13) / 14.0 AS DOUBLE) AS size_ratio, CAST((1 + p_partkey % 17) / 18.0 AS DOUBLE) AS fratio_new, CAST((p_partkey % 19) / 4000.0 AS DOUBLE) AS min_area_ratio, CAST((p_partkey % 23) / 300.0 AS DOUBLE) AS min_border, CAST(p_partkey % 12 AS BIGINT) AS n_boundaries, CAST((1 + p_partkey % 29) / 9000.0 AS DOUBLE) AS min_extent, CAST(1 AS DOUBLE) AS max_extent FROM part) """


def figures(spark, d):
    """A row of mesh figures per part, which pass and fail every clause of the filters."""
    table(spark, d, "part").createOrReplaceTempView("_quadrille_part")
    return spark.sql(_FIGURES.replace("FROM part", "FROM _quadrille_part") + "SELECT * FROM f")


@query("p6_quick_filter", _FIGURES + "SELECT mesh_id, n_boundaries, n_interior_singular FROM f WHERE NOT (n_boundaries > 8 OR n_interior_singular = 0 OR max_bend > 60)")
def p6(spark, d):
    rows = figures(spark, d)
    return Q.quick_filter(rows.drop("n_boundaries"), rows.select("mesh_id", "n_boundaries")).select("mesh_id", "n_boundaries", "n_interior_singular")


@query("p8_valid_meshes", _FIGURES + "SELECT mesh_id FROM f WHERE n_faces >= 16 AND min_extent / max_extent >= 0.001")
def p8(spark, d):
    return Q.valid(figures(spark, d)).select("mesh_id")


@query("p7_short_edges", PART + "SELECT DISTINCT e.mesh_id FROM edges e JOIN vertices a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.v_id = hi WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 1.0")
def p7(spark, d):
    return Q.short_edges(mesh(spark, d), 1.0)


@query("p9_dataset_filter", _FIGURES + """SELECT mesh_id FROM f WHERE NOT (n_faces <= 16 OR bridge OR max_singular_in_face > 2 OR max_bend > 60 OR max_interior_degree > 8 OR max_boundary_degree > 3 OR n_interior_singular = 0
OR size_ratio <= 0.2 OR fratio_new < 0.6 OR min_area_ratio < 0.001 OR min_border < 0.02)""")
def p9(spark, d):
    return Q.dataset_filter(figures(spark, d)).select("mesh_id")


@query("p9_dataset_figures")
def p9_figures(spark, d):
    """What the keep rule reads, from the meshes themselves."""
    rows = Q.dataset_figures(mesh(spark, d))
    return rows.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query("p10_mergeable_edges", PART + TRIANGLES + """, ts AS (SELECT mesh_id, face_id, least(v0, v1) AS lo, greatest(v0, v1) AS hi, v2 AS far FROM tris UNION ALL SELECT mesh_id, face_id, least(v1, v2), greatest(v1, v2), v0 FROM tris UNION ALL SELECT mesh_id, face_id, least(v2, v0), greatest(v2, v0), v1 FROM tris),
te AS MATERIALIZED (SELECT mesh_id, lo, hi, count(*) AS n, min(face_id) AS f0, max(face_id) AS f1, arg_min(far, face_id) AS far0, arg_max(far, face_id) AS far1 FROM ts GROUP BY 1, 2, 3),
tw AS (SELECT *, least(far0, far1) AS a, greatest(far0, far1) AS b FROM te WHERE n = 2),
free AS MATERIALIZED (SELECT t.* FROM tw t ANTI JOIN te k ON k.mesh_id = t.mesh_id AND k.lo = a AND k.hi = b)
SELECT mesh_id, lo, hi, f0, f1, far0, far1 FROM free""")
def p10(spark, d):
    m = mesh(spark, d)
    return Q.mergeable_edges(M.prepared(M.Mesh(m.vertices, G.quads_to_triangles(m))))


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}{c} * {b}{c}" for c in "xyz") + ")"


def _cross(a: str, b: str, into: str) -> str:
    return ", ".join(f"{a}{x} * {b}{y} - {a}{y} * {b}{x} AS {into}{z}" for z, x, y in ("xyz", "yzx", "zxy"))


def _degrees(a: str, b: str) -> str:
    return f"degrees(acos(least(1.0, greatest(-1.0, {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)})))))"


def _minus(a: str, b: str, into: str) -> str:
    return ", ".join(f"{a}{c} - {b}{c} AS {into}{c}" for c in "xyz")


#: Follows the SQL of p10 up to its last SELECT: the corners of the quad of every free edge, then what makes it a good one, step by step.
_GOOD_QUADS = f""", tv AS (SELECT mesh_id, face_id, v0, v1, v2 FROM tris),
g0 AS (SELECT f.mesh_id, lo, hi, f0, f1, far0, far1, CASE far0 WHEN v0 THEN v1 WHEN v1 THEN v2 ELSE v0 END AS w1, CASE far0 WHEN v0 THEN v2 WHEN v1 THEN v0 ELSE v1 END AS w3 FROM free f JOIN tv ON tv.mesh_id = f.mesh_id AND tv.face_id = f0),
g1 AS (SELECT g.*, {", ".join(f"{t}.{c} AS {t}{c}" for t in ("p", "q", "r", "s") for c in "xyz")} FROM g0 g JOIN vertices p ON p.mesh_id = g.mesh_id AND p.v_id = far0 JOIN vertices q ON q.mesh_id = g.mesh_id AND q.v_id = w1
  JOIN vertices r ON r.mesh_id = g.mesh_id AND r.v_id = far1 JOIN vertices s ON s.mesh_id = g.mesh_id AND s.v_id = w3),
g2 AS (SELECT *, {_minus("q", "p", "i")}, {_minus("s", "p", "j")}, {_minus("s", "r", "k")}, {_minus("q", "r", "l")}, {_minus("r", "p", "m")}, {_minus("s", "q", "o")}, {", ".join(f"(p{c} + q{c} + r{c} + s{c}) / 4 AS c{c}" for c in "xyz")} FROM g1),
g3 AS (SELECT *, {_cross("i", "j", "a")}, {_cross("k", "l", "e")}, {_cross("m", "o", "n")} FROM g2),
g4 AS (SELECT *, sqrt({_dot("n", "n")}) AS len FROM g3 WHERE {_dot("n", "a")} * {_dot("n", "e")} >= 0 AND 180 - {_degrees("a", "e")} >= 120),
g5 AS (SELECT *, {", ".join(f"n{c} / len AS u{c}" for c in "xyz")} FROM g4),
g6 AS (SELECT *, {", ".join(f"{_dot('u', t)} - {_dot('u', 'c')} AS h{t}" for t in "pqrs")} FROM g5),
g7 AS (SELECT *, {", ".join(f"{t}{c} - h{t} * u{c} AS f{t}{c}" for t in "pqrs" for c in "xyz")} FROM g6),
g8 AS (SELECT *, {", ".join(_minus(f"f{a}", f"f{b}", f"d{a}") for a, b in ("pq", "qr", "rs", "sp"))} FROM g7),
g9 AS (SELECT *, {", ".join(_cross(f"d{a}", f"d{b}", f"x{a}") for a, b in ("pq", "qr", "rs", "sp"))}, {", ".join(f"{_degrees(f'd{a}', f'd{b}')} AS t{a}" for a, b in ("pq", "qr", "rs", "sp"))} FROM g8),
good AS (SELECT *, {" + ".join(f"abs(90 - t{a})" for a in "pqrs")} AS regularity FROM g9
  WHERE abs({" + ".join(f"CASE WHEN {_dot('u', f'x{a}')} > 0 THEN 1 ELSE -1 END" for a in "pqrs")}) = 4 AND {" AND ".join(f"t{a} BETWEEN 10 AND 170" for a in "pqrs")} AND 720 - tp - tq - tr - ts <= 390)
SELECT mesh_id, lo, hi, f0, f1, round(regularity, 4) AS regularity FROM good"""


@query("p11_mergeable_quads", ORACLE_SQL["p10_mergeable_edges"].rsplit("\nSELECT", 1)[0] + _GOOD_QUADS)
def p11(spark, d):
    """Pairs of triangles that make a good quad, and how far its corners are from square."""
    m = mesh(spark, d)
    return Q.mergeable_quads(M.Mesh(m.vertices, G.quads_to_triangles(m))).select("mesh_id", "lo", "hi", "f0", "f1", F.round("regularity", 4).alias("regularity"))


@query("p12_checkerable", NATION + _FACE_LOOPS + ", c AS (SELECT mesh_id, loop_id, count(*) AS n FROM fl SEMI JOIN kept USING (mesh_id, loop_id) GROUP BY 1, 2) SELECT mesh_id, bool_and(n % 2 = 0) AS faces_even FROM c GROUP BY 1")
def p12(spark, d):
    return L.face_loop_stats(mesh(spark, d, "nation")).groupBy("mesh_id").agg(F.every(F.col("n_links") % 2 == 0).alias("faces_even"))


@query("p13_complex_vertices", NATION + _COMPLEX + f", cv AS (SELECT mesh_id, v, count(*) AS n FROM (SELECT mesh_id, lo AS v FROM cx UNION ALL SELECT mesh_id, hi FROM cx) GROUP BY 1, 2) SELECT g.mesh_id, g.v_id, coalesce(n, 0) AS n_complex, ({_SING}) OR coalesce(n, 0) > 2 AS is_corner FROM deg g LEFT JOIN cv ON cv.mesh_id = g.mesh_id AND cv.v = g.v_id")
def p13(spark, d):
    m = mesh(spark, d, "nation")
    n = L.complex_edges(m).select("mesh_id", F.explode(F.array("lo", "hi")).alias("v_id")).groupBy("mesh_id", "v_id").agg(F.count(F.lit(1)).alias("n_complex"))
    v = M.vertex_facts(M.edges(m)).join(n, ["mesh_id", "v_id"], "left").na.fill(0, ["n_complex"])
    return v.select("mesh_id", "v_id", "n_complex", (M.singular() | (F.col("n_complex") > 2)).alias("is_corner"))


@query("p14_closed_edge_loops", NATION + _EDGE_STATS + ", o AS (SELECT mesh_id, loop_id, count(*) FILTER (c = 1) AS tips FROM (SELECT mesh_id, loop_id, v, count(*) AS c FROM (SELECT mesh_id, loop_id, lo AS v FROM el UNION ALL SELECT mesh_id, loop_id, hi FROM el) GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT mesh_id, loop_id, tips = 0 AND n_edges > 2 AS closed FROM ew JOIN o USING (mesh_id, loop_id)")
def p14(spark, d):
    loops = L.edge_loops(mesh(spark, d, "nation"))
    n = loops.groupBy("mesh_id", "loop_id").agg(F.count(F.lit(1)).alias("n"))
    tips = loops.select("mesh_id", "loop_id", F.explode(F.array("lo", "hi")).alias("v")).groupBy("mesh_id", "loop_id", "v").count().groupBy("mesh_id", "loop_id").agg(F.count_if(F.col("count") == 1).alias("tips"))
    return n.join(tips, ["mesh_id", "loop_id"]).select("mesh_id", "loop_id", ((F.col("tips") == 0) & (F.col("n") > 2)).alias("closed"))


@query("p16_sharp_edges", PART + SIDES + BENDS + "SELECT mesh_id, v0, v1 FROM bends WHERE dihedral < 130 AND (v0 < v1 OR dihedral = 0)")
def p16(spark, d):
    return G.dihedral_angles(mesh(spark, d)).where("dihedral < 130 AND (v0 < v1 OR dihedral = 0)").select("mesh_id", "v0", "v1")


# ---- joins ----
_NEAR = """WITH p AS (SELECT vec_id AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
pts AS (SELECT 0 AS mesh_id, v AS v_id, x, y, z FROM p UNION ALL SELECT 0, v + 10000000, x + 1e-7, y - 1e-7, z FROM p WHERE v % 3 = 0),
b AS (SELECT min(x) AS ax, min(y) AS ay, min(z) AS az, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM pts),
u AS (SELECT v_id, (x - ax) / s AS x, (y - ay) / s AS y, (z - az) / s AS z FROM pts, b)
"""


def points(spark, d):
    """Embedding components as points, a third of them doubled at a tiny distance."""
    e = table(spark, d, "embeddings")
    p = e.select(F.lit(0).cast("long").alias("mesh_id"), F.col("vec_id").alias("v_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))
    twin = p.where("v_id % 3 = 0").select("mesh_id", (F.col("v_id") + 10_000_000).alias("v_id"), (F.col("x") + 1e-7).alias("x"), (F.col("y") - 1e-7).alias("y"), "z")
    return p.unionByName(twin)


@query("j6_weld", _NEAR.rstrip() + ", w AS (SELECT a.v_id AS v_id, min(b.v_id) AS rep FROM u a JOIN u b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < 1e-10 GROUP BY 1) SELECT v_id, rep FROM w")
def j6(spark, d):
    p = points(spark, d)
    none = spark.createDataFrame([], "mesh_id long, face_id long, verts array<long>")
    return X.weld(M.Mesh(p, none))[1].select("v_id", "rep")


@query("j9_nearest_point", "WITH p AS (SELECT vec_id AS v, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS s, CAST(embedding[5] AS DOUBLE) AS t, CAST(embedding[6] AS DOUBLE) AS w FROM embeddings), c AS (SELECT q.v AS q_id, p.v AS v_id, sqrt((q.s - p.x) ** 2 + (q.t - p.y) ** 2 + (q.w - p.z) ** 2) AS d FROM p q, p) SELECT q_id, arg_min(v_id, (d, v_id)) AS v_id, round(min(d), 9) AS distance FROM c GROUP BY 1")
def j9(spark, d):
    e = table(spark, d, "embeddings")
    xyz = lambda o: [F.get("embedding", F.lit(i + o)).cast("double").alias(c) for i, c in enumerate("xyz")]
    zero = F.lit(0).cast("long").alias("mesh_id")
    out = nearest.nearest_point(e.select(zero, F.col("vec_id").alias("q_id"), *(c.alias(f"q{n}") for c, n in zip(xyz(3), "xyz"))), e.select(zero, F.col("vec_id").alias("v_id"), *xyz(0)))
    return out.select("q_id", "v_id", F.round("distance", 9).alias("distance"))


def _to_segment(a: str, b: str) -> str:
    """SQL for the distance of q from the segment between two corners."""
    dot = " + ".join(f"(q{x} - {x}{a}) * ({x}{b} - {x}{a})" for x in "xyz")
    size = " + ".join(f"({x}{b} - {x}{a}) ** 2" for x in "xyz")
    return "sqrt(" + " + ".join(f"(q{x} - {x}{a} - ({x}{b} - {x}{a}) * least(1.0, greatest(0.0, ({dot}) / ({size})))) ** 2" for x in "xyz") + ")"


def _inside(a: str, b: str) -> str:
    """SQL for the side of q along the line of two corners, seen along the normal n."""
    return " + ".join(f"n{z} * (({x}{b} - {x}{a}) * (q{y} - {y}{a}) - ({y}{b} - {y}{a}) * (q{x} - {x}{a}))" for z, x, y in ("xyz", "yzx", "zxy"))


_NORMALS = ", ".join(f"({x}1 - {x}0) * ({y}2 - {y}0) - ({y}1 - {y}0) * ({x}2 - {x}0) AS n{z}" for z, x, y in ("xyz", "yzx", "zxy"))


@query("j7_nearest_triangle", PART + TRIANGLES + f""", tn AS (SELECT *, {_NORMALS} FROM tris),
qs AS (SELECT mesh_id, face_id AS q_id, (x0 + x1 + x2 + x3) / 4 AS qx, (y0 + y1 + y2 + y3) / 4 AS qy, (z0 + z1 + z2 + z3) / 4 AS qz FROM quads),
ds AS (SELECT mesh_id, q_id, CASE WHEN {_inside("0", "1")} >= 0 AND {_inside("1", "2")} >= 0 AND {_inside("2", "0")} >= 0 THEN abs((qx - x0) * nx + (qy - y0) * ny + (qz - z0) * nz) / sqrt(nx * nx + ny * ny + nz * nz)
  ELSE least({_to_segment("0", "1")}, {_to_segment("1", "2")}, {_to_segment("2", "0")}) END AS d FROM qs JOIN tn USING (mesh_id))
SELECT mesh_id, q_id, round(min(d), 4) + 0.0 AS distance FROM ds GROUP BY 1, 2""")
def j7(spark, d):
    """Distance of every face's centroid from the nearest triangle of its mesh."""
    m = mesh(spark, d)
    t = G.face_points(M.Mesh(m.vertices, G.quads_to_triangles(m))).select("mesh_id", F.col("face_id").alias("item_id"), *(F.get("pts", F.lit(i)).alias(f"p{i}") for i in range(3)))
    q = G.face_facts(m).select("mesh_id", F.col("face_id").alias("q_id"), *(F.col(f"c.{c}").alias(f"q{c}") for c in "xyz"))
    near = nearest.nearest_triangle(q, t)
    return near.select("mesh_id", "q_id", (F.round("distance", 4) + F.lit(0.0)).alias("distance"))


@query("j8_nearest_segment", PART + """, c AS (SELECT mesh_id, face_id AS q_id, (x0 + x1 + x2 + x3) / 4 + 0.123 AS qx, (y0 + y1 + y2 + y3) / 4 AS qy, (z0 + z1 + z2 + z3) / 4 AS qz FROM quads),
s AS (SELECT e.mesh_id, lo * 2147483648 + hi AS item_id, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM edges e JOIN vertices a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.v_id = hi WHERE n = 1),
t AS (SELECT *, least(1.0, greatest(0.0, ((qx - ax) * dx + (qy - ay) * dy + (qz - az) * dz) / (dx * dx + dy * dy + dz * dz))) AS t FROM c JOIN s USING (mesh_id)),
d AS (SELECT mesh_id, q_id, item_id, round(sqrt((qx - ax - t * dx) ** 2 + (qy - ay - t * dy) ** 2 + (qz - az - t * dz) ** 2), 6) AS d FROM t)
SELECT mesh_id, q_id, min(d) AS distance FROM d GROUP BY 1, 2""")
def j8(spark, d):
    m = mesh(spark, d)
    pos = lambda k, n: m.vertices.select("mesh_id", F.col("v_id").alias(k), *(F.col(c).alias(n + c) for c in "xyz"))
    s = M.edges(m).where("n_faces = 1").join(pos("lo", "a"), ["mesh_id", "lo"]).join(pos("hi", "b"), ["mesh_id", "hi"]).withColumn("item_id", L.edge_key(F.col("lo"), F.col("hi")))
    q = G.face_facts(m).select("mesh_id", F.col("face_id").alias("q_id"), (F.col("c.x") + 0.123).alias("qx"), F.col("c.y").alias("qy"), F.col("c.z").alias("qz"))
    near = nearest.nearest_segment(q, s, 6)
    return near.select("mesh_id", "q_id", "distance")


@query("j10_area_intervals", PART + "SELECT mesh_id, face_id, round(sum(area) OVER w / sum(area) OVER (PARTITION BY mesh_id), 6) AS hi FROM areas WINDOW w AS (PARTITION BY mesh_id ORDER BY face_id)")
def j10(spark, d):
    return X.area_intervals(mesh(spark, d)).select("mesh_id", "face_id", r6(F.col("hi")).alias("hi"))


@query("j10_sample_faces")
def j10_samples(spark, d):
    return X.sample_faces(mesh(spark, d), 64)


@query("j12_a17_cluster_borders", PART + """, fc AS (SELECT mesh_id, face_id, face_id % 5 AS c, (face_id * 7 % 11) / 10.0 AS w FROM grid),
l AS (SELECT e.mesh_id, least(s.c, t.c) AS c0, greatest(s.c, t.c) AS c1, (s.w + t.w) / 2 > 0.5 AS high, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS len FROM edges e JOIN fc s ON s.mesh_id = e.mesh_id AND s.face_id = f0 JOIN fc t ON t.mesh_id = e.mesh_id AND t.face_id = f1 JOIN vertices a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.v_id = hi WHERE n = 2 AND s.c <> t.c)
SELECT mesh_id, c0, c1, round(coalesce(sum(len) FILTER (NOT high), 0), 6) AS clear, round(coalesce(sum(len) FILTER (high), 0), 6) AS confused FROM l GROUP BY 1, 2, 3""")
def j12(spark, d):
    b = Q.cluster_borders(mesh(spark, d), F.col("face_id") % 5, (F.col("face_id") * 7 % 11) / 10.0)
    return b.select("mesh_id", "c0", "c1", r6(F.col("clear")).alias("clear"), r6(F.col("confused")).alias("confused"))


@query("g10_merge_clusters")
def g10(spark, d):
    """Clusters joined over borders that are confused for the larger part."""
    from quadrille.functions.local_components import components_by_mesh

    m = mesh(spark, d)
    bad = Q.cluster_borders(m, F.col("face_id") % 5, (F.col("face_id") * 7 % 11) / 10.0).where("confused > clear").select("mesh_id", F.col("c0").alias("a"), F.col("c1").alias("b"))
    own = m.faces.select("mesh_id", (F.col("face_id") % 5).alias("a")).distinct().withColumn("b", F.col("a"))
    return components_by_mesh(bad.unionByName(own)).select("mesh_id", F.col("node").alias("cluster"), F.col("component").alias("merged"))


@query("j16_vertex_cluster_sets", PART + "SELECT mesh_id, v_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS clusters FROM (SELECT DISTINCT mesh_id, v_id, face_id % 5 AS c FROM corners) GROUP BY 1, 2 HAVING count(*) >= 3")
def j16(spark, d):
    s = M.corners(mesh(spark, d)).groupBy("mesh_id", "v_id").agg(F.array_sort(F.collect_set(F.col("face_id") % 5)).alias("c")).where("size(c) >= 3")
    return s.select("mesh_id", "v_id", joined(F.col("c")).alias("clusters"))


# ---- aggregates, sorts, sets ----
@query("a18_t3_cluster_areas", PART + ", ca AS (SELECT mesh_id, face_id % 5 AS c, round(sum(area), 6) AS area FROM areas GROUP BY 1, 2) SELECT mesh_id, c AS cluster, area, row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, c) <= 4 AS kept FROM ca")
def a18(spark, d):
    c = G.face_facts(mesh(spark, d)).groupBy("mesh_id", (F.col("face_id") % 5).alias("cluster")).agg(r6(F.sum("area")).alias("area"))
    return c.withColumn("kept", F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("area"), "cluster")) <= 4)


@query("a19_n19_vertex_average", PART + "SELECT mesh_id, v_id, round(sum(area * ((face_id * 7 % 11) / 10.0)) / sum(area), 6) AS value FROM corners JOIN areas USING (mesh_id, face_id) GROUP BY 1, 2")
def a19(spark, d):
    m = mesh(spark, d)
    f = G.face_facts(m).select("mesh_id", "face_id", "area", ((F.col("face_id") * 7 % 11) / 10.0).alias("w"))
    return M.corners(m).join(f, ["mesh_id", "face_id"]).groupBy("mesh_id", "v_id").agg(r6(F.sum(F.col("area") * F.col("w")) / F.sum("area")).alias("value"))


@query("a21_histogram", PART + ", n AS (SELECT mesh_id, count(*) AS n FROM grid GROUP BY 1) SELECT CAST(least(n // 10 * 10, 100) AS BIGINT) AS bin, count(*) AS meshes FROM n GROUP BY 1")
def a21(spark, d):
    n = mesh(spark, d).faces.groupBy("mesh_id").count()
    return n.groupBy(F.least(F.floor(F.col("count") / 10) * 10, F.lit(100)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("meshes"))


@query("a22_chart_sizes", PART + "SELECT mesh_id, face_id % 5 AS chart, round(sum(area), 6) AS area, round(sqrt(sum(area)), 6) AS size FROM areas GROUP BY 1, 2")
def a22(spark, d):
    return G.face_facts(mesh(spark, d)).groupBy("mesh_id", (F.col("face_id") % 5).alias("chart")).agg(r6(F.sum("area")).alias("area"), r6(F.sqrt(F.sum("area"))).alias("size"))


@query("t1_edges_by_length", PART + ", l AS (SELECT e.mesh_id, lo, hi, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS length FROM edges e JOIN vertices a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.v_id = hi) SELECT mesh_id, lo, hi, length, row_number() OVER (PARTITION BY mesh_id ORDER BY length, lo, hi) AS place FROM l")
def t1(spark, d):
    m = mesh(spark, d)
    e = G.edge_geometry(m, M.edges(m)).select("mesh_id", "lo", "hi", r6(F.col("length")).alias("length"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("mesh_id").orderBy("length", "lo", "hi")).cast("long"))


@query("t2_loops_by_length", NATION + _EDGE_STATS + "SELECT mesh_id, loop_id, n_edges, row_number() OVER (PARTITION BY mesh_id ORDER BY n_edges DESC, loop_id) AS place FROM ew")
def t2(spark, d):
    s = L.edge_loop_stats(mesh(spark, d, "nation")).select("mesh_id", "loop_id", "n_edges")
    return s.withColumn("place", F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("n_edges"), "loop_id")).cast("long"))


_MERGED = """, sz AS (SELECT mesh_id, mesh_id % 16 AS into_, a * b AS nf FROM dims),
part_of AS (SELECT into_ AS mesh_id, nf AS n, CAST(coalesce(sum(nf) OVER (PARTITION BY into_ ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS comp_id FROM sz)"""


@query("t4_t5_largest_component", PART + _MERGED + " SELECT mesh_id, comp_id, n FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY n DESC, comp_id) AS r FROM part_of) WHERE r = 1")
def t4(spark, d):
    """The component of most faces in meshes put together of many; ties to the smaller id."""
    c = M.face_components(M.concatenated(mesh(spark, d), F.col("mesh_id") % 16)).groupBy("mesh_id", "comp_id").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("mesh_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "comp_id", "n")).alias("b")).select("mesh_id", "b.comp_id", "b.n")


@query("t9_random_subset")
def t9(spark, d):
    """Eight vertices of every mesh, by a seeded hash."""
    v = mesh(spark, d).vertices
    return v.withColumn("r", F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.xxhash64(F.lit(7), "mesh_id", "v_id"), "v_id"))).where("r <= 8").select("mesh_id", "v_id")


@query("u3_distinct_corners", PART + "SELECT mesh_id, face_id, count(DISTINCT v_id // 2) AS n FROM corners GROUP BY 1, 2 HAVING count(DISTINCT v_id // 2) > 2")
def u3(spark, d):
    f = mesh(spark, d).faces.select("mesh_id", "face_id", F.size(F.array_distinct(F.transform("verts", lambda v: F.floor(v / 2)))).cast("long").alias("n"))
    return f.where("n > 2")


@query("u4_unique_edges", PART + ", i AS (SELECT mesh_id, lo, hi, row_number() OVER (PARTITION BY mesh_id ORDER BY lo, hi) - 1 AS edge_id FROM edges) SELECT h.mesh_id, face_id, CAST(k AS INT) AS k, edge_id FROM he h JOIN i ON i.mesh_id = h.mesh_id AND i.lo = least(v0, v1) AND i.hi = greatest(v0, v1)")
def u4(spark, d):
    h = M.halfedges(mesh(spark, d)).withColumn("lo", F.least("v0", "v1")).withColumn("hi", F.greatest("v0", "v1"))
    return h.withColumn("edge_id", (F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("lo", "hi")) - 1).cast("long")).select("mesh_id", "face_id", "k", "edge_id")


@query("u5_remaining_edges", PART + "SELECT mesh_id, lo, hi FROM edges EXCEPT SELECT mesh_id, lo, hi FROM edges WHERE f0 % 3 = 0")
def u5(spark, d):
    e = M.edges(mesh(spark, d))
    return e.join(e.where("f0 % 3 = 0"), ["mesh_id", "lo", "hi"], "left_anti").select("mesh_id", "lo", "hi")


@query("m8_split_levels", PART + "SELECT mesh_id, CAST(greatest(0, ceil(round(log2(1000.0 / count(*)) / 2, 9))) AS BIGINT) AS levels FROM grid GROUP BY 1")
def m8(spark, d):
    n = mesh(spark, d).faces.groupBy("mesh_id").count()
    return n.select("mesh_id", F.greatest(F.lit(0), F.ceil(F.round(F.log2(1000.0 / F.col("count")) / 2, 9))).cast("long").alias("levels"))


@query("m10_pair_rows", PART + "SELECT mesh_id, face_id // 2 AS pair, count(*) = 2 AS full_pair, CAST(sum(face_id) AS BIGINT) AS ids FROM grid GROUP BY 1, 2")
def m10(spark, d):
    """Neighbouring face rows paired by position; an odd last row stays alone."""
    return mesh(spark, d).faces.groupBy("mesh_id", F.floor(F.col("face_id") / 2).alias("pair")).agg((F.count(F.lit(1)) == 2).alias("full_pair"), F.sum("face_id").alias("ids"))


@query("m13_edge_samples", PART + SIDES + "SELECT mesh_id, lo, hi, i AS step, round(lx + (hx - lx) * i / 3.0, 6) AS x, round(ly + (hy - ly) * i / 3.0, 6) AS y FROM wide, range(4) t(i) WHERE n = 1")
def m13(spark, d):
    m = mesh(spark, d)
    pos = lambda k, n: m.vertices.select("mesh_id", F.col("v_id").alias(k), *(F.col(c).alias(n + c) for c in "xyz"))
    e = M.edges(m).where("n_faces = 1").join(pos("lo", "a"), ["mesh_id", "lo"]).join(pos("hi", "b"), ["mesh_id", "hi"])
    e = e.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    at = lambda c: r6(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("step") / 3.0)
    return e.select("mesh_id", "lo", "hi", "step", at("x").alias("x"), at("y").alias("y"))


@query("n5_merge_pairs")
def n5(spark, d):
    """Triangles 2f and 2f + 1 merged again: the quads of the source come back."""
    m = mesh(spark, d)
    t = M.Mesh(m.vertices, G.quads_to_triangles(m))
    pairs = Q.mergeable_edges(t, free_only=False).where("f0 % 2 = 0 AND f1 = f0 + 1")
    return Q.merge_pairs(t, pairs).faces.select("mesh_id", "face_id", F.size("verts").alias("n"), joined(F.array_sort("verts")).alias("verts"))


@query("n9_all_charts", PART + "SELECT mesh_id, lo AS v_start, hi AS v_end, f0 AS c0, CASE WHEN n = 1 THEN -1 ELSE f1 END AS c1 FROM edges")
def n9(spark, d):
    """The arcs of a base complex in which every quad is a chart."""
    return M.edges(mesh(spark, d)).select("mesh_id", F.col("lo").alias("v_start"), F.col("hi").alias("v_end"), F.col("f0").alias("c0"), F.when(F.col("n_faces") == 1, F.lit(-1)).otherwise(F.col("f1")).cast("long").alias("c1"))


@query("n14_reindex_clusters", PART + "SELECT mesh_id, face_id, dense_rank() OVER (PARTITION BY mesh_id ORDER BY face_id * 7 % 11) - 1 AS cluster FROM grid")
def n14(spark, d):
    f = mesh(spark, d).faces
    return f.select("mesh_id", "face_id", (F.dense_rank().over(Window.partitionBy("mesh_id").orderBy(F.col("face_id") * 7 % 11)) - 1).cast("long").alias("cluster"))


@query("n24_drop_valence_two")
def n24(spark, d):
    """Quads cut in two along a new interior vertex of degree 2, and merged again."""
    m = mesh(spark, d)
    cut = m.faces.where("face_id % 3 = 0").withColumn("w", F.lit(1_000_000).cast("long") + F.col("face_id"))
    v = [F.get("verts", F.lit(i)) for i in range(4)]
    halves = cut.select("mesh_id", F.posexplode(F.array(F.array(v[0], v[1], v[2], F.col("w")), F.array(v[2], v[3], v[0], F.col("w")))).alias("i", "verts"), "face_id").select("mesh_id", (F.col("face_id") + F.col("i") * 1_000_000).alias("face_id"), "verts")
    out = Q.drop_valence_two(M.Mesh(m.vertices, m.faces.where("face_id % 3 <> 0").unionByName(halves)))
    return out.faces.select("mesh_id", "face_id", F.size("verts").alias("n"), joined(F.array_sort("verts")).alias("verts"))


ORACLE_SQL["n24_drop_valence_two"] = ORACLE_SQL["n5_quads"] = PART + "SELECT mesh_id, face_id, CAST(4 AS INT) AS n, string_agg(CAST(v_id AS VARCHAR), ',' ORDER BY v_id) AS verts FROM corners GROUP BY 1, 2"
ORACLE_SQL["n5_merge_pairs"] = PART + "SELECT mesh_id, face_id * 2 AS face_id, CAST(4 AS INT) AS n, string_agg(CAST(v_id AS VARCHAR), ',' ORDER BY v_id) AS verts FROM corners GROUP BY 1, 2"
del ORACLE_SQL["n5_quads"]


@query("n26_block_genus", PART + ", c AS (SELECT mesh_id, (SELECT count(*) FROM deg g WHERE g.mesh_id = d.mesh_id) AS v, a * b AS f FROM dims d WHERE kind = 2) SELECT mesh_id, CAST((2 + 2 * f - v - f) // 2 AS BIGINT) AS genus FROM c")
def n26(spark, d):
    m = mesh(spark, d)
    torus = dims(spark, d, "part").where("kind = 2").select("mesh_id")
    f = m.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("f"))
    v = m.vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("v"))
    return torus.join(f, "mesh_id").join(v, "mesh_id").select("mesh_id", F.expr("(2 + 2 * f - v - f) div 2").alias("genus"))


# ---- field expressions ----
def fold_pattern(c0, c1, div: int):
    """(cdf, dcdf) of a pattern repeated ``div`` times: 1 - cdf and dcdf folded to a denser wave."""
    wave = lambda t: F.abs(t * div - 2 * F.floor((t * div + 1) / 2))
    return F.lit(1.0) - wave(F.lit(1.0) - c0), wave(c1)


@query("f18_color_pattern", PART + ", w AS (SELECT mesh_id, face_id, (face_id * 7 % 11) / 10.0 AS c, (face_id * 3 % 7) / 6.0 AS e FROM grid) SELECT mesh_id, face_id, round(1 - abs((1 - c) * 3 - 2 * floor(((1 - c) * 3 + 1) / 2)), 6) AS cdf, round(abs(e * 3 - 2 * floor((e * 3 + 1) / 2)), 6) AS dcdf FROM w")
def f18(spark, d):
    c, e = fold_pattern((F.col("face_id") * 7 % 11) / 10.0, (F.col("face_id") * 3 % 7) / 6.0, 3)
    return mesh(spark, d).faces.select("mesh_id", "face_id", r6(c).alias("cdf"), r6(e).alias("dcdf"))


@query("f19_cluster_distance", PART + ", c AS (SELECT mesh_id, face_id, (x0 + x1 + x2 + x3) / 4 AS x, (y0 + y1 + y2 + y3) / 4 AS y, (z0 + z1 + z2 + z3) / 4 AS z FROM quads), s AS (SELECT *, first_value(x) OVER w AS sx, first_value(y) OVER w AS sy, first_value(z) OVER w AS sz FROM c WINDOW w AS (PARTITION BY mesh_id ORDER BY face_id)) SELECT mesh_id, face_id, round(sqrt((x - sx) ** 2 + (y - sy) ** 2 + (z - sz) ** 2), 6) AS distance FROM s")
def f19(spark, d):
    c = G.face_facts(mesh(spark, d)).select("mesh_id", "face_id", "c.x", "c.y", "c.z")
    s = c.where("face_id = 0").select("mesh_id", *(F.col(k).alias(f"s{k}") for k in "xyz"))
    return c.join(s, "mesh_id").select("mesh_id", "face_id", r6((V3.of() - V3.of("s")).length()).alias("distance"))


@query("f20_f21_grading", PART + ", g AS (SELECT mesh_id, face_id, s, t, (1 - t) * 1.0 + t * 0.25 AS c0, (1 - s) * 1.0 + s * 0.5 AS c1 FROM grid, (VALUES (0.2, 0.7), (0.5, 0.5), (0.9, 0.1)) AS p(s, t)) SELECT mesh_id, face_id, CAST(s AS DOUBLE) AS s, CAST(round(least(1 - c0, 1 - c1), 6) AS DOUBLE) AS cdf, CAST(round(least(c0, c1), 6) AS DOUBLE) AS dcdf FROM g")
def f20(spark, d):
    """cdf = min(1 - c0, 1 - c1) and dcdf = min(c0, c1) of two edge-interpolated colours."""
    p = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in ((0.2, 0.7), (0.5, 0.5), (0.9, 0.1)))))
    g = mesh(spark, d).faces.select("mesh_id", "face_id", p.alias("p")).select("mesh_id", "face_id", "p.s", "p.t")
    c0, c1 = (1 - F.col("t")) * 1.0 + F.col("t") * 0.25, (1 - F.col("s")) * 1.0 + F.col("s") * 0.5
    return g.select("mesh_id", "face_id", "s", r6(F.least(1 - c0, 1 - c1)).alias("cdf"), r6(F.least(c0, c1)).alias("dcdf"))


@query("f26_barycentric", PART + "SELECT mesh_id, face_id, round(0.2 * x0 + 0.3 * x1 + 0.5 * x2, 6) AS x, round(0.2 * y0 + 0.3 * y1 + 0.5 * y2, 6) AS y, round(0.2 * z0 + 0.3 * z1 + 0.5 * z2, 6) AS z FROM quads")
def f26(spark, d):
    q = G.quad_wide(mesh(spark, d))
    p = [V3.field(F.col(f"p{i}")) for i in range(3)]
    v = p[0] * 0.2 + p[1] * 0.3 + p[2] * 0.5
    return q.select("mesh_id", "face_id", *(r6(getattr(v, c)).alias(c) for c in "xyz"))


# ---- reports and exports ----
@query("k4_chart_edges", PART + "SELECT mesh_id, lo, hi FROM edges WHERE n = 1 OR f0 % 5 <> f1 % 5")
def k4(spark, d):
    return M.edges(mesh(spark, d)).where("n_faces = 1 OR f0 % 5 <> f1 % 5").select("mesh_id", "lo", "hi")


@query("k5_marked_edges", PART + ", m AS (SELECT mesh_id, lo, hi FROM edges WHERE (lo + hi) % 7 = 0), v AS (SELECT mesh_id, v, row_number() OVER (PARTITION BY mesh_id ORDER BY v) - 1 AS i FROM (SELECT mesh_id, lo AS v FROM m UNION SELECT mesh_id, hi FROM m)) SELECT m.mesh_id, a.i AS a, b.i AS b FROM m JOIN v a ON a.mesh_id = m.mesh_id AND a.v = lo JOIN v b ON b.mesh_id = m.mesh_id AND b.v = hi")
def k5(spark, d):
    """Flagged edges over vertices numbered anew."""
    e = M.edges(mesh(spark, d)).where("(lo + hi) % 7 = 0").select("mesh_id", "lo", "hi")
    v = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v")).distinct().withColumn("i", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("v")) - 1).cast("long"))
    at = lambda k, n: v.select("mesh_id", F.col("v").alias(k), F.col("i").alias(n))
    return e.join(at("lo", "a"), ["mesh_id", "lo"]).join(at("hi", "b"), ["mesh_id", "hi"]).select("mesh_id", "a", "b")


@query("k9_svg_paths", PART + ", b AS (SELECT mesh_id, min(x) AS ax, min(y) AS ay, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM vertices GROUP BY 1) SELECT mesh_id, face_id, string_agg(printf('%.3f %.3f', (x - ax) / s * 500, (y - ay) / s * 500), ' L ' ORDER BY k) AS path FROM placed JOIN b USING (mesh_id) GROUP BY 1, 2")
def k9(spark, d):
    """Face outlines of the xy projection, scaled to 500."""
    m = mesh(spark, d)
    b = m.vertices.groupBy("mesh_id").agg(F.min("x").alias("ax"), F.min("y").alias("ay"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("s"))
    p = G.face_points(m).join(b, "mesh_id")
    spot = F.transform("pts", lambda q: F.format_string("%.3f %.3f", (q["x"] - F.col("ax")) / F.col("s") * 500, (q["y"] - F.col("ay")) / F.col("s") * 500))
    return p.select("mesh_id", "face_id", F.array_join(spot, " L ").alias("path"))


@query("k15_quality_json")
def k15(spark, d):
    m = mesh(spark, d)
    rows = Q.report(m)
    return Q.as_json(rows.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes)))


@query("quality_report")
def quality_report(spark, d):
    rows = Q.report(mesh(spark, d, "nation"))
    return rows.select(*(r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query("l3_weld_boundaries", PART + "SELECT mesh_id, v.n AS n_vertices, e.n AS n_edges, e.m AS n_boundary_edges FROM (SELECT mesh_id, count(*) AS n FROM vertices GROUP BY 1) v JOIN (SELECT mesh_id, count(*) AS n, count(*) FILTER (n = 1) AS m FROM edges GROUP BY 1) e USING (mesh_id)")
def l3(spark, d):
    """Meshes cut in two along a row of faces; welding their boundaries closes the cut and nothing else."""
    m = mesh(spark, d)
    half = dims(spark, d, "part").selectExpr("mesh_id", "(a div 2) * b AS first")
    faces = m.faces.join(half, "mesh_id").select("mesh_id", "face_id", F.when(F.col("face_id") >= F.col("first"), F.transform("verts", lambda v: v + 1_000_000)).otherwise(F.col("verts")).alias("verts"))
    both = m.vertices.unionByName(m.vertices.withColumn("v_id", F.col("v_id") + 1_000_000))
    used = faces.select("mesh_id", F.explode("verts").alias("v_id")).distinct()
    out = X.weld_boundaries(M.Mesh(materialise(both.join(used, ["mesh_id", "v_id"], "left_semi")), materialise(faces)))
    t = M.topology(M.Mesh(out.vertices, materialise(out.faces)))
    return t.select("mesh_id", "n_vertices", "n_edges", "n_boundary_edges")


@query("l4_l5_manifold_part", PART + "SELECT mesh_id, CAST(a * b AS BIGINT) AS n_faces FROM dims WHERE mesh_id % 4 <> 0")
def l4(spark, d):
    """A mesh of which a face stands twice is a defect component and goes."""
    m = mesh(spark, d)
    twice = m.faces.where("mesh_id % 4 = 0 AND face_id = 0").withColumn("face_id", F.lit(1_000_000).cast("long"))
    out = X.manifold_part(M.Mesh(m.vertices, m.faces.unionByName(twice)))
    return out.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"))


@query("l4_weld_and_retry", PART + "SELECT mesh_id, CAST(CASE kind WHEN 1 THEN 0 ELSE a * b END AS BIGINT) AS at_once, CAST(a * b AS BIGINT) AS after_weld FROM dims")
def l4_retry(spark, d):
    """Cylinders slit open but for one pinched vertex: a defect unless the slit is welded, so only the second try keeps them."""
    m = mesh(spark, d)
    slit = dims(spark, d, "part").where("kind = 1").select("mesh_id", "a", "b")
    beyond = 1_000_000
    f = m.faces.join(slit, "mesh_id", "left")
    faces = f.withColumn("verts", F.when(F.expr("face_id div b = a - 1"), F.transform("verts", lambda v: F.when((v <= F.col("b")) & (v != 1), v + beyond).otherwise(v))).otherwise(F.col("verts"))).select("mesh_id", "face_id", "verts")
    copies = m.vertices.join(slit, "mesh_id").where("v_id <= b AND v_id <> 1").select("mesh_id", (F.col("v_id") + beyond).alias("v_id"), "x", "y", "z")
    cut = M.prepared(M.Mesh(m.vertices.unionByName(copies), faces))
    n = lambda out, name: out.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias(name))
    return cut.faces.select("mesh_id").distinct().join(n(X.manifold_part(cut), "at_once"), "mesh_id", "left").join(n(X.manifold_part(cut, retry=True), "after_weld"), "mesh_id", "left").na.fill(0)


@query("m5_split_growth", PART + "SELECT mesh_id, CAST(16 * a * b AS BIGINT) AS n_faces FROM dims")
def m5(spark, d):
    """Two rounds of midpoint splits: sixteen quads of every one."""
    return S.split_quads(S.split_quads(mesh(spark, d))).faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"))
