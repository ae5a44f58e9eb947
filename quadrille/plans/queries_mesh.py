"""Topology, geometry, loop and subdivision queries over derived meshes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions.vec import V3, angle, corner_angle, point_box, point_segment, point_triangle, rotate
from quadrille.operators import geometry as G
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators import subdivision as S
from quadrille.plans.derived import BENDS, SIDES, TRIANGLES, mesh, sql_prefix, turn

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


def r6(c):
    """Rounded for comparison; sums of doubles depend on their order."""
    return F.round(c, 6) + F.lit(0.0)


def _bend(name: str, a: str, b: str, c: str, e: str) -> str:
    """A table (mesh_id, face_id, bend): how far the triangles a-b-c and a-c-e of a quad are from flat, in degrees off a fold."""
    d = lambda o, x: f"({x}{o} - {x}{a})"
    n = lambda o, p: [f"{d(o, x)} * {d(p, y)} - {d(o, y)} * {d(p, x)}" for x, y in ("yz", "zx", "xy")]
    m, k = n(b, c), n(c, e)
    return f"""{name}_n AS (SELECT mesh_id, face_id, {", ".join(f"{t} AS m{i}" for i, t in enumerate(m))}, {", ".join(f"{t} AS k{i}" for i, t in enumerate(k))} FROM quads),
{name} AS (SELECT mesh_id, face_id, abs(180.0 - degrees(acos(least(1.0, greatest(-1.0, (m0 * k0 + m1 * k1 + m2 * k2) / sqrt((m0 * m0 + m1 * m1 + m2 * m2) * (k0 * k0 + k1 * k1 + k2 * k2))))))) AS bend FROM {name}_n)"""


def _segment(a: str, b: str) -> str:
    """SQL for the distance of corner 3 from the segment between two corners."""
    dot = " + ".join(f"({x}3 - {x}{a}) * ({x}{b} - {x}{a})" for x in "xyz")
    size = " + ".join(f"({x}{b} - {x}{a}) ** 2" for x in "xyz")
    t = f"least(1.0, greatest(0.0, ({dot}) / ({size})))"
    return "sqrt(" + " + ".join(f"({x}3 - {x}{a} - ({x}{b} - {x}{a}) * {t}) ** 2" for x in "xyz") + ")"


def _side(a: str, b: str, o: str) -> str:
    """SQL for the cross product of corner a to b and corner a to o, dotted with the normal n."""
    d = lambda p, x: f"({x}{p} - {x}{a})"
    return " + ".join(f"n{z} * ({d(b, x)} * {d(o, y)} - {d(b, y)} * {d(o, x)})" for z, x, y in ("xyz", "yzx", "zxy"))


_GAP = "greatest(least({x}0, {x}1, {x}2) - {x}3, 0.0, {x}3 - greatest({x}0, {x}1, {x}2)) ** 2"
_DISTANCES = f""", n AS (SELECT *, {", ".join(f"({x}1 - {x}0) * ({y}2 - {y}0) - ({y}1 - {y}0) * ({x}2 - {x}0) AS n{z}" for z, x, y in ("xyz", "yzx", "zxy"))} FROM quads)
SELECT mesh_id, face_id, round({_segment("0", "1")}, 6) + 0.0 AS segment,
round(CASE WHEN {_side("0", "1", "3")} >= 0 AND {_side("1", "2", "3")} >= 0 AND {_side("2", "0", "3")} >= 0 THEN abs((x3 - x0) * nx + (y3 - y0) * ny + (z3 - z0) * nz) / sqrt(nx * nx + ny * ny + nz * nz)
  ELSE least({_segment("0", "1")}, {_segment("1", "2")}, {_segment("2", "0")}) END, 6) + 0.0 AS triangle,
round(sqrt({" + ".join(_GAP.format(x=x) for x in "xyz")}), 6) + 0.0 AS box FROM n"""


def _smoothed(name: str, of: str, factor: float) -> str:
    """A table of vertices moved towards the mean of their neighbours, by inverse squared lengths; the boundary stays."""
    return f"""{name}_e AS (SELECT e.mesh_id, lo, hi, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, 1 / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS w FROM edges e JOIN {of} a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN {of} b ON b.mesh_id = e.mesh_id AND b.v_id = hi),
{name}_m AS (SELECT mesh_id, v_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * z) / sum(w) AS mz FROM (SELECT mesh_id, lo AS v_id, w, bx AS x, by_ AS y, bz AS z FROM {name}_e UNION ALL SELECT mesh_id, hi, w, ax, ay, az FROM {name}_e) GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT v.mesh_id, v.v_id, {", ".join(f"CASE WHEN boundary THEN {c} ELSE {c} + (m{c} - {c}) * {factor} END AS {c}" for c in "xyz")} FROM {of} v JOIN {name}_m USING (mesh_id, v_id) JOIN deg USING (mesh_id, v_id))"""


_COUNT_TABLES = """, tv AS (SELECT mesh_id, count(*) AS n_vertices, count(*) FILTER (boundary) AS n_boundary_vertices, count(*) FILTER (CASE WHEN boundary THEN degree <> 3 ELSE degree <> 4 END) AS n_irregular FROM deg GROUP BY 1),
te AS (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (n = 1) AS n_boundary_edges FROM edges GROUP BY 1),
tf AS (SELECT mesh_id, count(*) AS n_faces FROM grid GROUP BY 1)
"""
_COUNTS = _COUNT_TABLES + "SELECT mesh_id, n_vertices, n_boundary_vertices, n_irregular, n_edges, n_boundary_edges, n_faces, n_vertices - n_edges + n_faces AS euler FROM tv JOIN te USING (mesh_id) JOIN tf USING (mesh_id)"
#: Follows the counts: components over shared edges and curves of boundary edges, both by what is reached from every face or vertex.
_HOLES = """, fa AS (SELECT DISTINCT x.mesh_id, x.face_id AS a, y.face_id AS b FROM he x JOIN he y ON y.mesh_id = x.mesh_id AND y.v0 = x.v1 AND y.v1 = x.v0),
fr AS (SELECT mesh_id, face_id, face_id AS seen FROM grid UNION SELECT r.mesh_id, r.face_id, fa.b FROM fr r JOIN fa ON fa.mesh_id = r.mesh_id AND fa.a = r.seen),
tc AS (SELECT mesh_id, count(DISTINCT c) AS n_components FROM (SELECT mesh_id, face_id, min(seen) AS c FROM fr GROUP BY 1, 2) GROUP BY 1),
ba AS (SELECT mesh_id, lo AS a, hi AS b FROM edges WHERE n = 1 UNION ALL SELECT mesh_id, hi, lo FROM edges WHERE n = 1),
br AS (SELECT DISTINCT mesh_id, a AS v_id, a AS seen FROM ba UNION SELECT r.mesh_id, r.v_id, ba.b FROM br r JOIN ba ON ba.mesh_id = r.mesh_id AND ba.a = r.seen),
tb AS (SELECT mesh_id, count(DISTINCT c) AS n_boundaries FROM (SELECT mesh_id, v_id, min(seen) AS c FROM br GROUP BY 1, 2) GROUP BY 1)
SELECT mesh_id, n_vertices, n_boundary_vertices, n_irregular, n_edges, n_boundary_edges, n_faces, n_vertices - n_edges + n_faces AS euler, n_components, coalesce(n_boundaries, 0) AS n_boundaries,
CAST(trunc((2 * n_components + n_edges - coalesce(n_boundaries, 0) - n_faces - n_vertices) / 2.0) AS BIGINT) AS genus FROM tv JOIN te USING (mesh_id) JOIN tf USING (mesh_id) JOIN tc USING (mesh_id) LEFT JOIN tb USING (mesh_id)"""


@query("mesh_topology", NATION + _COUNTS)
def mesh_topology(spark, d):
    return M.topology(mesh(spark, d, "nation"))


@query("mesh_topology_large", PART + _COUNT_TABLES + _HOLES)
def mesh_topology_large(spark, d):
    return M.whole_topology(mesh(spark, d))


@query("j1_halfedge_pairs", PART + SIDES + "SELECT mesh_id, v0, v1, face_id, CAST(k AS INT) AS k, coalesce(pair_face, -1) AS pair_face, coalesce(pair_k, -1) AS pair_k FROM sides")
def j1(spark, d):
    return M.paired(mesh(spark, d)).select("mesh_id", "v0", "v1", "face_id", "k", F.coalesce("pair_face", F.lit(-1).cast("long")).alias("pair_face"), F.coalesce("pair_k", F.lit(-1)).alias("pair_k"))


@query("j2_edge_faces", PART + "SELECT mesh_id, lo, hi, n AS n_faces, f0, f1 FROM edges")
def j2(spark, d):
    return M.edges(mesh(spark, d))


@query("j3_face_adjacency", PART + SIDES + "SELECT mesh_id, face_id, pair_face AS across FROM sides WHERE pair_face IS NOT NULL")
def j3(spark, d):
    return M.face_adjacency(mesh(spark, d))


@query("j4_vertex_star", PART + """, o AS (SELECT mesh_id, lo AS v_id, hi AS o FROM edges UNION ALL SELECT mesh_id, hi, lo FROM edges),
f AS (SELECT mesh_id, v_id, string_agg(CAST(face_id AS VARCHAR), ',' ORDER BY face_id) AS faces FROM corners GROUP BY 1, 2)
SELECT mesh_id, v_id, faces, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS ring FROM o JOIN f USING (mesh_id, v_id) GROUP BY ALL""")
def j4(spark, d):
    return M.vertex_star(mesh(spark, d)).select("mesh_id", "v_id", F.concat_ws(",", F.col("faces").cast("array<string>")).alias("faces"), F.concat_ws(",", F.col("ring").cast("array<string>")).alias("ring"))


@query("j5_boundary_edges", PART + SIDES + "SELECT mesh_id, v0, v1, face_id FROM sides WHERE pair_face IS NULL")
def j5(spark, d):
    h = M.halfedges(mesh(spark, d))
    back = h.select("mesh_id", F.col("v1").alias("v0"), F.col("v0").alias("v1"))
    return h.join(back, ["mesh_id", "v0", "v1"], "left_anti").select("mesh_id", "v0", "v1", "face_id")


@query("p1_on_boundary", PART + "SELECT mesh_id, face_id, bool_or(n = 1) AS edge_open, bool_or(boundary) AS touches FROM he JOIN edges e USING (mesh_id) JOIN deg g ON g.mesh_id = he.mesh_id AND g.v_id = he.v0 WHERE e.lo = least(v0, v1) AND e.hi = greatest(v0, v1) GROUP BY 1, 2")
def p1(spark, d):
    m = mesh(spark, d)
    e = M.edges(m)
    h = M.halfedges(m).withColumn("lo", F.least("v0", "v1")).withColumn("hi", F.greatest("v0", "v1")).join(e.select("mesh_id", "lo", "hi", "n_faces"), ["mesh_id", "lo", "hi"])
    h = h.join(M.vertex_facts(e).select("mesh_id", F.col("v_id").alias("v0"), "boundary"), ["mesh_id", "v0"])
    return h.groupBy("mesh_id", "face_id").agg(F.bool_or(F.col("n_faces") == 1).alias("edge_open"), F.bool_or("boundary").alias("touches"))


@query("p2_mesh_type", PART + "SELECT f.mesh_id, bool_and(n = 4) AS is_quad, bool_and(n = 3) AS is_tri, max(CASE WHEN closed THEN 1 ELSE 0 END) = 1 AS is_closed FROM (SELECT mesh_id, face_id, count(*) AS n FROM corners GROUP BY 1, 2) f JOIN (SELECT mesh_id, bool_and(NOT boundary) AS closed FROM deg GROUP BY 1) c USING (mesh_id) GROUP BY 1")
def p2(spark, d):
    m = mesh(spark, d)
    kinds = m.faces.groupBy("mesh_id").agg(F.every(F.size("verts") == 4).alias("is_quad"), F.every(F.size("verts") == 3).alias("is_tri"))
    return kinds.join(M.vertex_facts(M.edges(m)).groupBy("mesh_id").agg(F.every(~F.col("boundary")).alias("is_closed")), "mesh_id")


@query("p3_a1_singular_vertices", PART + "SELECT mesh_id, v_id, degree, boundary, CASE WHEN boundary THEN degree <> 3 ELSE degree <> 4 END AS singular FROM deg")
def p3(spark, d):
    return M.vertex_facts(M.edges(mesh(spark, d))).withColumn("singular", M.singular())


@query("a2_bounding_box", PART + "SELECT mesh_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM vertices GROUP BY 1")
def a2(spark, d):
    return G.bounding_boxes(mesh(spark, d))


_REACH = """, reach AS (SELECT mesh_id, {n} AS node, {n} AS seen FROM {nodes} UNION SELECT r.mesh_id, r.node, l.b FROM reach r JOIN links l ON l.mesh_id = r.mesh_id AND l.a = r.seen),
comp AS (SELECT mesh_id, node, min(seen) AS component FROM reach GROUP BY 1, 2)"""


@query("g2_components", NATION + ", links AS (SELECT h.mesh_id, h.face_id AS a, p.face_id AS b FROM he h JOIN he p ON p.mesh_id = h.mesh_id AND p.v0 = h.v1 AND p.v1 = h.v0)" + _REACH.format(n="face_id", nodes="grid") + " SELECT mesh_id, node AS face_id, component AS comp_id FROM comp")
def g2(spark, d):
    return M.face_components(mesh(spark, d, "nation"))


@query("g3_boundary_loops", NATION + ", rim AS (SELECT * FROM edges WHERE n = 1), links AS (SELECT mesh_id, lo AS a, hi AS b FROM rim UNION ALL SELECT mesh_id, hi, lo FROM rim), spots_ AS (SELECT DISTINCT mesh_id, a AS v_id FROM links)" + _REACH.format(n="v_id", nodes="spots_") + " SELECT mesh_id, node AS v_id, component AS loop_id FROM comp")
def g3(spark, d):
    return M.boundary_loops(mesh(spark, d, "nation"))


@query("a3_genus", PART + """SELECT mesh_id, CAST(1 AS BIGINT) AS n_components, CAST(CASE kind WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS n_boundaries,
CAST((2 + e - CASE kind WHEN 1 THEN 2 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 END - f - v) // 2 AS BIGINT) AS genus FROM dims JOIN (SELECT mesh_id, count(*) AS e FROM edges GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS f FROM grid GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS v FROM deg GROUP BY 1) USING (mesh_id)""")
def a3(spark, d):
    return M.genus_table(mesh(spark, d))


@query("p4_nonmanifold", PART + """, bad AS (SELECT mesh_id, face_id, k, CASE WHEN face_id = 1 AND k = 2 AND mesh_id % 3 = 0 THEN first_value(v_id) OVER (PARTITION BY mesh_id, face_id ORDER BY k) ELSE v_id END AS v_id FROM corners
  UNION ALL SELECT c.mesh_id, 1000000, c.k, c.v_id FROM corners c WHERE c.mesh_id % 5 = 0 AND c.face_id = 0),
bh AS (SELECT c.mesh_id, c.face_id, c.k, c.v_id AS v0, n.v_id AS v1, p.v_id AS vp FROM bad c JOIN bad n ON n.mesh_id = c.mesh_id AND n.face_id = c.face_id AND n.k = (c.k + 1) % 4 JOIN bad p ON p.mesh_id = c.mesh_id AND p.face_id = c.face_id AND p.k = (c.k + 3) % 4),
be AS (SELECT mesh_id, least(v0, v1) AS lo, greatest(v0, v1) AS hi, count(*) AS n FROM bh GROUP BY ALL),
rc AS (SELECT mesh_id, count(*) FILTER (d < 4) AS repeated_corner FROM (SELECT mesh_id, face_id, count(DISTINCT v_id) AS d FROM bad GROUP BY 1, 2) GROUP BY 1),
ce AS (SELECT mesh_id, count(*) FILTER (n > 2) AS crowded_edge FROM be GROUP BY 1),
cb AS (SELECT mesh_id, count(*) FILTER (c > 2) AS crowded_boundary FROM (SELECT mesh_id, v, count(*) AS c FROM (SELECT mesh_id, lo AS v FROM be WHERE n = 1 UNION ALL SELECT mesh_id, hi FROM be WHERE n = 1) GROUP BY 1, 2) GROUP BY 1)
SELECT mesh_id, repeated_corner, crowded_edge, coalesce(crowded_boundary, 0) AS crowded_boundary FROM rc JOIN ce USING (mesh_id) LEFT JOIN cb USING (mesh_id)""")
def p4(spark, d):
    m = mesh(spark, d)
    bent = F.when((F.col("face_id") == 1) & (F.col("mesh_id") % 3 == 0), F.array(*(F.get("verts", F.lit(i)) for i in (0, 1, 0, 3)))).otherwise(F.col("verts"))
    twice = m.faces.where("mesh_id % 5 = 0 AND face_id = 0").withColumn("face_id", F.lit(1000000).cast("long"))
    return M.nonmanifold(M.Mesh(m.vertices, m.faces.withColumn("verts", bent).unionByName(twice))).drop("broken_star")


@query("g1_first_come_faces", PART + """, more AS (SELECT mesh_id, face_id, k, v_id FROM corners UNION ALL SELECT mesh_id, 1000000 + face_id, k, v_id FROM corners WHERE mesh_id % 5 = 0 AND face_id % 4 = 0),
mh AS (SELECT c.mesh_id, c.face_id, c.k, c.v_id AS v0, n.v_id AS v1 FROM more c JOIN more n ON n.mesh_id = c.mesh_id AND n.face_id = c.face_id AND n.k = (c.k + 1) % 4)
SELECT mesh_id, face_id FROM (SELECT mesh_id, face_id, row_number() OVER (PARTITION BY mesh_id, v0, v1 ORDER BY face_id, k) AS r FROM mh) GROUP BY 1, 2 HAVING max(r) = 1""")
def g1(spark, d):
    m = mesh(spark, d)
    more = m.faces.where("mesh_id % 5 = 0 AND face_id % 4 = 0").withColumn("face_id", F.col("face_id") + 1000000)
    return M.manifold_faces(M.Mesh(m.vertices, m.faces.unionByName(more))).select("mesh_id", "face_id")


@query("g14_compact_reversed", PART + """, ids AS (SELECT mesh_id, v_id, row_number() OVER (PARTITION BY mesh_id ORDER BY v_id) - 1 AS n FROM vertices)
SELECT mesh_id, face_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY (4 - k) % 4) AS verts FROM corners JOIN ids USING (mesh_id, v_id) GROUP BY 1, 2""")
def g14(spark, d):
    m = M.compacted(M.reversed_mesh(mesh(spark, d)))
    return m.faces.select("mesh_id", "face_id", F.concat_ws(",", F.col("verts").cast("array<string>")).alias("verts"))


@query("u1_concatenate", PART + """, sz AS (SELECT mesh_id, mesh_id % 16 AS into_, (SELECT max(v_id) + 1 FROM vertices v WHERE v.mesh_id = d.mesh_id) AS nv, a * b AS nf FROM dims d),
off AS (SELECT mesh_id, into_, coalesce(sum(nv) OVER w, 0) AS dv, coalesce(sum(nf) OVER w, 0) AS df FROM sz WINDOW w AS (PARTITION BY into_ ORDER BY mesh_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT into_ AS mesh_id, CAST(face_id + df AS BIGINT) AS face_id, string_agg(CAST(CAST(v_id + dv AS BIGINT) AS VARCHAR), ',' ORDER BY k) AS verts FROM corners JOIN off USING (mesh_id) GROUP BY 1, 2""")
def u1(spark, d):
    m = M.concatenated(mesh(spark, d), F.col("mesh_id") % 16)
    return m.faces.select("mesh_id", "face_id", F.concat_ws(",", F.col("verts").cast("array<string>")).alias("verts"))


# ---- geometry ----
@query("f9_edge_geometry", PART + SIDES + "SELECT mesh_id, lo, hi, round(sqrt((lx - hx) ** 2 + (ly - hy) ** 2 + (lz - hz) ** 2), 6) AS length, round((lx + hx) / 2, 6) AS mx, round((ly + hy) / 2, 6) AS my, round((lz + hz) / 2, 6) AS mz FROM wide")
def f9(spark, d):
    m = mesh(spark, d)
    return G.edge_geometry(m, M.edges(m)).select("mesh_id", "lo", "hi", *(r6(F.col(c)).alias(c) for c in ("length", "mx", "my", "mz")))


@query("f10_f12_face_facts", PART + """, n AS (SELECT mesh_id, face_id, (x0 + x1 + x2 + x3) / 4 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy, (z0 + z1 + z2 + z3) / 4 AS cz,
  (y0 * z1 - z0 * y1) + (y1 * z2 - z1 * y2) + (y2 * z3 - z2 * y3) + (y3 * z0 - z3 * y0) AS nx, (z0 * x1 - x0 * z1) + (z1 * x2 - x1 * z2) + (z2 * x3 - x2 * z3) + (z3 * x0 - x3 * z0) AS ny, (x0 * y1 - y0 * x1) + (x1 * y2 - y1 * x2) + (x2 * y3 - y2 * x3) + (x3 * y0 - y3 * x0) AS nz FROM quads),
a AS (SELECT *, 0.5 * sqrt(nx * nx + ny * ny + nz * nz) AS area FROM n)
SELECT mesh_id, face_id, round(area, 6) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(nx / (2 * area), 6) + 0.0 AS nx, round(ny / (2 * area), 6) + 0.0 AS ny, round(nz / (2 * area), 6) + 0.0 AS nz FROM a""")
def f10(spark, d):
    f = G.face_facts(mesh(spark, d))
    return f.select("mesh_id", "face_id", r6(F.col("area")).alias("area"), *(r6(F.col(f"{s}.{c}")).alias(s + c) for s in "cn" for c in "xyz"))


@query("f13_vertex_normals", PART + """, s AS (SELECT mesh_id, v_id, sum(nx / (2 * area)) AS x, sum(ny / (2 * area)) AS y, sum(nz / (2 * area)) AS z FROM corners JOIN areas USING (mesh_id, face_id) GROUP BY 1, 2)
SELECT mesh_id, v_id, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS x, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS y, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS z FROM s""")
def f13(spark, d):
    return G.vertex_normals(mesh(spark, d)).select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


def _dot(a, b, c):
    """Cosine at b between a and c, in SQL over the numbered quad columns."""
    d = lambda p, q, x: f"({x}{p} - {x}{q})"
    dot = " + ".join(f"{d(a, b, x)} * {d(c, b, x)}" for x in "xyz")
    n = lambda p: "sqrt(" + " + ".join(f"{d(p, b, x)} ** 2" for x in "xyz") + ")"
    return f"degrees(acos(least(1.0, greatest(-1.0, ({dot}) / ({n(a)} * {n(c)})))))"


_ANGLES = ", ang AS (SELECT mesh_id, face_id, " + ", ".join(f"{_dot((i + 3) % 4, i, (i + 1) % 4)} AS a{i}" for i in range(4)) + " FROM quads)"


@query("f14_quad_quality", PART + _ANGLES + "SELECT mesh_id, face_id, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2, round(a3, 6) AS a3, round(abs(a0 + a1 + a2 + a3 - 360), 6) AS planarity, round((abs(a0 - 90) + abs(a1 - 90) + abs(a2 - 90) + abs(a3 - 90)) / 4, 6) AS irregularity FROM ang")
def f14(spark, d):
    return G.quad_angles(mesh(spark, d)).select("mesh_id", "face_id", *(r6(F.col(c)).alias(c) for c in ("a0", "a1", "a2", "a3", "planarity", "irregularity")))


@query("f25_statistics", PART + _ANGLES + ", q AS (SELECT mesh_id, (abs(a0 - 90) + abs(a1 - 90) + abs(a2 - 90) + abs(a3 - 90)) / 4 AS r FROM ang) SELECT mesh_id, round(avg(r), 6) AS mean, round(max(r), 6) AS max, round(stddev_pop(r), 6) AS var FROM q GROUP BY 1")
def f25(spark, d):
    q = G.quad_angles(mesh(spark, d))
    return q.groupBy("mesh_id").agg(r6(F.avg("irregularity")).alias("mean"), r6(F.max("irregularity")).alias("max"), r6(F.stddev_pop("irregularity")).alias("var"))


@query("f15_scaled_jacobian", PART + ", c AS (SELECT mesh_id, face_id, least(" + ", ".join(
    "sqrt(" + " + ".join(f"(({u}{(i + 3) % 4} - {u}{i}) * ({w}{(i + 1) % 4} - {w}{i}) - ({w}{(i + 3) % 4} - {w}{i}) * ({u}{(i + 1) % 4} - {u}{i})) ** 2" for u, w in ("yz", "zx", "xy")) + f") / (sqrt({' + '.join(f'({x}{(i + 3) % 4} - {x}{i}) ** 2' for x in 'xyz')}) * sqrt({' + '.join(f'({x}{(i + 1) % 4} - {x}{i}) ** 2' for x in 'xyz')}) + 1e-12)" for i in range(4)) + ") AS sj FROM quads) SELECT mesh_id, round(avg(sj), 6) AS sj FROM c GROUP BY 1")
def f15(spark, d):
    return G.scaled_jacobians(mesh(spark, d)).groupBy("mesh_id").agg(r6(F.avg("sj")).alias("sj"))


@query("m7_f6_quads_to_triangles", PART + _ANGLES + """, s AS (SELECT q.mesh_id, q.face_id, v0, v1, v2, v3, round(a1 + a3, 9) >= round(a0 + a2, 9) AS cut FROM quads q JOIN ang USING (mesh_id, face_id))
SELECT mesh_id, face_id * 2 AS face_id, CASE WHEN cut THEN v0 || ',' || v1 || ',' || v2 ELSE v0 || ',' || v1 || ',' || v3 END AS verts FROM s UNION ALL SELECT mesh_id, face_id * 2 + 1, CASE WHEN cut THEN v0 || ',' || v2 || ',' || v3 ELSE v1 || ',' || v2 || ',' || v3 END FROM s""")
def m7(spark, d):
    return G.quads_to_triangles(mesh(spark, d)).select("mesh_id", "face_id", F.concat_ws(",", F.col("verts").cast("array<string>")).alias("verts"))


@query("f4_dihedral", PART + SIDES + BENDS + "SELECT mesh_id, v0, v1, round(dihedral, 3) AS dihedral FROM bends")
def f4(spark, d):
    return G.dihedral_angles(mesh(spark, d)).select("mesh_id", "v0", "v1", F.round("dihedral", 3).alias("dihedral"))


@query("f5_diagonal_dihedral", PART + ", " + ", ".join(_bend(f"d{i}", *c) for i, c in enumerate((("0", "1", "2", "3"), ("1", "2", "3", "0")))) + " SELECT mesh_id, face_id, round(greatest(d0.bend, d1.bend), 3) + 0.0 AS dihedral FROM d0 JOIN d1 USING (mesh_id, face_id)")
def f5(spark, d):
    """Largest of the dihedral angles that both diagonals of a quad give."""
    q = G.quad_wide(mesh(spark, d))
    p = [V3.field(F.col(f"p{i}")) for i in range(4)]
    bend = lambda a, b, c, e: F.abs(F.lit(180.0) - angle((b - a).cross(c - a), (c - a).cross(e - a)))
    return q.select("mesh_id", "face_id", (F.round(F.greatest(bend(*p), bend(p[1], p[2], p[3], p[0])), 3) + F.lit(0.0)).alias("dihedral"))


@query("f7_f16_transform", PART + "SELECT mesh_id, v_id, round(2 * (x * cos(radians(30)) - y * sin(radians(30))) + 1, 6) AS x, round(2 * (x * sin(radians(30)) + y * cos(radians(30))) - 2, 6) AS y, round(2 * z + 3, 6) AS z FROM vertices")
def f7(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    v = rotate(V3.of(), V3(zero, zero, one), F.lit(30.0)) * 2.0 + V3(one, F.lit(-2.0), F.lit(3.0))
    return mesh(spark, d).vertices.select("mesh_id", "v_id", r6(v.x).alias("x"), r6(v.y).alias("y"), r6(v.z).alias("z"))


@query("f3_triangle_angles", PART + TRIANGLES + f"SELECT mesh_id, face_id, round({turn('2', '0', '1')}, 6) AS a0, round({turn('0', '1', '2')}, 6) AS a1, round({turn('1', '2', '0')}, 6) AS a2, CAST(180 AS DOUBLE) AS total FROM tris")
def f3(spark, d):
    """The three angles of every triangle of the split quads; they sum to 180."""
    m = mesh(spark, d)
    t = G.face_points(M.Mesh(m.vertices, G.quads_to_triangles(m)))
    p = [V3.field(F.get("pts", F.lit(i))) for i in range(3)]
    a = [corner_angle(p[i - 1], p[i], p[(i + 1) % 3]) for i in range(3)]
    return t.select("mesh_id", "face_id", r6(a[0]).alias("a0"), r6(a[1]).alias("a1"), r6(a[2]).alias("a2"), r6(a[0] + a[1] + a[2]).alias("total"))


@query("a15_moments", PART + """, m AS (SELECT mesh_id, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM vertices GROUP BY 1)
SELECT v.mesh_id, round(max(mx), 6) AS mx, round(max(my), 6) AS my, round(max(mz), 6) AS mz, round(avg((x - mx) * (x - mx)), 6) AS cxx, round(avg((x - mx) * (y - my)), 6) + 0.0 AS cxy, round(avg((x - mx) * (z - mz)), 6) + 0.0 AS cxz, round(avg((y - my) * (y - my)), 6) AS cyy, round(avg((y - my) * (z - mz)), 6) + 0.0 AS cyz, round(avg((z - mz) * (z - mz)), 6) AS czz FROM vertices v JOIN m USING (mesh_id) GROUP BY 1""")
def a15(spark, d):
    m = G.moments(mesh(spark, d))
    return m.select("mesh_id", *(r6(F.col(c)).alias(c) for c in m.columns[1:]))


@query("m12_normalise", PART + """, b AS (SELECT mesh_id, min(x) AS ax, min(y) AS ay, min(z) AS az, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS s FROM vertices GROUP BY 1)
SELECT mesh_id, v_id, round((x - ax) / s, 6) AS x, round((y - ay) / s, 6) AS y, round((z - az) / s, 6) AS z FROM vertices JOIN b USING (mesh_id)""")
def m12(spark, d):
    return G.normalised(mesh(spark, d)).select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("f23_distances", PART + _DISTANCES)
def f23(spark, d):
    """Distances of every face's last corner from the segment, triangle and box of its first three."""
    q = G.quad_wide(mesh(spark, d))
    p = [V3.field(F.col(f"p{i}")) for i in range(4)]
    low = V3(*(F.least(*(getattr(v, c) for v in p[:3])) for c in "xyz"))
    high = V3(*(F.greatest(*(getattr(v, c) for v in p[:3])) for c in "xyz"))
    return q.select("mesh_id", "face_id", r6(point_segment(p[3], p[0], p[1])).alias("segment"), r6(point_triangle(p[3], p[0], p[1], p[2])).alias("triangle"), r6(point_box(p[3], low, high)).alias("box"))


# ---- subdivision ----
_SUBDIVIDED = """, fp AS (SELECT mesh_id, face_id, (x0 + x1 + x2 + x3) / 4 AS x, (y0 + y1 + y2 + y3) / 4 AS y, (z0 + z1 + z2 + z3) / 4 AS z FROM quads),
ed AS (SELECT e.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM edges e JOIN vertices a ON a.mesh_id = e.mesh_id AND a.v_id = lo JOIN vertices b ON b.mesh_id = e.mesh_id AND b.v_id = hi),
nv AS (SELECT mesh_id, max(v_id) + 1 AS nv FROM vertices GROUP BY 1),
fi AS (SELECT f.*, nv + row_number() OVER (PARTITION BY f.mesh_id ORDER BY face_id) - 1 AS id FROM fp f JOIN nv USING (mesh_id)),
nf AS (SELECT mesh_id, max(id) + 1 AS nf FROM fi GROUP BY 1),
ei AS (SELECT d.*, nf + row_number() OVER (PARTITION BY d.mesh_id ORDER BY lo, hi) - 1 AS id FROM ed d JOIN nf USING (mesh_id))"""


@query("m2_split_quads", PART + _SUBDIVIDED + "SELECT mesh_id, v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM vertices UNION ALL SELECT mesh_id, id, round(x, 6), round(y, 6), round(z, 6) FROM fi UNION ALL SELECT mesh_id, id, round((ax + bx) / 2, 6), round((ay + by_) / 2, 6), round((az + bz) / 2, 6) FROM ei")
def m2(spark, d):
    return S.split_quads(mesh(spark, d)).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("m2_split_topology", PART + "SELECT mesh_id, n_v + n_e + n_f AS n_vertices, 2 * n_e + 4 * n_f AS n_edges, 4 * n_f AS n_faces FROM (SELECT mesh_id, count(*) AS n_v FROM deg GROUP BY 1) JOIN (SELECT mesh_id, count(*) AS n_e FROM edges GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS n_f FROM grid GROUP BY 1) USING (mesh_id)")
def m2_topology(spark, d):
    return M.topology(S.split_quads(mesh(spark, d))).select("mesh_id", "n_vertices", "n_edges", "n_faces")


@query("m1_catmull_clark", PART + _SUBDIVIDED + """, q AS (SELECT c.mesh_id, c.v_id, avg(x) AS qx, avg(y) AS qy, avg(z) AS qz FROM corners c JOIN fp USING (mesh_id, face_id) GROUP BY 1, 2),
rr AS (SELECT mesh_id, v_id, avg(x) AS rx, avg(y) AS ry, avg(z) AS rz, sum(x) FILTER (n = 1) AS ex, sum(y) FILTER (n = 1) AS ey, sum(z) FILTER (n = 1) AS ez FROM (SELECT mesh_id, lo AS v_id, n, bx AS x, by_ AS y, bz AS z FROM ed UNION ALL SELECT mesh_id, hi, n, ax, ay, az FROM ed) GROUP BY 1, 2),
nw AS (SELECT v.mesh_id, v.v_id, """ + ", ".join(f"CASE WHEN degree = 2 THEN {c} WHEN boundary THEN e{c} / 8 + {c} * 0.75 ELSE (q{c} + {c} + r{c} + (degree - 3) * {c}) / degree END AS {c}" for c in "xyz") + """ FROM vertices v JOIN deg USING (mesh_id, v_id) JOIN q USING (mesh_id, v_id) JOIN rr USING (mesh_id, v_id)),
ep AS (SELECT e.mesh_id, e.id, """ + ", ".join(f"CASE WHEN n = 1 THEN (a{c} + b{d}) / 2 ELSE (a{c} + b{d} + s.{c} + t.{c}) / 4 END AS {c}" for c, d in (("x", "x"), ("y", "y_"), ("z", "z"))) + """ FROM ei e JOIN fp s ON s.mesh_id = e.mesh_id AND s.face_id = f0 JOIN fp t ON t.mesh_id = e.mesh_id AND t.face_id = f1)
SELECT mesh_id, v_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM nw UNION ALL SELECT mesh_id, id, round(x, 6), round(y, 6), round(z, 6) FROM fi UNION ALL SELECT mesh_id, id, round(x, 6), round(y, 6), round(z, 6) FROM ep""".replace("by_", "by_"))
def m1(spark, d):
    return S.catmull_clark(mesh(spark, d)).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("m4_split_triangles", PART + "SELECT mesh_id, n_v + n_e + n_f AS n_vertices, 2 * (n_e + n_f) + 3 * 2 * n_f AS n_edges, 8 * n_f AS n_faces FROM (SELECT mesh_id, count(*) AS n_v FROM deg GROUP BY 1) JOIN (SELECT mesh_id, count(*) AS n_e FROM edges GROUP BY 1) USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS n_f FROM grid GROUP BY 1) USING (mesh_id)")
def m4(spark, d):
    m = mesh(spark, d)
    out, _ = S.split_triangles(M.Mesh(m.vertices, G.quads_to_triangles(m)))
    return M.topology(out).select("mesh_id", "n_vertices", "n_edges", "n_faces")


@query("m3_u2_cluster_sets", PART + """, s AS (SELECT DISTINCT mesh_id, v_id, face_id % 5 AS c FROM corners), p AS (SELECT e.mesh_id, lo, hi, a.c AS c, EXISTS (SELECT 1 FROM s b WHERE b.mesh_id = e.mesh_id AND b.v_id = hi AND b.c = a.c) AS both_ FROM edges e JOIN s a ON a.mesh_id = e.mesh_id AND a.v_id = lo),
t AS (SELECT mesh_id, lo, hi, c FROM p WHERE both_ UNION SELECT e.mesh_id, lo, hi, s.c FROM edges e JOIN s ON s.mesh_id = e.mesh_id AND s.v_id IN (lo, hi) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.mesh_id = e.mesh_id AND p.lo = e.lo AND p.hi = e.hi AND both_))
SELECT mesh_id, lo, hi, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS clusters FROM t GROUP BY 1, 2, 3""")
def m3(spark, d):
    m = mesh(spark, d)
    # Five clusters are five bits, which a hash aggregate takes in rows of fixed width; gathered sets would be sorted.
    bits = M.corners(m).groupBy("mesh_id", "v_id").agg(F.expr("bit_or(shiftleft(1, CAST(face_id % 5 AS INT)))").alias("bits"))
    sets = bits.select("mesh_id", "v_id", F.expr("filter(sequence(0L, 4L), c -> getbit(bits, CAST(c AS INT)) = 1)").alias("clusters"))
    return S.inherit_clusters(m, sets).select("mesh_id", "lo", "hi", F.concat_ws(",", F.col("clusters").cast("array<string>")).alias("clusters"))


@query("m6_laplacian_step", PART + SIDES + ", sm0 AS (SELECT * FROM vertices), " + _smoothed("sm1", "sm0", 0.5) + " SELECT mesh_id, v_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM sm1")
def m6(spark, d):
    return S.smooth(mesh(spark, d), 0.5).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


@query("m6_taubin", PART + SIDES + ", sm0 AS (SELECT * FROM vertices), " + _smoothed("sm1", "sm0", 0.4507) + ", " + _smoothed("sm2", "sm1", -0.4720) + " SELECT mesh_id, v_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM sm2")
def m6_taubin(spark, d):
    return S.taubin(mesh(spark, d)).vertices.select("mesh_id", "v_id", *(r6(F.col(c)).alias(c) for c in "xyz"))


# ---- loops ----
_FACE_LOOPS = """, ways AS (SELECT mesh_id, face_id, 0 AS way, least(v0, v1) * 2147483648 + greatest(v0, v1) AS a, least(v2, v3) * 2147483648 + greatest(v2, v3) AS b FROM quads UNION ALL SELECT mesh_id, face_id, 1, least(v1, v2) * 2147483648 + greatest(v1, v2), least(v3, v0) * 2147483648 + greatest(v3, v0) FROM quads),
links AS (SELECT mesh_id, a, b FROM ways UNION ALL SELECT mesh_id, b, a FROM ways), en AS (SELECT DISTINCT mesh_id, a AS e FROM links)""" + _REACH.format(n="e", nodes="en") + """,
fl AS (SELECT w.mesh_id, face_id, way, component AS loop_id FROM ways w JOIN comp c ON c.mesh_id = w.mesh_id AND c.node = w.a),
kept AS (SELECT mesh_id, loop_id FROM fl GROUP BY 1, 2 HAVING count(*) >= 2)"""
_EDGE_LOOPS = """, spot AS (SELECT e.mesh_id, v.v_id, lo * 2147483648 + hi AS e, n, f0, f1, degree, boundary FROM edges e JOIN deg v ON v.mesh_id = e.mesh_id AND v.v_id IN (lo, hi)),
half AS (SELECT x.mesh_id, x.e AS a, y.e AS b FROM spot x JOIN spot y ON y.mesh_id = x.mesh_id AND y.v_id = x.v_id AND y.e <> x.e WHERE (x.boundary AND x.degree = 3 AND x.n = 1 AND y.n = 1) OR (NOT x.boundary AND x.degree = 4 AND x.f0 NOT IN (y.f0, y.f1) AND x.f1 NOT IN (y.f0, y.f1))),
links AS (SELECT * FROM half), en AS (SELECT DISTINCT mesh_id, e FROM spot)""" + _REACH.format(n="e", nodes="en") + """,
el AS (SELECT e.mesh_id, lo, hi, n, f0, f1, component AS loop_id FROM edges e JOIN comp c ON c.mesh_id = e.mesh_id AND c.node = lo * 2147483648 + hi)"""


@query("g5_face_loops", NATION + _FACE_LOOPS + "SELECT mesh_id, face_id, way, loop_id FROM fl SEMI JOIN kept USING (mesh_id, loop_id)")
def g5(spark, d):
    return L.face_loops(mesh(spark, d, "nation"))


@query("a10_face_loop_stats", NATION + _FACE_LOOPS + ", per AS (SELECT mesh_id, loop_id, face_id, count(*) AS n FROM fl SEMI JOIN kept USING (mesh_id, loop_id) GROUP BY 1, 2, 3) SELECT mesh_id, loop_id, CAST(sum(n) AS BIGINT) AS n_links, count(*) FILTER (n > 1) AS n_crossed, round(sum(n * area), 6) AS weight FROM per JOIN areas USING (mesh_id, face_id) GROUP BY 1, 2")
def a10(spark, d):
    return L.face_loop_stats(mesh(spark, d, "nation")).withColumn("weight", r6(F.col("weight")))


@query("g4_edge_loops", NATION + _EDGE_LOOPS + "SELECT mesh_id, lo, hi, loop_id FROM el")
def g4(spark, d):
    return L.edge_loops(mesh(spark, d, "nation")).select("mesh_id", "lo", "hi", "loop_id")


_EDGE_STATS = _EDGE_LOOPS + """, ew AS (SELECT el.mesh_id, loop_id, count(*) AS n_edges, sum(a.area + CASE WHEN n > 1 THEN b.area ELSE 0 END) AS weight FROM el JOIN areas a ON a.mesh_id = el.mesh_id AND a.face_id = f0 JOIN areas b ON b.mesh_id = el.mesh_id AND b.face_id = f1 GROUP BY 1, 2),
ex AS (SELECT mesh_id, loop_id, count(*) FILTER (c > 2) AS n_crossed FROM (SELECT mesh_id, loop_id, v, count(*) AS c FROM (SELECT mesh_id, loop_id, lo AS v FROM el UNION ALL SELECT mesh_id, loop_id, hi FROM el) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("a9_edge_loop_stats", NATION + _EDGE_STATS + "SELECT mesh_id, loop_id, n_edges, n_crossed, round(weight, 6) AS weight FROM ew JOIN ex USING (mesh_id, loop_id)")
def a9(spark, d):
    return L.edge_loop_stats(mesh(spark, d, "nation")).select("mesh_id", "loop_id", "n_edges", "n_crossed", r6(F.col("weight")).alias("weight"))


@query("a5_fratio", NATION + _FACE_LOOPS + ", per AS (SELECT mesh_id, loop_id, face_id, count(*) AS n FROM fl SEMI JOIN kept USING (mesh_id, loop_id) GROUP BY 1, 2, 3), st AS (SELECT mesh_id, loop_id, max(n) AS x, sum(n * area) AS w FROM per JOIN areas USING (mesh_id, face_id) GROUP BY 1, 2) SELECT mesh_id, round(coalesce(sum(w) FILTER (x = 1), 0) / sum(w), 6) AS fratio FROM st GROUP BY 1")
def a5(spark, d):
    return L.simple_ratios(mesh(spark, d, "nation")).select("mesh_id", r6(F.col("fratio")).alias("fratio"))


@query("a6_eratio", NATION + _EDGE_STATS + "SELECT mesh_id, round(coalesce(sum(weight) FILTER (n_crossed = 0), 0) / sum(weight), 6) AS eratio FROM ew JOIN ex USING (mesh_id, loop_id) GROUP BY 1")
def a6(spark, d):
    return L.simple_ratios(mesh(spark, d, "nation")).select("mesh_id", r6(F.col("eratio")).alias("eratio"))


_COMPLEX = _EDGE_LOOPS + """, hit AS (SELECT DISTINCT el.mesh_id, loop_id FROM el JOIN deg g ON g.mesh_id = el.mesh_id AND g.v_id IN (lo, hi) WHERE CASE WHEN boundary THEN degree <> 3 ELSE degree <> 4 END), cx AS (SELECT el.* FROM el SEMI JOIN hit USING (mesh_id, loop_id))"""


@query("g6_base_complex", NATION + _COMPLEX + "SELECT mesh_id, lo, hi, loop_id FROM cx")
def g6(spark, d):
    return L.complex_edges(mesh(spark, d, "nation")).select("mesh_id", "lo", "hi", "loop_id")


@query("a12_charts", NATION + _COMPLEX + ", fa AS (SELECT e.mesh_id, f0, f1 FROM edges e ANTI JOIN cx USING (mesh_id, lo, hi) WHERE n = 2), fk AS (SELECT mesh_id, f0 AS a, f1 AS b FROM fa UNION ALL SELECT mesh_id, f1, f0 FROM fa), freach AS (SELECT mesh_id, face_id AS node, face_id AS seen FROM grid UNION SELECT r.mesh_id, r.node, l.b FROM freach r JOIN fk l ON l.mesh_id = r.mesh_id AND l.a = r.seen) SELECT mesh_id, node AS face_id, min(seen) AS chart_id FROM freach GROUP BY 1, 2")
def a12(spark, d):
    return L.charts(mesh(spark, d, "nation"))


@query("a5_a6_simple_ratios_large", None)
def ratios_large(spark, d):
    out = L.simple_ratios(mesh(spark, d))
    return out.select("mesh_id", r6(F.col("fratio")).alias("fratio"), r6(F.col("eratio")).alias("eratio"))


_CHARTS = ORACLE_SQL["a12_charts"].rsplit("SELECT mesh_id, node AS face_id", 1)[0] + """, ch AS (SELECT mesh_id, node AS face_id, min(seen) AS chart_id FROM freach GROUP BY 1, 2),
per AS (SELECT mesh_id, chart_id, sum(area) AS area FROM ch JOIN areas USING (mesh_id, face_id) GROUP BY 1, 2),
st AS (SELECT mesh_id, count(*) AS n_charts, max(area) / sum(area) AS max_area_ratio, min(area) / sum(area) AS min_area_ratio, avg(area) AS mean_area FROM per GROUP BY 1)""" + SIDES + """, bo AS (SELECT w.mesh_id, s.chart_id AS c0, CASE WHEN w.n = 1 THEN -1 ELSE t.chart_id END AS c1, sqrt((lx - hx) ** 2 + (ly - hy) ** 2 + (lz - hz) ** 2) AS length
  FROM wide w JOIN edges e ON e.mesh_id = w.mesh_id AND e.lo = w.lo AND e.hi = w.hi JOIN ch s ON s.mesh_id = e.mesh_id AND s.face_id = f0 JOIN ch t ON t.mesh_id = e.mesh_id AND t.face_id = f1),
sh AS (SELECT mesh_id, min(length) AS min_border FROM (SELECT mesh_id, least(c0, c1) AS x, greatest(c0, c1) AS y, sum(length) AS length FROM bo WHERE c0 <> c1 GROUP BY 1, 2, 3) GROUP BY 1)
SELECT mesh_id, n_charts, round(max_area_ratio, 6) AS max_area_ratio, round(min_area_ratio, 6) AS min_area_ratio, round(mean_area, 6) AS mean_area, round(coalesce(min_border, 0), 6) AS min_border FROM st LEFT JOIN sh USING (mesh_id)"""


@query("a13_chart_distribution_nation", _CHARTS)
def a13_nation(spark, d):
    out = L.chart_distribution(mesh(spark, d, "nation")).na.fill(0.0, ["min_border"])
    return out.select("mesh_id", "n_charts", *(r6(F.col(c)).alias(c) for c in ("max_area_ratio", "min_area_ratio", "mean_area", "min_border")))


@query("a13_chart_distribution", None)
def a13(spark, d):
    out = L.chart_distribution(mesh(spark, d))
    return out.select("mesh_id", "n_charts", *(r6(F.col(c)).alias(c) for c in ("max_area_ratio", "min_area_ratio", "mean_area", "min_border")))
