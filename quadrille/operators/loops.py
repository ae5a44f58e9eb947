"""Face loops, edge loops and the base complex, restated as components.

Nodes are undirected edges. A face loop is a component under the links that
join the opposite sides of every quad; an edge loop one under the links that
go straight on through regular vertices. Neither needs a walk.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.local_components import components_by_mesh
from quadrille.operators.geometry import face_areas
from quadrille.operators.mesh import Mesh, edges, face_components, paired, prepared, singular, vertex_facts

SPAN = 1 << 31


def edge_key(a: Column, b: Column) -> Column:
    """One long for an undirected edge; vertex ids are below 2^31."""
    return F.least(a, b) * F.lit(SPAN) + F.greatest(a, b)


def face_loop_links(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, way, a, b): both pairs of opposite sides of every quad."""
    v = [F.get("verts", F.lit(i)) for i in range(4)]
    way = lambda i: F.struct(F.lit(i).alias("way"), edge_key(v[i], v[i + 1]).alias("a"), edge_key(v[(i + 2) % 4], v[(i + 3) % 4]).alias("b"))
    return m.faces.where(F.size("verts") == 4).select("mesh_id", "face_id", F.explode(F.array(way(0), way(1))).alias("l")).select("mesh_id", "face_id", "l.*")


def face_loops(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, way, loop_id): loops of at least two links."""
    links = face_loop_links(m)
    comp = components_by_mesh(links.select("mesh_id", "a", "b"), parts=m.parts)
    held = links.join(comp.select("mesh_id", F.col("node").alias("a"), F.col("component").alias("loop_id")), ["mesh_id", "a"])
    enough = held.groupBy("mesh_id", "loop_id").count().where("count >= 2").select("mesh_id", "loop_id")
    return held.join(enough, ["mesh_id", "loop_id"], "left_semi").select("mesh_id", "face_id", "way", "loop_id")


def face_loop_stats(m: Mesh) -> DataFrame:
    """(mesh_id, loop_id, n_links, n_crossed, weight): links, faces met twice and summed face area."""
    per = face_loops(m).groupBy("mesh_id", "loop_id", "face_id").agg(F.count(F.lit(1)).alias("n")).join(face_areas(m), ["mesh_id", "face_id"])
    return per.groupBy("mesh_id", "loop_id").agg(F.sum("n").alias("n_links"), F.count_if(F.col("n") > 1).alias("n_crossed"), F.sum(F.col("n") * F.col("area")).alias("weight"))


def edge_loops(m: Mesh, e: DataFrame | None = None) -> DataFrame:
    """(mesh_id, lo, hi, n_faces, f0, f1, loop_id): every edge with the loop it lies on.

    At an interior vertex of degree 4 an edge goes on into the one it shares no
    face with; at a boundary vertex of degree 3 the boundary edges go on into each
    other; singular vertices end loops.
    """
    e = edges(m) if e is None else e
    key = edge_key(F.col("lo"), F.col("hi"))
    ends = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v_id"), key.alias("e"), "n_faces", "f0", "f1")
    # One row a vertex, of fixed width: its degree, the ends of its border edges and its first four edges.
    place = F.row_number().over(Window.partitionBy("mesh_id", "v_id").orderBy("e"))
    rim, nth = F.when(F.col("n_faces") == 1, F.col("e")), lambda i, c: F.max(F.when(F.col("r") == i + 1, F.col(c))).alias(f"{c}_{i}")
    at = ends.withColumn("r", place).groupBy("mesh_id", "v_id").agg(F.count(F.lit(1)).alias("degree"), F.bool_or(F.col("n_faces") == 1).alias("boundary"), F.min(rim).alias("rim_a"), F.max(rim).alias("rim_b"), *(nth(i, c) for i in range(4) for c in ("e", "f0", "f1")))
    # Of four edges around a vertex, opposite ones share no face.
    far = lambda i, j: reduce(and_, (F.col(f"{x}_{i}") != F.col(f"{y}_{j}") for x in ("f0", "f1") for y in ("f0", "f1")))
    link = lambda c, a, b: F.when(c, F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    rims = link(F.col("boundary") & (F.col("degree") == 3), "rim_a", "rim_b")
    through = [link(~F.col("boundary") & (F.col("degree") == 4) & far(i, j), f"e_{i}", f"e_{j}") for i, j in combinations(range(4), 2)]
    links = at.select("mesh_id", F.explode(F.array(rims, *through)).alias("l")).where("l IS NOT NULL").select("mesh_id", "l.a", "l.b")
    alone = e.select("mesh_id", key.alias("a"), key.alias("b"))
    comp = components_by_mesh(links.unionByName(alone), parts=m.parts)
    return e.withColumn("node", key).join(comp, ["mesh_id", "node"]).select("mesh_id", "lo", "hi", "n_faces", "f0", "f1", F.col("component").alias("loop_id"))


def edge_loop_stats(m: Mesh, loops: DataFrame | None = None) -> DataFrame:
    """(mesh_id, loop_id, n_edges, n_crossed, weight): vertices met more than twice, and the areas beside the edges."""
    m = prepared(m)
    loops = m.once("edge_loops", lambda: edge_loops(m), in_place=False) if loops is None else loops
    beside = F.array(F.struct(F.col("f0").alias("face_id"), F.lit(1).alias("first")), F.struct(F.when(F.col("n_faces") > 1, F.col("f1")).alias("face_id"), F.lit(0).alias("first")))
    sides = loops.select("mesh_id", "loop_id", F.explode(beside).alias("s")).select("mesh_id", "loop_id", "s.face_id", "s.first").where("face_id IS NOT NULL")
    weights = sides.join(face_areas(m), ["mesh_id", "face_id"]).groupBy("mesh_id", "loop_id").agg(F.sum("first").alias("n_edges"), F.sum("area").alias("weight"))
    met = loops.select("mesh_id", "loop_id", F.explode(F.array("lo", "hi")).alias("v_id")).groupBy("mesh_id", "loop_id", "v_id").count()
    crossed = met.groupBy("mesh_id", "loop_id").agg(F.count_if(F.col("count") > 2).alias("n_crossed"))
    return weights.join(crossed, ["mesh_id", "loop_id"])


def simple_ratios(m: Mesh) -> DataFrame:
    """(mesh_id, fratio, eratio): weight share of the loops that never cross themselves; 1 without loops."""
    m = prepared(m)
    share = lambda name: F.coalesce(F.sum(F.when(F.col("n_crossed") == 0, F.col("weight")).otherwise(F.lit(0.0))) / F.when(F.sum("weight") > 0, F.sum("weight")), F.lit(1.0)).alias(name)
    f = face_loop_stats(m).groupBy("mesh_id").agg(share("fratio"))
    e = edge_loop_stats(m).groupBy("mesh_id").agg(share("eratio"))
    return m.faces.select("mesh_id").distinct().join(f, "mesh_id", "left").join(e, "mesh_id", "left").na.fill(1.0, ["fratio", "eratio"])


def complex_edges(m: Mesh, loops: DataFrame | None = None) -> DataFrame:
    """Edges of the loops that touch a singular vertex."""
    m = prepared(m)
    e = edges(m)
    loops = m.once("edge_loops", lambda: edge_loops(m, e), in_place=False) if loops is None else loops
    sharp = vertex_facts(e).where(singular()).select("mesh_id", "v_id")
    hit = loops.select("mesh_id", "loop_id", F.explode(F.array("lo", "hi")).alias("v_id")).join(sharp, ["mesh_id", "v_id"], "left_semi").select("mesh_id", "loop_id").distinct()
    return loops.join(hit, ["mesh_id", "loop_id"], "left_semi")


def framed_edges(m: Mesh, sharp: float = 130.0, share: float = 0.5) -> DataFrame:
    """Edges of the base complex, of loops on the border, and of loops that are sharp over a share of their length."""
    m = prepared(m)
    from quadrille.operators.geometry import dihedral_angles, edge_geometry

    e = edges(m)
    loops = edge_loops(m, e)
    bent = dihedral_angles(m).where(F.col("dihedral") < sharp).select("mesh_id", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi")).distinct().withColumn("sharp", F.lit(True))
    length = edge_geometry(m, e).join(loops.select("mesh_id", "lo", "hi", "loop_id"), ["mesh_id", "lo", "hi"]).join(bent, ["mesh_id", "lo", "hi"], "left")
    per = length.groupBy("mesh_id", "loop_id").agg(F.bool_or(F.col("n_faces") == 1).alias("rim"), F.sum(F.when(F.col("sharp"), F.col("length")).otherwise(0.0)).alias("bent"), F.sum("length").alias("length"))
    wanted = per.where(F.col("rim") | (F.col("bent") >= share * F.col("length"))).select("mesh_id", "loop_id")
    found = complex_edges(m, loops).select("mesh_id", "loop_id").unionByName(wanted).distinct()
    return loops.join(found, ["mesh_id", "loop_id"], "left_semi")


def charts(m: Mesh, complex_: DataFrame | None = None) -> DataFrame:
    """(mesh_id, face_id, chart_id): faces hanging together without crossing the base complex."""
    m = prepared(m)
    walls = (complex_edges(m) if complex_ is None else complex_).select("mesh_id", edge_key(F.col("lo"), F.col("hi")).alias("e"))
    open_ = paired(m).where("pair_face IS NOT NULL").select("mesh_id", "face_id", F.col("pair_face").alias("across"), edge_key(F.col("v0"), F.col("v1")).alias("e")).join(walls, ["mesh_id", "e"], "left_anti")
    return face_components(m, open_).withColumnRenamed("comp_id", "chart_id")


def chart_distribution(m: Mesh, labels: DataFrame | None = None) -> DataFrame:
    """(mesh_id, n_charts, max_area_ratio, min_area_ratio, mean_area, min_border): chart sizes and shortest shared border."""
    m = prepared(m)
    from quadrille.operators.geometry import edge_geometry

    labels = charts(m) if labels is None else labels
    per = labels.join(face_areas(m), ["mesh_id", "face_id"]).groupBy("mesh_id", "chart_id").agg(F.sum("area").alias("area"))
    stats = per.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_charts"), (F.max("area") / F.sum("area")).alias("max_area_ratio"), (F.min("area") / F.sum("area")).alias("min_area_ratio"), F.avg("area").alias("mean_area"))
    c = lambda f, n: labels.select("mesh_id", F.col("face_id").alias(f), F.col("chart_id").alias(n))
    e = edge_geometry(m, edges(m)).join(c("f0", "c0"), ["mesh_id", "f0"]).join(c("f1", "c1"), ["mesh_id", "f1"])
    other = F.when(F.col("n_faces") == 1, F.lit(-1)).otherwise(F.col("c1"))
    border = e.withColumn("c1", other).where("c0 <> c1").groupBy("mesh_id", F.least("c0", "c1").alias("x"), F.greatest("c0", "c1").alias("y")).agg(F.sum("length").alias("length"))
    return stats.join(border.groupBy("mesh_id").agg(F.min("length").alias("min_border")), "mesh_id", "left")


def arc_positions(path: DataFrame) -> DataFrame:
    """Ordered chains (mesh_id, loop_id, pos, v_id, x, y, z) with the length run up to every vertex and in all."""
    w = Window.partitionBy("mesh_id", "loop_id").orderBy("pos")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    step = path.withColumn("step", F.coalesce(F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z")), F.lit(0.0)))
    total = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return step.withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", total)


def points_at(path: DataFrame, **shares: float) -> DataFrame:
    """(mesh_id, loop_id, length, <name>...): the first vertex of every chain at or beyond a share of its length."""
    at = [F.min_by("v_id", F.when(F.col("run") >= F.col("total") * share, F.col("pos"))).alias(name) for name, share in shares.items()]
    return arc_positions(path).groupBy("mesh_id", "loop_id").agg(F.max("total").alias("length"), *at)
