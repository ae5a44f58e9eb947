"""Quality of quad meshes: statistics, filters and the quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.vec import V3, angle
from quadrille.operators import geometry as G
from quadrille.operators import loops as L
from quadrille.operators import mesh as M
from quadrille.operators.kernels import rotation
from quadrille.operators.mesh import Mesh


def shape_stats(m: Mesh) -> DataFrame:
    """Per mesh: an interior edge between boundary vertices, singular counts, largest degrees, singular corners of a face, largest bend."""
    m = M.prepared(m)
    e = M.edges(m)
    facts = M.vertex_facts(e).withColumn("singular", M.singular())
    b = lambda k: facts.select("mesh_id", F.col("v_id").alias(k), F.col("boundary").alias(f"b{k}"))
    bridges = e.where("n_faces = 2").join(b("lo"), ["mesh_id", "lo"]).join(b("hi"), ["mesh_id", "hi"]).groupBy("mesh_id").agg(F.bool_or(F.col("blo") & F.col("bhi")).alias("bridge"))
    sing = facts.groupBy("mesh_id").agg(F.count_if(F.col("singular") & ~F.col("boundary")).alias("n_interior_singular"), F.count_if(F.col("singular") & F.col("boundary")).alias("n_boundary_singular"),
                                        F.coalesce(F.max(F.when(~F.col("boundary"), F.col("degree"))), F.lit(0)).alias("max_interior_degree"), F.coalesce(F.max(F.when(F.col("boundary"), F.col("degree"))), F.lit(0)).alias("max_boundary_degree"))
    per_face = M.corners(m).join(facts.where("singular").select("mesh_id", "v_id"), ["mesh_id", "v_id"]).groupBy("mesh_id", "face_id").count().groupBy("mesh_id").agg(F.max("count").alias("max_singular_in_face"))
    bend = G.dihedral_angles(m).where("dihedral > 0").groupBy("mesh_id").agg(F.max(180 - F.col("dihedral")).alias("max_bend"))
    out = sing.join(bridges, "mesh_id", "left").join(per_face, "mesh_id", "left").join(bend, "mesh_id", "left")
    return out.na.fill({"bridge": False, "max_singular_in_face": 0, "max_bend": 0.0})


def quick_filter(stats: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Meshes with at most 8 boundaries, an interior singularity and no bend over 60 degrees."""
    return stats.join(boundaries.select("mesh_id", "n_boundaries"), "mesh_id").where("n_boundaries <= 8 AND n_interior_singular > 0 AND max_bend <= 60")


def short_edges(m: Mesh, tolerance: float) -> DataFrame:
    """Meshes that hold an edge no longer than the tolerance."""
    return G.edge_geometry(m, M.edges(m)).where(F.col("length") <= tolerance).select("mesh_id").distinct()


def report(m: Mesh) -> DataFrame:
    """One row of quality figures per mesh: counts, simplicity ratios, charts, mean scaled Jacobian and genus."""
    m = M.prepared(m)
    top = M.whole_topology(m)
    sj = G.scaled_jacobians(m).groupBy("mesh_id").agg(F.avg("sj").alias("sj"))
    charts = L.charts(m).groupBy("mesh_id").agg(F.countDistinct("chart_id").alias("n_complex"))
    return top.join(L.simple_ratios(m), "mesh_id").join(charts, "mesh_id").join(sj, "mesh_id")


def as_json(rows: DataFrame) -> DataFrame:
    """(mesh_id, json): one object per mesh."""
    return rows.select("mesh_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def valid(rows: DataFrame) -> DataFrame:
    """Meshes of 16 faces and more whose shortest extent is at least a thousandth of the longest."""
    return rows.where("n_faces >= 16 AND min_extent >= 0.001 * max_extent")


def dataset_figures(m: Mesh) -> DataFrame:
    """What ``dataset_filter`` reads, one row per mesh: shape, size ratio in principal axes, the share of face loops that never cross themselves, charts."""
    m = M.prepared(m)
    from quadrille.operators.dedup import principal_sides

    size = principal_sides(m).select("mesh_id", (F.least("sx", "sy", "sz") / (F.greatest("sx", "sy", "sz") + 1e-10)).alias("size_ratio"))
    faces = m.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"))
    simple = L.simple_ratios(m).select("mesh_id", F.col("fratio").alias("fratio_new"))
    charts = L.chart_distribution(m).select("mesh_id", "min_area_ratio", "min_border")
    return faces.join(shape_stats(m), "mesh_id").join(size, "mesh_id").join(simple, "mesh_id").join(charts, "mesh_id")


def dataset_filter(rows: DataFrame) -> DataFrame:
    """The keep rule for training meshes over the columns of ``dataset_figures``; the limits are fixed values."""
    shape = "n_faces > 16 AND NOT bridge AND max_singular_in_face <= 2 AND max_bend <= 60 AND max_interior_degree <= 8 AND max_boundary_degree <= 3 AND n_interior_singular > 0"
    return rows.where(f"{shape} AND size_ratio > 0.2 AND fratio_new >= 0.6 AND min_area_ratio >= 0.001 AND min_border >= 0.02")


def mergeable_edges(m: Mesh, free_only: bool = True) -> DataFrame:
    """Interior edges of two triangles: (mesh_id, lo, hi, f0, f1, far0, far1).

    With ``free_only`` those go whose far corners are joined already.
    """
    t = m.faces.where(F.size("verts") == 3).select("mesh_id", "face_id", "verts")
    side = F.explode(F.transform("verts", lambda v, i: F.struct(F.least(v, F.get("verts", (i + 1) % 3)).alias("lo"), F.greatest(v, F.get("verts", (i + 1) % 3)).alias("hi"), F.get("verts", (i + 2) % 3).alias("far"))))
    s = t.select("mesh_id", "face_id", side.alias("s")).select("mesh_id", "face_id", "s.*")
    two = s.groupBy("mesh_id", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("face_id", "far"))).alias("p")).where("size(p) = 2")
    two = two.select("mesh_id", "lo", "hi", *(F.col("p")[i]["face_id"].alias(f"f{i}") for i in (0, 1)), *(F.col("p")[i]["far"].alias(f"far{i}") for i in (0, 1)))
    if not free_only:
        return two
    joined = M.edges(m).select("mesh_id", "lo", "hi")
    return two.alias("t").join(joined.alias("j"), F.expr("t.mesh_id = j.mesh_id AND j.lo = least(far0, far1) AND j.hi = greatest(far0, far1)"), "left_anti")


def mergeable_quads(m: Mesh, bend: float = 120.0, narrow: float = 10.0, turn: float = 390.0) -> DataFrame:
    """Mergeable edges whose two triangles make a good quad: the columns of ``mergeable_edges``, verts and regularity.

    Both triangles bend by no less than ``bend`` degrees and face the way the quad
    does; seen along the quad's normal it is convex, no side turns into the next by
    less than ``narrow`` from straight or from back, and its corners sum to at most
    ``turn``. Regularity is the sum of the corners' deviations from 90 degrees. The
    limits' defaults are fixed values.
    """
    m = M.prepared(m)
    first = m.faces.select("mesh_id", F.col("face_id").alias("f0"), F.col("verts").alias("t"))
    e = mergeable_edges(m).join(first, ["mesh_id", "f0"]).withColumn("at", F.expr("array_position(t, far0) - 1").cast("int"))
    nxt = lambda i: F.get("t", (F.col("at") + i) % 3)
    own = ["mesh_id", "lo", "hi", "f0", "f1", "far0", "far1"]
    e = e.select(*own, F.array("far0", nxt(1), "far1", nxt(2)).alias("verts"))
    for i in range(4):
        e = e.withColumn(f"v{i}", F.get("verts", F.lit(i))).join(m.vertices.select("mesh_id", F.col("v_id").alias(f"v{i}"), *(F.col(c).alias(f"p{i}{c}") for c in "xyz")), ["mesh_id", f"v{i}"]).drop(f"v{i}")
    own = [*own, "verts"]
    p = [V3.of(f"p{i}") for i in range(4)]
    points = {f"p{i}": v for i, v in enumerate(p)}
    normal = p[0].cross(p[1]) + p[1].cross(p[2]) + p[2].cross(p[3]) + p[3].cross(p[0])
    e = G.keep(e, own, **points, n=normal, a=(p[1] - p[0]).cross(p[3] - p[0]), b=(p[3] - p[2]).cross(p[1] - p[2]), c=(p[0] + p[1] + p[2] + p[3]) * 0.25)
    n, a, b = (V3.of(x) for x in "nab")
    e = e.withColumns({"flat": F.lit(180.0) - angle(a, b), "against": n.dot(a) * n.dot(b) < 0})
    bent = [*own, "flat", "against"]
    e = G.keep(e, bent, **points, u=V3.of("n").unit(), c=V3.of("c"))
    u, c = V3.of("u"), V3.of("c")
    e = G.keep(e, bent, u=u, **{f"q{i}": v - u * (v - c).dot(u) for i, v in enumerate(p)})
    q = [V3.of(f"q{i}") for i in range(4)]
    e = G.keep(e, bent, u=u, **{f"d{i}": q[i] - q[(i + 1) % 4] for i in range(4)})
    d = [V3.of(f"d{i}") for i in range(4)]
    e = e.select(*bent, *((u.dot(d[i].cross(d[(i + 1) % 4])) > 0).alias(f"s{i}") for i in range(4)), *(angle(d[i], d[(i + 1) % 4]).alias(f"t{i}") for i in range(4)))
    turns, corner = [F.col(f"t{i}") for i in range(4)], [F.lit(180.0) - F.col(f"t{i}") for i in range(4)]
    good = F.col("s0").eqNullSafe(F.col("s1")) & F.col("s1").eqNullSafe(F.col("s2")) & F.col("s2").eqNullSafe(F.col("s3"))
    for t, x in zip(turns, corner, strict=True):
        good = good & (F.least(t, F.lit(180.0) - t) >= narrow) & (x >= narrow)
    total = corner[0] + corner[1] + corner[2] + corner[3]
    off = [F.abs(x - 90.0) for x in corner]
    good = good & (total <= turn) & ~F.col("against") & (F.col("flat") >= bend)
    # Exploding one value keeps the filter from being pushed down and expanded.
    told = F.when(good, off[0] + off[1] + off[2] + off[3])
    return e.select(*own, F.explode(F.array(told)).alias("regularity")).where("regularity IS NOT NULL")


def merge_pairs(m: Mesh, pairs: DataFrame) -> Mesh:
    """Faces of chosen pairs (mesh_id, f0, f1, lo, hi, far0, far1) become quads under the first id; the rest stay."""
    first = m.faces.select("mesh_id", F.col("face_id").alias("f0"), "verts")
    # The quad runs from the first far corner along the first triangle's winding.
    q = pairs.join(first, ["mesh_id", "f0"]).withColumn("at", F.expr("array_position(verts, far0) - 1"))
    nxt = lambda i: F.get("verts", (F.col("at").cast("int") + i) % 3)
    quads = q.select("mesh_id", F.col("f0").alias("face_id"), F.array("far0", nxt(1), "far1", nxt(2)).alias("verts"))
    gone = pairs.select("mesh_id", F.explode(F.array("f0", "f1")).alias("face_id"))
    return Mesh(m.vertices, m.faces.join(gone, ["mesh_id", "face_id"], "left_anti").unionByName(quads))


def cluster_borders(m: Mesh, cluster: Column, value: Column) -> DataFrame:
    """(mesh_id, c0, c1, clear, confused): border length between clusters, by the mean of ``value`` over both faces against one half."""
    c = m.faces.select("mesh_id", "face_id", cluster.alias("c"), value.alias("w"))
    at = lambda f, n: c.select("mesh_id", F.col("face_id").alias(f), F.col("c").alias(n), F.col("w").alias(f"w{n}"))
    e = G.edge_geometry(m, M.edges(m).where("n_faces = 2")).join(at("f0", "c0"), ["mesh_id", "f0"]).join(at("f1", "c1"), ["mesh_id", "f1"]).where("c0 <> c1")
    high = (F.col("wc0") + F.col("wc1")) / 2 > 0.5
    return e.groupBy("mesh_id", F.least("c0", "c1").alias("c0"), F.greatest("c0", "c1").alias("c1")).agg(F.sum(F.when(~high, F.col("length")).otherwise(0.0)).alias("clear"), F.sum(F.when(high, F.col("length")).otherwise(0.0)).alias("confused"))


def drop_valence_two(m: Mesh) -> Mesh:
    """The two quads around an interior vertex of degree 2 become one; vertices of one quad are taken smallest first."""
    two = M.vertex_facts(M.edges(m)).where("NOT boundary AND degree = 2").select("mesh_id", "v_id")
    around = M.corners(m).join(two, ["mesh_id", "v_id"]).join(m.faces, ["mesh_id", "face_id"]).groupBy("mesh_id", "v_id").agg(F.array_sort(F.collect_list(F.struct("face_id", "k", "verts"))).alias("p")).where("size(p) = 2")
    # A face around two such vertices goes with the smaller one.
    own = around.select("mesh_id", "v_id", "p", F.explode(F.col("p.face_id")).alias("face_id"))
    first = own.groupBy("mesh_id", "face_id").agg(F.min("v_id").alias("v_id"))
    good = own.join(first, ["mesh_id", "face_id", "v_id"]).groupBy("mesh_id", "v_id").agg(F.count(F.lit(1)).alias("n"), F.first("p").alias("p")).where("n = 2")
    a, b = F.col("p")[0], F.col("p")[1]
    at = lambda f, i: F.get(f["verts"], (f["k"] + i) % 4)
    quads = good.select("mesh_id", a["face_id"].alias("face_id"), F.array(at(a, 1), at(a, 2), at(a, 3), at(b, 2)).alias("verts"))
    gone = good.select("mesh_id", F.explode(F.col("p.face_id")).alias("face_id"))
    return Mesh(m.vertices, m.faces.join(gone, ["mesh_id", "face_id"], "left_anti").unionByName(quads))
