"""Face, corner and vertex geometry as column expressions over one face table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.vec import V3, corner_angle
from quadrille.operators.mesh import Mesh, corners, paired


def face_points(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, verts, pts): the corner positions of every face, in order."""
    placed = corners(m).join(m.vertices, ["mesh_id", "v_id"])
    # sort_array compares rows as they are, array_sort by a function called for every pair.
    pts = F.sort_array(F.collect_list(F.struct("k", "v_id", "x", "y", "z")))
    return placed.groupBy("mesh_id", "face_id").agg(pts.alias("pts")).withColumn("verts", F.col("pts.v_id"))


def _total(pts: Column, f) -> V3:
    """Sum of a vector over the corners with their followers."""
    one = lambda i: F.transform(pts, lambda p, k: getattr(f(V3.field(p), V3.field(F.get(pts, (k + 1) % F.size(pts)))), i))
    return V3(*(F.aggregate(one(i), F.lit(0.0), lambda s, x: s + x) for i in "xyz"))


def centroid(pts: Column) -> V3:
    n = F.size(pts)
    return _total(pts, lambda p, q: p) / n


def vector_area(pts: Column) -> V3:
    """Sum of corner cross products: twice the area vector."""
    return _total(pts, lambda p, q: p.cross(q))


def face_facts(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, area, c, n): area, centroid and unit normal of every face."""

    def make() -> DataFrame:
        f = face_points(m)
        mid, va = centroid(F.col("pts")), vector_area(F.col("pts"))
        # Plain columns in between: fields of a struct would be inlined and computed anew at every use.
        f = f.select("mesh_id", "face_id", *(getattr(mid, c).alias(f"c{c}") for c in "xyz"), *(getattr(va, c).alias(f"v{c}") for c in "xyz"))
        v = V3.of("v")
        return f.select("mesh_id", "face_id", (v.length() * 0.5).alias("area"), V3.of("c").struct().alias("c"), v.unit().struct().alias("n"))

    return m.once("face_facts", make)


def face_areas(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, area); a prepared mesh writes this narrow table once, as areas take longer to make than to read."""
    return m.once("face_areas", lambda: face_facts(m).select("mesh_id", "face_id", "area"), in_place=False)


def vertex_normals(m: Mesh) -> DataFrame:
    """(mesh_id, v_id, x, y, z): unit sum of the unit normals of the faces around."""
    n = face_facts(m).select("mesh_id", "face_id", "n.x", "n.y", "n.z")
    s = corners(m).join(n, ["mesh_id", "face_id"]).groupBy("mesh_id", "v_id").agg(*(F.sum(c).alias(c) for c in "xyz"))
    u = V3.of().unit()
    return s.select("mesh_id", "v_id", u.x.alias("x"), u.y.alias("y"), u.z.alias("z"))


def edge_geometry(m: Mesh, e: DataFrame) -> DataFrame:
    """Edges with length and midpoint."""
    a = m.vertices.select("mesh_id", F.col("v_id").alias("lo"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    b = m.vertices.select("mesh_id", F.col("v_id").alias("hi"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    j = e.join(a, ["mesh_id", "lo"]).join(b, ["mesh_id", "hi"])
    p, q = V3.of("a"), V3.of("b")
    mid = (p + q) * 0.5
    return j.select("mesh_id", "lo", "hi", "n_faces", "f0", "f1", (q - p).length().alias("length"), mid.x.alias("mx"), mid.y.alias("my"), mid.z.alias("mz"))


def quad_wide(m: Mesh) -> DataFrame:
    """Quads with p0..p3 as structs of x, y, z."""
    return face_points(m).where(F.size("pts") == 4).select("mesh_id", "face_id", "verts", *(F.get("pts", F.lit(i)).alias(f"p{i}") for i in range(4)))


def quad_angles(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, a0..a3, planarity, irregularity): corner angles in degrees."""
    q = quad_wide(m)
    p = [V3.field(F.col(f"p{i}")) for i in range(4)]
    q = q.select("mesh_id", "face_id", *(corner_angle(p[i - 1], p[i], p[(i + 1) % 4]).alias(f"a{i}") for i in range(4)))
    a = [F.col(f"a{i}") for i in range(4)]
    planarity, off = F.abs(a[0] + a[1] + a[2] + a[3] - 360), [F.abs(x - 90) for x in a]
    return q.withColumn("planarity", planarity).withColumn("irregularity", (off[0] + off[1] + off[2] + off[3]) / 4)


def scaled_jacobians(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, sj): smallest normalised corner cross product of every face."""
    f = face_points(m)

    def corner(p, i):
        n = F.size("pts")
        at, a, b = V3.field(p), V3.field(F.get("pts", (i + n - 1) % n)), V3.field(F.get("pts", (i + 1) % n))
        e1, e2 = a - at, b - at
        return e1.cross(e2).length() / (e1.length() * e2.length() + 1e-12)

    return f.select("mesh_id", "face_id", F.array_min(F.transform("pts", corner)).alias("sj"))


def quads_to_triangles(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, verts): two triangles a quad, ids 2f and 2f + 1; other faces keep theirs at 2f."""
    f = face_points(m).select("mesh_id", "face_id", "verts", F.size("pts").alias("n"), *(F.get("pts", F.lit(i))[c].alias(f"p{i}{c}") for i in range(4) for c in "xyz"))
    own, p = ["mesh_id", "face_id", "verts", "n"], [V3.of(f"p{i}") for i in range(4)]
    f = keep(f, own, **{f"s{i}": p[(i + 1) % 4] - p[i] for i in range(4)})
    f = keep(f, own, **{f"u{i}": V3.of(f"s{i}").unit() for i in range(4)})
    bend = lambda i: F.degrees(F.acos(F.least(F.greatest(-V3.of(f"u{(i + 3) % 4}").dot(V3.of(f"u{i}")), F.lit(-1.0)), F.lit(1.0))))
    f = f.select(*own, *(bend(i).alias(f"a{i}") for i in range(4)))
    # Cut from corner 0 to 2 where the corners off that diagonal hold the larger angle sum.
    f = f.select(*own, F.explode(F.array(F.round(F.col("a1") + F.col("a3"), 9) >= F.round(F.col("a0") + F.col("a2"), 9))).alias("by02"))
    v = [F.get("verts", F.lit(i)) for i in range(4)]
    cut = F.when(F.col("by02"), F.array(F.array(v[0], v[1], v[2]), F.array(v[0], v[2], v[3]))).otherwise(F.array(F.array(v[0], v[1], v[3]), F.array(v[1], v[2], v[3])))
    tris = F.when(F.col("n") == 4, cut).otherwise(F.array(F.col("verts")))
    return f.select("mesh_id", "face_id", F.posexplode(tris).alias("i", "verts")).select("mesh_id", (F.col("face_id") * 2 + F.col("i")).alias("face_id"), "verts")


def dihedral_angles(m: Mesh) -> DataFrame:
    """(mesh_id, v0, v1, dihedral): per half-edge, the angle between the directions to both centroids across the edge; 0 on the boundary, 180 flat."""
    c = face_facts(m).select("mesh_id", "face_id", "c")
    h = paired(m).join(c, ["mesh_id", "face_id"])
    h = h.join(c.select("mesh_id", F.col("face_id").alias("pair_face"), F.col("c").alias("d")), ["mesh_id", "pair_face"], "left")
    pos = lambda k, n: m.vertices.select("mesh_id", F.col("v_id").alias(k), F.struct("x", "y", "z").alias(n))
    h = h.join(pos("v0", "p"), ["mesh_id", "v0"]).join(pos("v1", "q"), ["mesh_id", "v1"])
    p, q, a, b = (V3.field(F.col(x)) for x in ("p", "q", "c", "d"))
    mid = (p + q) * 0.5
    # In steps over plain columns, so that no expression is expanded at every use.
    h = keep(h, ["mesh_id", "v0", "v1", "pair_face"], s=(q - p), a=a - mid, b=b - mid)
    h = keep(h, ["mesh_id", "v0", "v1", "pair_face", *(f"{w}{c}" for w in "ab" for c in "xyz")], u=V3.of("s").unit())
    u = V3.of("u")
    flat = lambda w: w - u * w.dot(u)
    h = keep(h, ["mesh_id", "v0", "v1", "pair_face"], f=flat(V3.of("a")), g=flat(V3.of("b")))
    f, g = V3.of("f"), V3.of("g")
    scale = F.sqrt(f.squared() * g.squared())
    cosine = F.when(scale > 0, f.dot(g) / scale).otherwise(F.lit(0.0))
    bend = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    out = F.when(F.col("pair_face").isNull(), F.lit(0.0)).otherwise(bend)
    # Exploding one value keeps filters on it from being pushed down and expanded.
    return h.select("mesh_id", "v0", "v1", F.explode(F.array(out)).alias("dihedral"))


def keep(df: DataFrame, columns: list[str], **vectors: V3) -> DataFrame:
    """Some columns and the parts of vectors as plain columns (name + axis)."""
    return df.select(*columns, *(getattr(v, c).alias(n + c) for n, v in vectors.items() for c in "xyz"))


def bounding_boxes(m: Mesh) -> DataFrame:
    return m.vertices.groupBy("mesh_id").agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def moments(m: Mesh) -> DataFrame:
    """Means and the six second moments of the vertices, the input of a principal-axes solve."""
    mean = m.vertices.groupBy("mesh_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    d = m.vertices.join(mean, "mesh_id")
    w = {c: F.col(c) - F.col(f"m{c}") for c in "xyz"}
    return d.groupBy("mesh_id").agg(*(F.first(f"m{c}").alias(f"m{c}") for c in "xyz"), *(F.avg(w[a] * w[b]).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")))


def normalised(m: Mesh) -> DataFrame:
    """Vertices moved to the box's low corner and scaled by its longest side (zero extent: unscaled)."""
    b = bounding_boxes(m)
    side = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"))
    b = b.withColumn("side", F.when(side > 0, side).otherwise(F.lit(1.0)))
    return m.vertices.join(b, "mesh_id").select("mesh_id", "v_id", *(((F.col(c) - F.col(f"min_{c}")) / F.col("side")).alias(c) for c in "xyz"))
