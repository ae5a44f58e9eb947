"""The mesh model and its topology operators, for all meshes of a table at once.

Everything is keyed by ``mesh_id``. Half-edges come out of a face row without
a shuffle; edges are one aggregation with map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.local_components import components_by_mesh
from quadrille.functions.shared import dealt, materialise


@dataclass(frozen=True)
class Mesh:
    """Polygon soup: ``vertices(mesh_id, v_id, x, y, z)`` and ``faces(mesh_id, face_id, verts)``."""

    vertices: DataFrame
    faces: DataFrame
    known: dict | None = field(default=None, compare=False, repr=False)  # derived tables by name, of a prepared mesh
    parts: int | None = field(default=None, compare=False, repr=False)  # both tables lie in so many partitions by mesh_id and are cheap to make anew

    def once(self, name: str, make: Callable[[], DataFrame], in_place: bool = True) -> DataFrame:
        """A derived table; a prepared mesh writes it at its first use and reads it at all later ones.

        Where the mesh lies by ``mesh_id``, what is made ``in_place`` (without a shuffle) is made anew
        instead, as reading it would cost one.
        """
        if self.known is None or (self.parts and in_place):
            return make()
        if name not in self.known:
            self.known[name] = dealt(materialise(make()), self.parts)
        return self.known[name]


def prepared(m: Mesh) -> Mesh:
    """The mesh written down, for operators that use its edges, face facts or loops several times."""
    if m.known is not None:
        return m
    if m.parts:
        return Mesh(m.vertices, m.faces, {}, m.parts)
    return Mesh(dealt(materialise(m.vertices)), dealt(materialise(m.faces)), {})


def corners(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, k, v_id)."""
    return m.faces.select("mesh_id", "face_id", F.posexplode("verts").alias("k", "v_id"))


def halfedges(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, k, v0, v1): side k of every face, in its direction."""
    sides = m.faces.select("mesh_id", "face_id", "verts", F.posexplode("verts").alias("k", "v0"))
    return sides.select("mesh_id", "face_id", "k", "v0", F.get("verts", (F.col("k") + 1) % F.size("verts")).alias("v1"))


def manifold_faces(m: Mesh) -> DataFrame:
    """Faces of which no directed side is taken by an earlier face (first come, by face id).

    One round of the rule: sides are contested within their directed edge only.
    """
    w = Window.partitionBy("mesh_id", "v0", "v1").orderBy("face_id", "k")
    late = halfedges(m).withColumn("r", F.row_number().over(w)).where("r > 1").select("mesh_id", "face_id").distinct()
    return m.faces.join(late, ["mesh_id", "face_id"], "left_anti")


def paired(m: Mesh) -> DataFrame:
    """Half-edges with the face and side across, null on the boundary."""

    def make() -> DataFrame:
        h = halfedges(m)
        back = h.select("mesh_id", F.col("v1").alias("v0"), F.col("v0").alias("v1"), F.col("face_id").alias("pair_face"), F.col("k").alias("pair_k"))
        return h.join(back, ["mesh_id", "v0", "v1"], "left")

    return m.once("paired", make)


def edges(m: Mesh) -> DataFrame:
    """(mesh_id, lo, hi, n_faces, f0, f1): undirected edges with their first and last face."""

    def make() -> DataFrame:
        h = halfedges(m).select("mesh_id", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), "face_id")
        return h.groupBy("mesh_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n_faces"), F.min("face_id").alias("f0"), F.max("face_id").alias("f1"))

    return m.once("edges", make)


def _ends(e: DataFrame) -> DataFrame:
    """(mesh_id, v_id, degree, n_open): incident edges, and those of them with one face."""
    ends = e.select("mesh_id", F.explode(F.array("lo", "hi")).alias("v_id"), (F.col("n_faces") == 1).alias("open"))
    return ends.groupBy("mesh_id", "v_id").agg(F.count(F.lit(1)).alias("degree"), F.count_if("open").alias("n_open"))


def vertex_facts(e: DataFrame) -> DataFrame:
    """(mesh_id, v_id, degree, boundary) from an edge table; degree counts incident edges."""
    return _ends(e).select("mesh_id", "v_id", "degree", (F.col("n_open") > 0).alias("boundary"))


def singular() -> Column:
    """Regular is degree 3 on the boundary and 4 inside."""
    return F.when(F.col("boundary"), F.col("degree") != 3).otherwise(F.col("degree") != 4)


def face_adjacency(m: Mesh) -> DataFrame:
    """(mesh_id, face_id, across): ordered pairs of faces that share an edge."""
    return paired(m).where("pair_face IS NOT NULL").select("mesh_id", "face_id", F.col("pair_face").alias("across"))


def vertex_star(m: Mesh) -> DataFrame:
    """(mesh_id, v_id, faces, ring): sorted faces around a vertex and vertices one edge away, gathered together from its corners."""
    n = F.size("verts")
    at = lambda i: F.get("verts", (F.col("k") + i) % n)
    sides = m.faces.select("mesh_id", "face_id", "verts", F.posexplode("verts").alias("k", "v_id"))
    around = sides.select("mesh_id", "v_id", F.struct("face_id", at(n - 1).alias("p"), at(1).alias("q")).alias("c")).groupBy("mesh_id", "v_id").agg(F.collect_list("c").alias("c"))
    star = around.select("mesh_id", "v_id", F.sort_array("c.face_id").alias("faces"), F.array_union("c.p", "c.q").alias("ring"))
    # An edge from a vertex to itself has two ends there.
    ring = F.when(F.array_contains("ring", F.col("v_id")), F.concat("ring", F.array("v_id"))).otherwise(F.col("ring"))
    return star.select("mesh_id", "v_id", "faces", F.sort_array(ring).alias("ring"))


def face_components(m: Mesh, adjacency: DataFrame | None = None) -> DataFrame:
    """(mesh_id, face_id, comp_id): edge-connected parts, named by their smallest face."""
    links = (face_adjacency(m) if adjacency is None else adjacency).select("mesh_id", F.col("face_id").alias("a"), F.col("across").alias("b"))
    alone = m.faces.select("mesh_id", F.col("face_id").alias("a"), F.col("face_id").alias("b"))
    return components_by_mesh(links.unionByName(alone), parts=m.parts).select("mesh_id", F.col("node").alias("face_id"), F.col("component").alias("comp_id"))


def component_labels(m: Mesh, components: DataFrame | None = None) -> DataFrame:
    """(mesh_id, face_id, label): the face's component, numbered from 0 within its mesh in the order of first faces."""
    components = face_components(m) if components is None else components
    ranked = components.select("mesh_id", "comp_id").distinct().withColumn("label", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("comp_id")) - 1).cast("long"))
    return components.join(ranked, ["mesh_id", "comp_id"]).select("mesh_id", "face_id", "label")


def boundary_loops(m: Mesh) -> DataFrame:
    """(mesh_id, v_id, loop_id): boundary vertices by the boundary curve they lie on."""
    links = edges(m).where("n_faces = 1").select("mesh_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    return components_by_mesh(links, parts=m.parts).select("mesh_id", F.col("node").alias("v_id"), F.col("component").alias("loop_id"))


def topology(m: Mesh, *more: Column) -> DataFrame:
    """Counts and Euler number of every mesh, and ``more`` aggregates over degree and boundary of its vertices; ``whole_topology`` has the rest."""
    v = _ends(edges(m)).withColumn("boundary", F.col("n_open") > 0)
    # Every edge has two ends, so the edges are counted where the vertices are, and made once.
    half = lambda c: F.expr(f"sum({c}) div 2")
    per_v = v.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.count_if("boundary").alias("n_boundary_vertices"), F.count_if(singular()).alias("n_irregular"), half("degree").alias("n_edges"), half("n_open").alias("n_boundary_edges"), *more)
    per_f = m.faces.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"))
    return per_v.join(per_f, "mesh_id").withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces"))


def whole_topology(m: Mesh) -> DataFrame:
    """The counts of ``topology`` with components, boundary curves and genus = (2c + e - b - f - v) / 2 of every mesh."""
    m = prepared(m)
    c = face_components(m).groupBy("mesh_id").agg(F.countDistinct("comp_id").alias("n_components"))
    b = boundary_loops(m).groupBy("mesh_id").agg(F.countDistinct("loop_id").alias("n_boundaries"))
    out = topology(m).join(c, "mesh_id").join(b, "mesh_id", "left").na.fill(0, ["n_boundaries"])
    return out.withColumn("genus", F.expr("CAST((2 * n_components + n_edges - n_boundaries - n_faces - n_vertices) div 2 AS BIGINT)"))


def genus_table(m: Mesh) -> DataFrame:
    """(mesh_id, n_components, n_boundaries, genus)."""
    return whole_topology(m).select("mesh_id", "n_components", "n_boundaries", "genus")


def nonmanifold(m: Mesh) -> DataFrame:
    """(mesh_id, repeated_corner, crowded_edge, crowded_boundary, broken_star): counts of each defect."""
    repeated = m.faces.groupBy("mesh_id").agg(F.count_if(F.size(F.array_distinct("verts")) < F.size("verts")).alias("repeated_corner"))
    e = edges(m)
    crowded = e.groupBy("mesh_id").agg(F.count_if(F.col("n_faces") > 2).alias("crowded_edge"))
    open_ends = e.where("n_faces = 1").select("mesh_id", F.explode(F.array("lo", "hi")).alias("v_id")).groupBy("mesh_id", "v_id").count()
    full = open_ends.groupBy("mesh_id").agg(F.count_if(F.col("count") > 2).alias("crowded_boundary"))
    # A star is whole when its corners hang together over the edges at the vertex.
    side = m.faces.select("mesh_id", "face_id", F.explode(F.transform("verts", lambda v, i: F.struct(v.alias("v_id"), F.get("verts", (i + 1) % F.size("verts")).alias("p"), F.get("verts", (i + F.size("verts") - 1) % F.size("verts")).alias("q")))).alias("c")).select("mesh_id", "face_id", "c.*")
    spokes = side.groupBy("mesh_id", "v_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array("p", "q")))).alias("ring"), F.collect_list(F.struct("p", "q")).alias("arcs"))
    grow = lambda s, _: F.array_distinct(F.concat(s, F.flatten(F.transform("arcs", lambda a: F.when(F.array_contains(s, a["p"]) | F.array_contains(s, a["q"]), F.array(a["p"], a["q"])).otherwise(F.array().cast("array<bigint>"))))))
    reached = F.aggregate("arcs", F.slice("ring", 1, 1), grow)
    broken = spokes.select("mesh_id", (F.size(reached) < F.size("ring")).alias("bad")).groupBy("mesh_id").agg(F.count_if("bad").alias("broken_star"))
    return repeated.join(crowded, "mesh_id").join(full, "mesh_id", "left").join(broken, "mesh_id").na.fill(0, ["crowded_boundary"])


def reversed_mesh(m: Mesh) -> Mesh:
    """Every face wound the other way, from the same first corner."""
    return Mesh(m.vertices, m.faces.withColumn("verts", F.concat(F.slice("verts", 1, 1), F.reverse(F.expr("slice(verts, 2, size(verts) - 1)")))))


def compacted(m: Mesh) -> Mesh:
    """Isolated vertices dropped and ids made dense per mesh, in id order."""
    used = corners(m).select("mesh_id", "v_id").distinct()
    ids = used.withColumn("new_id", F.dense_rank().over(Window.partitionBy("mesh_id").orderBy("v_id")) - 1)
    vertices = m.vertices.join(ids, ["mesh_id", "v_id"]).select("mesh_id", F.col("new_id").cast("long").alias("v_id"), "x", "y", "z")
    renamed = corners(m).join(ids, ["mesh_id", "v_id"]).groupBy("mesh_id", "face_id").agg(F.array_sort(F.collect_list(F.struct("k", "new_id"))).alias("c"))
    return Mesh(vertices, renamed.select("mesh_id", "face_id", F.transform("c", lambda c: c["new_id"].cast("long")).alias("verts")))


def concatenated(m: Mesh, into: Column) -> Mesh:
    """Meshes of one ``into`` value joined into one, ids offset by what stands before in mesh order."""
    n_v = m.vertices.groupBy("mesh_id").agg((F.max("v_id") + 1).alias("nv"))
    n_f = m.faces.groupBy("mesh_id").agg((F.max("face_id") + 1).alias("nf"))
    sizes = n_v.join(n_f, "mesh_id").withColumn("into", into)
    w = Window.partitionBy("into").orderBy("mesh_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("mesh_id", "into", F.coalesce(F.sum("nv").over(w), F.lit(0)).alias("dv"), F.coalesce(F.sum("nf").over(w), F.lit(0)).alias("df"))
    vertices = m.vertices.join(sizes, "mesh_id").select(F.col("into").alias("mesh_id"), (F.col("v_id") + F.col("dv")).alias("v_id"), "x", "y", "z")
    faces = m.faces.join(sizes, "mesh_id").select(F.col("into").alias("mesh_id"), (F.col("face_id") + F.col("df")).alias("face_id"), F.transform("verts", lambda v: v + F.col("dv")).alias("verts"))
    return Mesh(vertices, faces)
