"""Two labellings of faces laid over each other, and small clusters absorbed by their neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise
from quadrille.operators.geometry import face_facts
from quadrille.operators.mesh import Mesh, face_adjacency, face_components, prepared


def overlay(m: Mesh, labels: DataFrame) -> DataFrame:
    """(mesh_id, face_id, cluster): faces hanging together over edges with both of ``labels(mesh_id, face_id, a, b)`` equal, named by the smallest face."""
    m = prepared(m)
    one = labels.select("mesh_id", "face_id", "a", "b")
    other = labels.select("mesh_id", F.col("face_id").alias("across"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    alike = face_adjacency(m).join(one, ["mesh_id", "face_id"]).join(other, ["mesh_id", "across"]).where("a <=> a2 AND b <=> b2")
    return face_components(m, alike.select("mesh_id", "face_id", "across")).withColumnRenamed("comp_id", "cluster")


def absorb(m: Mesh, clusters: DataFrame, wanted: DataFrame, rounds: int = 1000) -> DataFrame:
    """(mesh_id, face_id, label): the ``wanted(mesh_id, n)`` largest clusters by area, and all others as parts of them.

    Clusters are ranked by area (nine places), then name, and that rank from 0 is the
    label. In every round a cluster that is not in yet joins the best-ranked one that
    it borders and that stays or has joined in an earlier round, and takes its label. What
    hangs together with none that stays gets -1. Every round is one join of the
    borders of what is still outside.
    """
    m = prepared(m)
    clusters = materialise(clusters)
    area = face_facts(m).select("mesh_id", "face_id", "area")
    size = clusters.join(area, ["mesh_id", "face_id"]).groupBy("mesh_id", "cluster").agg(F.round(F.sum("area"), 9).alias("area"))
    rank = F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("area"), "cluster")) - 1
    ranked = materialise(size.select("mesh_id", "cluster", rank.cast("long").alias("rank")).join(wanted, "mesh_id"))
    other = clusters.select("mesh_id", F.col("face_id").alias("across"), F.col("cluster").alias("beside"))
    borders = materialise(face_adjacency(m).join(clusters, ["mesh_id", "face_id"]).join(other, ["mesh_id", "across"]).where("cluster <> beside").select("mesh_id", "cluster", "beside").distinct())
    inside = materialise(ranked.where("rank < n").select("mesh_id", F.col("cluster").alias("beside"), "rank", F.col("rank").alias("label")))
    outside = ranked.where("rank >= n").select("mesh_id", "cluster", "rank")
    for _ in range(rounds):
        met = outside.select("mesh_id", "cluster", F.col("rank").alias("own")).join(borders, ["mesh_id", "cluster"]).join(inside, ["mesh_id", "beside"])
        best = materialise(met.groupBy("mesh_id", "cluster", "own").agg(F.min_by("label", "rank").alias("label")))
        if best.isEmpty():
            break
        inside = materialise(inside.unionByName(best.select("mesh_id", F.col("cluster").alias("beside"), F.col("own").alias("rank"), "label")))
        outside = outside.join(best.select("mesh_id", "cluster"), ["mesh_id", "cluster"], "left_anti")
    else:
        raise RuntimeError(f"clusters are still outside after {rounds} rounds")
    named = inside.select("mesh_id", F.col("beside").alias("cluster"), "label")
    return clusters.join(named, ["mesh_id", "cluster"], "left").select("mesh_id", "face_id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def overlay_labels(m: Mesh, labels: DataFrame, factor: int = 4) -> DataFrame:
    """(mesh_id, face_id, label): overlaid clusters of ``labels``, of which the largest ``factor`` per first label stay and absorb the rest."""
    m = prepared(m)
    wanted = labels.groupBy("mesh_id").agg((F.countDistinct("a") * factor).alias("n"))
    return absorb(m, overlay(m, labels), wanted)
