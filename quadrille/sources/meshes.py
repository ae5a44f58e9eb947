"""Mesh files as tables: a distributed reader and writer over the file formats."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions.batches import by_batch
from quadrille.functions.shared import materialise
from quadrille.operators.mesh import Mesh
from quadrille.sources.formats import MeshError, decode, encode

ROW = "path string, kind string, item long, x double, y double, z double, verts array<long>, error string"


def _explode(batches):
    for batch in batches:
        for path, raw in zip(batch["path"], batch["content"], strict=True):
            try:
                v, faces = decode(path, bytes(raw))
            except MeshError as e:
                yield pd.DataFrame({"path": [path], "kind": ["error"], "item": [0], "x": [np.nan], "y": [np.nan], "z": [np.nan], "verts": [None], "error": [str(e)]})
                continue
            if len(v):
                yield pd.DataFrame({"path": path, "kind": "vertex", "item": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2], "verts": [None] * len(v), "error": None})
            if faces:
                yield pd.DataFrame({"path": path, "kind": "face", "item": np.arange(len(faces)), "x": np.nan, "y": np.nan, "z": np.nan, "verts": faces, "error": None})


def scan(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, kind, item, x, y, z, verts, error): every non-empty mesh file, a row per vertex, face or failure."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.where("length > 0").select("path", "content").mapInPandas(_explode, ROW)


def read(spark: SparkSession, folder: str, glob: str = "*") -> tuple[Mesh, DataFrame]:
    """The meshes of a folder, named by a hash of their path, and (path, mesh_id, error)."""
    rows = scan(spark, folder, glob).withColumn("mesh_id", F.xxhash64("path"))
    mesh = Mesh(rows.where("kind = 'vertex'").select("mesh_id", F.col("item").alias("v_id"), "x", "y", "z"), rows.where("kind = 'face'").select("mesh_id", F.col("item").alias("face_id"), "verts"))
    return mesh, rows.groupBy("path", "mesh_id").agg(F.max("error").alias("error"))


def files(m: Mesh, *extensions: str) -> DataFrame:
    """(mesh_id, name, content): one file per mesh and extension, written in its task; vertex ids are made dense.

    A batch of meshes is written at a time, where the meshes lie.
    """
    return by_batch(_writer(extensions), "mesh_id long, name string, content binary", m.vertices.select("mesh_id", "v_id", "x", "y", "z"), m.faces.select("mesh_id", "face_id", "verts"))


def write(m: Mesh, folder: str, *extensions: str) -> DataFrame:
    """Write one file per mesh and extension into a folder that the executors share: (mesh_id, path, bytes) of what was written.

    ``folder`` is a URI that pyarrow's file systems open (file, hdfs, s3, gs). A task that
    runs again writes the same names with the same content, so lost executors leave nothing half done.
    """
    out = files(m, *extensions).mapInPandas(_store(folder.rstrip("/")), "mesh_id long, path string, bytes long")
    return materialise(out)


def _store(folder: str):
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as sink:
                    sink.write(bytes(content))
            yield pd.DataFrame({"mesh_id": batch["mesh_id"], "path": [f"{folder}/{n}" for n in batch["name"]], "bytes": [len(c) for c in batch["content"]]})

    return run


def _writer(extensions: tuple[str, ...]):
    def sorted_by(side: tuple[pd.DataFrame, np.ndarray], key: str) -> tuple[pd.DataFrame, list[int]]:
        rows, at = side
        return rows.iloc[np.lexsort([rows[key], np.repeat(np.arange(len(at) - 1), np.diff(at))])], at.tolist()

    def run(*sides: tuple[pd.DataFrame, np.ndarray]) -> pd.DataFrame:
        (v, v_at), (f, f_at) = sorted_by(sides[0], "v_id"), sorted_by(sides[1], "face_id")
        xyz, item, verts = v[["x", "y", "z"]].to_numpy(), v["v_id"].to_numpy(), f["verts"].tolist()
        of_v, of_f = v["mesh_id"].to_numpy(), f["mesh_id"].to_numpy()
        out = []
        for a, b, c, d in zip(v_at, v_at[1:], f_at, f_at[1:], strict=False):
            mesh_id = int(of_v[a] if a < b else of_f[c])
            ends = np.cumsum([0, *map(len, verts[c:d])]).tolist()
            places = np.searchsorted(item[a:b], np.concatenate([np.zeros(0, np.int64), *verts[c:d]])).tolist()
            faces = [places[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            for extension in extensions:
                name = f"{mesh_id}.{extension}"
                out.append((mesh_id, name, encode(name, xyz[a:b], faces)))
        return pd.DataFrame(out, columns=["mesh_id", "name", "content"])

    return run
