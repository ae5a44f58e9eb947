"""Bundles of tensors as a Spark data source: one file a partition, several tensors each.

``spark.read.format("tensor_bundles").load(folder)`` gives (bundle, tensor, row, values)
of every NPZ file, and of every raw BIN list of objects under the same names; the
writer lays the rows of a bundle, which one task must hold in order, into one file.
``folder`` is a URI that pyarrow's file systems open, or a path that all executors share.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quadrille.operators.mesh import Mesh

FORMAT = "tensor_bundles"
SCHEMA = "bundle string, tensor string, row long, values array<double>"
ROWS_PER_BATCH = 50_000
_ARROW = pa.schema([("bundle", pa.string()), ("tensor", pa.string()), ("row", pa.int64()), ("values", pa.list_(pa.float64()))])


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def unpack_bin(raw: bytes) -> dict[str, np.ndarray]:
    """The tensors of a raw list of objects: a count, pairs of sizes, then per object vertices (float32) and triangles (int32)."""
    n = struct.unpack_from("<i", raw)[0]
    sizes, at, out = np.frombuffer(raw, "<i4", 2 * n, 4).reshape(-1, 2), 4 + 8 * n, {"num_objects": np.array([n])}
    for i, (n_v, n_f) in enumerate(sizes.tolist()):
        out[f"vertices_{i}"] = np.frombuffer(raw, "<f4", 3 * n_v, at).reshape(-1, 3)
        out[f"faces_{i}"] = np.frombuffer(raw, "<i4", 3 * n_f, at + 12 * n_v).reshape(-1, 3)
        at += 12 * (n_v + n_f)
    return out


def pack_bin(tensors: dict[str, np.ndarray]) -> bytes:
    n = int(np.ravel(tensors["num_objects"])[0])
    v, f = ([np.asarray(tensors.get(f"{name}_{i}", np.zeros((0, 3)))).reshape(-1, 3) for i in range(n)] for name in ("vertices", "faces"))
    sizes = np.array([(len(a), len(b)) for a, b in zip(v, f, strict=True)], "<i4").reshape(-1, 2)
    return b"".join([struct.pack("<i", n), sizes.tobytes(), *(x for a, b in zip(v, f, strict=True) for x in (a.astype("<f4").tobytes(), b.astype("<i4").tobytes()))])


def pack_npz(tensors: dict[str, np.ndarray]) -> bytes:
    """Counts and faces as integers, the rest as they come; vectors of single numbers are flat."""
    whole = lambda k: k == "num_objects" or k.startswith("faces_")
    out = io.BytesIO()
    np.savez(out, **{k: (v.astype("<i4" if k != "num_objects" else "<i8") if whole(k) else v) if v.shape[-1] != 1 else v.astype("<i8" if whole(k) else v.dtype)[:, 0] for k, v in tensors.items()})
    return out.getvalue()


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        store, root = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.size and f.extension.lower() in ("npz", "bin")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        with store.open_input_stream(partition.path) as f:
            raw = f.read()
        bundle = partition.path.rpartition("/")[2].rpartition(".")[0]
        tensors = unpack_bin(raw) if partition.path.lower().endswith(".bin") else np.load(io.BytesIO(raw))
        for name in tensors:
            rows = np.asarray(tensors[name], np.float64)
            rows = rows.reshape(len(rows) if rows.ndim else 1, -1)
            for start in range(0, len(rows), ROWS_PER_BATCH):
                part = rows[start : start + ROWS_PER_BATCH]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([bundle] * len(part)), pa.array([name] * len(part)), pa.array(np.arange(start, start + len(part))), values], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.folder)
        store.create_dir(root, recursive=True)
        paths, now, tensors = [], None, {}

        def close() -> None:
            if now is not None:
                whole = {k: np.array(v) for k, v in tensors.items()}
                with store.open_output_stream(path := f"{root}/{now}.{self.kind}") as f:
                    f.write(pack_bin(whole) if self.kind == "bin" else pack_npz(whole))
                paths.append(path)

        for batch in iterator:
            for bundle, tensor, values in zip(*(batch.column(c).to_pylist() for c in ("bundle", "tensor", "values")), strict=True):
                if bundle != now:
                    close()
                    now, tensors = bundle, {}
                tensors.setdefault(tensor, []).append(values)
        close()
        return _Written(paths)


class TensorBundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].rstrip("/"), self.options.get("kind", "npz"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, tensor, row, values) of every bundle below ``folder``."""
    spark.dataSource.register(TensorBundles)
    return spark.read.format(FORMAT).load(folder)


def write(tensors: DataFrame, folder: str, kind: str = "npz") -> None:
    """``tensors(bundle, tensor, row, values)`` as one file a bundle; a task that runs again writes the same file."""
    tensors.sparkSession.dataSource.register(TensorBundles)
    rows = tensors.select("bundle", "tensor", "row", "values").repartition("bundle").sortWithinPartitions("bundle", "tensor", "row")
    rows.write.format(FORMAT).option("kind", kind).mode("append").save(folder)


def objects(m: Mesh, bundle) -> DataFrame:
    """Meshes as objects of bundles: ``bundle`` is a column over mesh_id; objects are numbered by mesh_id, vertices by id. Faces keep their corners as places among the vertices."""
    name = m.faces.select("mesh_id").distinct().withColumn("bundle", bundle.cast("string"))
    name = name.withColumn("object", F.row_number().over(Window.partitionBy("bundle").orderBy("mesh_id")) - 1)
    place = (F.row_number().over(Window.partitionBy("mesh_id").orderBy("v_id")) - 1).cast("long")
    v = m.vertices.join(name, "mesh_id").withColumn("row", place)
    corner = m.faces.select("mesh_id", "face_id", F.posexplode("verts").alias("k", "v_id")).join(v.select("mesh_id", "v_id", "row", "bundle", "object"), ["mesh_id", "v_id"])
    f = corner.groupBy("bundle", "object", "face_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "row"))), lambda c: c["row"].cast("double")).alias("values"))
    f = f.withColumn("row", (F.row_number().over(Window.partitionBy("bundle", "object").orderBy("face_id")) - 1).cast("long"))
    tensor = lambda prefix: F.concat(F.lit(prefix), F.col("object").cast("string")).alias("tensor")
    n = name.groupBy("bundle").agg(F.array(F.count(F.lit(1)).cast("double")).alias("values")).select("bundle", F.lit("num_objects").alias("tensor"), F.lit(0).cast("long").alias("row"), "values")
    return v.select("bundle", tensor("vertices_"), "row", F.array("x", "y", "z").alias("values")).unionByName(f.select("bundle", tensor("faces_"), "row", "values")).unionByName(n)


def meshes(tensors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects of bundles: (bundle, object, v_id, x, y, z) and (bundle, object, face_id, verts)."""
    part = tensors.withColumn("object", F.regexp_extract("tensor", r"_(\d+)$", 1))
    one = lambda prefix, item: part.where(F.col("tensor").rlike(f"^{prefix}_[0-9]+$")).select("bundle", F.col("object").cast("long").alias("object"), F.col("row").alias(item), "values")
    v = one("vertices", "v_id").select("bundle", "object", "v_id", *(F.get("values", F.lit(i)).alias(c) for i, c in enumerate("xyz")))
    return v, one("faces", "face_id").select("bundle", "object", "face_id", F.transform("values", lambda c: c.cast("long")).alias("verts"))


def fields(tensors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bundle, row, cdf, dcdf, offset, offsetc) of field bundles: cdf and dcdf held to [0, 1], rows faces, or vertices then faces.

    ``sizes(bundle, n_vertices, n_faces)``; a bundle with another number of rows is an error. Tensors that a bundle lacks are null.
    """
    names = ["cdf", "dcdf", "offset", "offsetc"]
    rows = tensors.where(F.col("tensor").isin(names)).groupBy("bundle", "row").agg(*(F.max(F.when(F.col("tensor") == n, F.col("values"))).alias(n) for n in names))
    n = rows.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).join(sizes, "bundle")
    fits = (F.col("n") == F.col("n_faces")) | (F.col("n") == F.col("n_vertices") + F.col("n_faces"))
    checked = n.select("bundle", F.when(fits, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("field rows do not fit the mesh of "), F.col("bundle"))).cast("long")).alias("n"))
    held = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(c, F.lit(0)))).alias(c)
    return rows.join(checked, "bundle").where("n > 0").select("bundle", "row", held("cdf"), held("dcdf"), "offset", "offsetc")
