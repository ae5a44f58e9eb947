"""Shared scratch storage and table access used by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a temporary folder serves in local mode, as in
    tests; on a cluster that folder would be the driver's own, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrille-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, partition_rows: int | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage with replicated-by-storage files, so lost executors cost a
    task retry and never a recomputation of what stands before. With
    ``partition_by`` there is a folder per value of that column, which readers
    filter by without a shuffle; the column then stands last.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrille-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    writer = df.write.option("compression", "zstd")
    if partition_rows:
        writer = writer.option("maxRecordsPerFile", partition_rows)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A table of many meshes, never broadcast unless asked for: its files, of well packed ids, tell little of its size.

    With ``parts`` it is dealt by ``mesh_id`` into so many partitions.
    """
    return (df.repartition(parts, "mesh_id") if parts else df).hint("merge")


_THRESHOLD, _OWN = "spark.sql.autoBroadcastJoinThreshold", "quadrille.ownBroadcastThreshold"


def no_guessed_broadcasts(spark: SparkSession) -> None:
    """From here on the session broadcasts what is asked for alone; its own threshold is kept for ``guessed_broadcasts``."""
    if spark.conf.get(_OWN, None) is None:
        spark.conf.set(_OWN, spark.conf.get(_THRESHOLD))
    spark.conf.set(_THRESHOLD, "-1")


def guessed_broadcasts(spark: SparkSession) -> None:
    """The session's own threshold again, where ``no_guessed_broadcasts`` took it away."""
    own = spark.conf.get(_OWN, None)
    if own is not None:
        spark.conf.set(_THRESHOLD, own)
        spark.conf.unset(_OWN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
