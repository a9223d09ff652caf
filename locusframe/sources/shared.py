"""A folder that the driver and all executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under the warehouse of a local master, and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


_MADE: list[str] = []


def drop_shared(spark: SparkSession) -> int:
    """Delete the folders of this session. Lazy results read them, so call it once those are written; returns how many went."""
    path, conf, n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _MADE:
        at = path(_MADE.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, so that what is used several times is computed once and outlives an executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_named(lines: DataFrame, folder: str, name: str) -> None:
    """One text file of a given name (a small table: one task writes it)."""
    spark, at = lines.sparkSession, f"{folder}/_{uuid.uuid4().hex}"
    lines.coalesce(1).write.text(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(path(at)) if f.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(at), True)
