"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset on a single machine (tests) a
    temporary one is chosen and kept in the session. On a cluster it must be set: each
    machine would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="celestile-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one call, written as Parquet and read back.

    Reading a written table cuts the lineage: losing executors later repeats
    only what follows, and every consumer sees the same rows.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/celestile/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, tag: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._celestile_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a saved table that nothing reads any more."""
        path = getattr(df, "_celestile_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
