"""A folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from celestile.sources import paths as P


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed at the end. Where that is unset, a local
    one in local mode only; on a cluster executors wouldn't share it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        made = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        P.make_directory(made, exist_ok=True)
        atexit.register(P.remove_directory, made, ignore_errors=True)
        return made
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix=f"{name}-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made
