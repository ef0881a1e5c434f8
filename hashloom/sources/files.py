"""Folders that driver and executors share, and files in them."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local(application: str) -> str:
    return tempfile.mkdtemp(prefix="hashloom-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; without that setting below a folder of this machine, for a local master alone. No setting is changed."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local(context.applicationId)
    return f"{base.rstrip('/')}/hashloom-{context.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to a new shared folder and read back: what several steps read is worked out once, and outlives a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(path: str):
    """(filesystem, path in it) of a folder named by a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
