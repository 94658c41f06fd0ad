"""Folders that driver and executors share, for intermediate tables and written files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, and the master is local, below a folder made for it."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="footfall-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"
