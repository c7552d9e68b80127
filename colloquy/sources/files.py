"""Folders that executors and driver share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder if all tasks run in the driver's own
    process (tests), and an error on a cluster, whose executors have no folder in common."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = tempfile.mkdtemp(prefix="colloquy-")
            atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
        base = f"file://{_LOCAL['dir']}"
    return base.rstrip("/")


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: what is built on them reads it instead of working them out again, and an
    executor that is lost takes nothing along."""
    path = f"{shared_dir(rows.sparkSession)}/colloquy/{name}-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
