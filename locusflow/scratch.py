"""Folders for files that a query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def base(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset: a temporary one in local mode (tests); on a
    cluster, whose machines share no such folder, an error."""
    global _own
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="locusflow-")
        atexit.register(shutil.rmtree, _own, True)
    return "file://" + _own


def folder(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder."""
    return f"{base(spark)}/{tag}-{uuid.uuid4().hex}"
