"""Tables that stages hand on, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of our own only where none is named and one machine runs all."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    if (kept := _kept.get()) is not None:
        kept.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored in here is deleted at the end: results must be written by then. Threads and tasks do not share it."""
    paths: list[str] = []
    token = _kept.set(paths)
    try:
        yield
    finally:
        _kept.reset(token)
        for path in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder: nothing before it runs again."""
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
