"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every text contract: space and U+0009 to U+000D.
WS = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and runs on one machine (tests).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage through a compressed table in the shared folder."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored`` and the table's folder, to be deleted when nothing reads it any more."""
    path = stage_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run in here leaves no shuffle files; else they stay until the driver collects its garbage.

    Only for tables that are made in here and run once.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


_scratch: list[list[str]] = []


def stage_folder(spark: SparkSession) -> str:
    """A fresh name in the shared folder for tables that stages hand on."""
    path = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators store in here are deleted at the end; their results must be written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            deleted(spark, path)


def deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def private_names(df: DataFrame, *names: str) -> None:
    """Fail early when a required column is missing, naming it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    while name in df.columns:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: lambda variables are evaluated a single time per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
