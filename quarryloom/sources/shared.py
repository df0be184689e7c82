"""The folder that the driver and all executors share, and tables kept there."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where none is set and all runs on one machine, as in tests, a temporary
    folder takes its place; on a cluster, executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The paths that the innermost `temporary` of this thread has to delete.
_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once and read back, so that later jobs neither repeat nor depend on what made them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if (mine := _open.get()) is not None:
        mine.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables saved inside, by the same thread, are deleted at the end, but for those saved by the function that this
    gives: these go with the `temporary` around it, or stay if there is none."""
    outer, mine = _open.get(), []
    token = _open.set(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _open.set(outer)
        try:
            return saved(df, name)
        finally:
            _open.reset(inner)

    try:
        yield keep
    finally:
        _open.reset(token)
        for path in mine:
            delete(spark, path)


def sorted_in(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is done by sorting both sides, whatever size Spark takes it for. It takes an explode
    or a Python function for no larger than what it reads, and a table for no larger than its compressed files; so it would
    send a table that grows with the input to the driver, and from there to all tasks."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of this name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
