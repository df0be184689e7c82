"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.shared import shared_folder


def file_row() -> Column:
    """A number for each row of a scan of files that no way of splitting them changes: of its file and its place there.
    Only for tables read from files, not for what is computed from several."""
    return F.xxhash64("_metadata.file_path", "_metadata.row_index")


#: The paths that the innermost `temporary` of this thread has to delete.
_open: ContextVar[list[str] | None] = ContextVar("_open", default=None)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, written once and read back, so that later jobs neither repeat nor depend on what made them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
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
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in mine:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def maybe_among(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 23) -> tuple[DataFrame, DataFrame]:
    """(rows of `df` whose `column` may be in `ids`, rows for which it is not). `ids` has one column without nulls. A
    bitmap of a fixed number of bits, at most bits/64 rows whatever the input, is broadcast; a join of the first part
    with `ids` has to follow, and moves fewer rows than one of all of `df`."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(_place % 64 AS int))")
    words = ids.select(place(F.col(ids.columns[0])).alias("_place")).select(F.floor(F.col("_place") / 64).alias("_word"), bit.alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = df.withColumn("_place", place(F.col(column))).withColumn("_word", F.floor(F.col("_place") / 64))
    marked = marked.join(F.broadcast(words), "_word", "left").withColumn("_maybe", F.coalesce(bit.bitwiseAND(F.col("_bits")) != 0, F.lit(False)))
    return marked.where("_maybe").select(*df.columns), marked.where("NOT _maybe").select(*df.columns)
