"""Stores of Parquet partitions that are changed in place: only the partitions that a change touches are written anew.

New rows and the rows that stay of touched partitions are staged first, then written over these by dynamic partition
overwrite: Spark replaces a partition when the whole write has succeeded, so a run that fails leaves the old ones. A change
that is made again finds nothing left to do but the same rows. Partitions that end up empty are deleted last; a run that
stops between the two steps is set right by running it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.shared import delete, saved, temporary


def create(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.partitionBy(*by).parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _rewrite(store: DataFrame, path: str, touched: DataFrame, left: DataFrame, by: list[str]) -> None:
    """store: the rows now; touched: partitions that change; left: what these shall hold. Of the touched partitions, whose
    number is that of folders, only those that become empty come to the driver."""
    staged = saved(left, "staged")
    emptied = touched.join(staged.select(*by).distinct(), by, "left_anti")
    folders = store.join(emptied, by, "left_semi").select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))
    gone = [r.folder for r in folders.distinct().collect()]
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for folder in gone:
        delete(store.sparkSession, folder)


def _with_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """The store with the place of each row's file, which joins would lose."""
    return read(spark, path, schema).select("*", F.col("_metadata"))


def upsert(new: DataFrame, path: str, key: list[str], by: list[str]) -> None:
    """Rows of `new` replace those of the same key, wherever these are. `new` has one row a key."""
    spark = new.sparkSession
    with temporary(spark):
        new = saved(new, "new")
        store = _with_files(spark, path, new.schema)
        keys = new.select(*key)
        touched = saved(store.join(keys, key, "left_semi").select(*by).unionByName(new.select(*by)).distinct(), "touched")
        stays = store.join(touched, by, "left_semi").join(keys, key, "left_anti").select(*new.columns)
        _rewrite(store, path, touched, stays.unionByName(new), by)


def remove(ids: DataFrame, path: str, key: list[str], by: list[str], schema) -> None:
    """Rows whose key is in `ids` go."""
    spark = ids.sparkSession
    with temporary(spark):
        ids = saved(ids.select(*key).distinct(), "ids")
        store = _with_files(spark, path, schema)
        touched = saved(store.join(ids, key, "left_semi").select(*by).distinct(), "touched")
        stays = store.join(touched, by, "left_semi").join(ids, key, "left_anti").drop("_metadata")
        _rewrite(store, path, touched, stays, by)
