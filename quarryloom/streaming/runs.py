"""Running a stream over what its source holds now, and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.shared import new_path as folder


def source(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a file stream."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # As a pattern the path may be one file as well as a folder.
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def closed(stream: DataFrame, spark: SparkSession, sf_dir: str, name: str, time: str, after: str = "INTERVAL 2 DAYS") -> DataFrame:
    """The stream of a table with one more row from a second source, whose time is later than all others and whose other
    columns are null: it lifts the watermark over what the table holds, so that the last windows are given out too."""
    last = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg((F.max(F.col(time).cast("timestamp")) + F.expr(after)).alias(time))
    path = folder(spark, "closing")
    last.select(*(F.col(time) if c == time else F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in stream.columns)).coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def drained(stream: DataFrame, name: str, mode: str, write=None, path: str | None = None, progress: list | None = None) -> DataFrame:
    """Runs the stream until its source is drained; its batches are the result. `write(batch, batch_id, path)` may replace
    the plain write; a batch that is run again overwrites itself. With the `path` of an earlier run that was stopped, it
    goes on where that one ended. progress: takes what the query reports of its batches."""
    spark = stream.sparkSession
    path, schema = path or folder(spark, name), stream.schema
    last = []

    def batch(df: DataFrame, n: int) -> None:
        (write or (lambda b, i, p: b.write.mode("overwrite").parquet(f"{p}/{i}")))(df, n, path)
        last.append(n)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    if not last:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{path}/{n}" for n in sorted(set(last))]) if write is None else spark.read.option("mergeSchema", True).parquet(path)
