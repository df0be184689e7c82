"""Reading the tables, and the tables derived from them that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_TYPES = ["textbook", "slide", "question_bank"]


#: Tables of texts of up to so many bytes are dealt evenly over the cores; see `table`.
SPREAD_BYTES, TEXTS = 64 << 20, {"documents", "conversations", "pages", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. A file of one row group is read by one task, whatever the number of cores; texts in so small a table are
    dealt out again before work starts on them. Greater tables are left as their files split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and df._jdf.queryExecution().analyzed().stats().sizeInBytes() <= SPREAD_BYTES:
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: source type, path and parent of each."""
    kind = F.element_at(F.array(*map(F.lit, SOURCE_TYPES)), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".md"), F.lit(".pptx"), F.lit("_quiz.docx")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    return table(spark, sf_dir, "documents").withColumns({"source_type": kind, "source_path": path, "parent_id": F.floor(F.col("doc_id") / 4)})


#: The same in SQL, to be put before a query's own expressions.
CHUNKS_SQL = """chunks AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'textbook' WHEN 1 THEN 'slide' ELSE 'question_bank' END AS source_type,
  '/data/' || source || '/' || lang || '_' || doc_id::VARCHAR || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.pptx' ELSE '_quiz.docx' END AS source_path,
  doc_id // 4 AS parent_id FROM documents)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graded answers: user, concept, whether right, and when."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("concept"), (F.col("value") > 100).alias("correct"), "value", F.col("ts").cast("timestamp").alias("ts"))


ANSWERS_SQL = "answers AS (SELECT event_id, user_id, event_type AS concept, value > 100 AS correct, value, ts FROM events)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
