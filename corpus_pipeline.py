"""From raw documents to token ids: five stages, each written as Parquet and reread by the next.

Quality rules drop documents; near-duplicate detection leaves one document of each group; suffix-order dedup cuts later
copies of passages of over 50 words out of the texts, and documents of which nothing is left; decontamination drops
documents of which a twentieth or more stands in benchmark windows; the last stage encodes. Every stage but the last
returns the columns of documents, with n_chars (where there is one) kept true to the text.

Other columns pass through whatever they are called; the last stage replaces columns with the names of its results. Null
and empty texts, and very short ones, fail the quality rules. Of repeated rows one stays. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from quarryloom.llm.storage import file_row, saved, temporary


def carried(docs: DataFrame):
    """docs with all columns but doc_id and text under names that no operator uses, and what gives the names back."""
    names = {c: f"_user{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    inner = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items()))

    def back(out: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
        columns = {c: F.col(names.get(c, c)) for c in docs.columns} | (new or {})
        return out.select(*(v.alias(c) for c, v in columns.items()))

    return inner, back


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, back = carried(docs)
    return back(quality.judge(inner, quality.trusted_ids(spark, sf_dir)).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, back = carried(docs)
    return back(near_dedup.dedup(inner))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, back = carried(docs)
    others = [c for c in inner.columns if c != "text"]
    out = suffix_dedup.dedup(inner, columns=others, as_text=True, row=row_of(inner), length=suffix_dedup.PASSAGE_WORDS, by_words=True)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return back(out.where("n_removed = 0 OR length(trim(kept)) > 0"), new)


def row_of(docs: DataFrame) -> Column | None:
    """What tells the rows of a stage's input apart, as it is read from files; nothing for other tables."""
    try:
        docs.select(file_row())
    except AnalysisException:
        return None
    return file_row()


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, back = carried(docs)
    return back(decontaminate.judged(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT contaminated"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    inner, back = carried(docs)
    coded = bpe.encode(inner, *bpe.public_ranks(), with_decoded=True)
    results = {"ids": F.col("ids"), "n_tokens": (F.length("ids") / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}
    return back(coded, results)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark passages", benchmark_passages),
    ("token ids", token_ids),
]

#: No SQL: the second, third and last stages cannot be put in it. The tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. Of the tables between them the last one stays, as the result reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (name, stage), (_, last) = STAGES
    with temporary(spark) as keep:
        for k, f in first:
            docs = saved(f(spark, docs, sf_dir), k.replace(" ", "-"))
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
