"""A BM25 index that is stored, added to and removed from, and searched by many queries at once.

The index is split by document: a row holds a document's length and its terms with their counts. Searching needs no shuffle of
postings: the terms of the queries go to every task in blocks of bounded size, each task scores its documents against them
slice by slice and hands on its k best for each query once, at its end, and these few are ranked together. Scores are exact; no
term, document or candidate is left out. For repeated searches there is an inverted form as well, see `blockmax`.

A stored index is a folder of additions. Additions and removals are written beside what is there; a row counts unless its
document was removed, or added again, later.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarryloom.functions.tokens import terms
from quarryloom.sources.shared import exists, saved, temporary

K1, B = 1.5, 0.75
#: Query terms that go to the tasks at once; scores that a task holds at once; and terms, or terms times the queries that
#: have them, that it works on at once.
ASKED_TERMS, HELD_SCORES, HELD_TERMS = 500_000, 1 << 20, 1 << 19


def cuts(size: np.ndarray, most: int, rows: int | None = None):
    """(from, to) of stretches whose sizes add up to `most` at most, and that are `rows` long at most; each has one at least."""
    total, low = np.append(0, np.cumsum(size)), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, side="right")) - 1)
        high = min(high, low + rows) if rows else high
        yield low, high
        low = high


def slices(batches, column: str):
    """Batches cut so that the lists of a column hold HELD_TERMS together at most, or are one: what a task holds besides the
    batch does not grow with it. A batch without rows stays."""
    for b in batches:
        size = np.asarray(pc.fill_null(pc.list_value_length(b.column(column)), 0)).astype(np.int64)
        if not len(size):
            yield b
        for low, high in cuts(size, HELD_TERMS):
            yield b.slice(low, high - low)


def forward(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), tokens: Callable[[Column], Column] = terms) -> DataFrame:
    """(doc_id, dl, terms, tfs, carried columns): each document's length, its different terms and how often it has them."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType)] + [docs.schema[c] for c in carry]
    added = T.StructType.fromDDL("dl long, terms array<string>, tfs array<int>").fields
    names = ["doc_id", *carry]

    def run(batches):
        for b in slices(batches, "_t"):
            found = b.column("_t")
            flat, n = found.flatten().dictionary_encode(), np.diff(np.asarray(found.offsets))
            kinds = max(len(flat.dictionary), 1)
            key, tf = np.unique(np.repeat(np.arange(len(n)), n) * kinds + np.asarray(flat.indices, dtype=np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * kinds), pa.int32())
            term = flat.dictionary.take(pa.array(key % kinds))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, term), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], [*names, "dl", "terms", "tfs"]
            )

    base = docs.select(F.col(doc_id).alias("doc_id"), *carry, tokens(F.col(text)).alias("_t"))
    return base.mapInArrow(run, T.StructType(fields + added))


#: What was removed and when; a run that removed nothing leaves a folder without files.
GONE = "doc_id long, version int"

# --- the stored form -------------------------------------------------------------------------------------------------


def create(docs: DataFrame, path: str) -> None:
    forward(docs).withColumn("version", F.lit(0)).write.partitionBy("version").parquet(f"{path}/documents")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The documents that count."""
    rows = spark.read.parquet(f"{path}/documents")
    if not exists(spark, f"{path}/gone"):
        return rows.drop("version")
    gone = spark.read.schema(GONE).parquet(f"{path}/gone").groupBy("doc_id").agg(F.max("version").alias("gone"))
    return rows.join(gone, "doc_id", "left").where("gone IS NULL OR version >= gone").drop("version", "gone")


def _next(spark: SparkSession, path: str) -> int:
    last = spark.read.parquet(f"{path}/documents").agg(F.max("version")).first()[0]
    if exists(spark, f"{path}/gone"):
        last = max(last, spark.read.schema(GONE).parquet(f"{path}/gone").agg(F.max("version")).first()[0] or 0)
    return last + 1


def add(docs: DataFrame, path: str) -> None:
    """Adds documents; one that is there already is replaced."""
    spark = docs.sparkSession
    version = _next(spark, path)
    again = docs.select("doc_id").join(load(spark, path).select("doc_id"), "doc_id", "left_semi").distinct()
    again.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/gone")
    forward(docs).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/documents")


def remove(ids: DataFrame, path: str) -> None:
    """Takes documents out; ids that are not there change nothing."""
    version = _next(ids.sparkSession, path)
    # Rows of earlier versions are hit, what is added next is not.
    ids.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(f"{path}/gone")


def vocabulary(index: DataFrame) -> DataFrame:
    """(term, df, cf, idf, first_doc) of all terms."""
    stats = index.agg(F.count("*").alias("n_docs"))
    rows = index.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x"))
    counted = rows.groupBy(F.col("x.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("x.tfs").alias("cf"), F.min("doc_id").alias("first_doc"))
    # The statistics are one row.
    return counted.join(F.broadcast(stats)).withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("n_docs")


# --- search ----------------------------------------------------------------------------------------------------------


def _places(found: pa.ListArray, known: pa.Array):
    """Numbers among `known` of the terms of each row, with their rows and places; others are left out."""
    flat = found.flatten()
    at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=known), -1))
    row = np.repeat(np.arange(len(found)), np.diff(np.asarray(found.offsets)))
    keep = np.flatnonzero(at >= 0)
    return at[keep], row[keep], keep


def _document_counts(shared):
    """How many documents have each term; -1 counts all documents and sums their lengths."""

    def run(batches):
        known = pa.array(shared.value, pa.string())
        for b in slices(batches, "terms"):
            at, _, _ = _places(b.column("terms"), known)
            n = np.bincount(at, minlength=len(known))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(n[some], b.num_rows), pa.int64()), pa.array(np.append(n[some] * 0, pc.sum(b.column("dl")).as_py() or 0), pa.int64())], ["term", "n", "dl"])

    return run


class Best:
    """The k best of each query (and group) that one task has seen so far: at most twice as many rows are held."""

    def __init__(self, k: int, columns: int):
        self.k, self.parts, self.size, self.limit = k, [], 0, max(2 * k * columns, 1 << 16)

    def add(self, *part: np.ndarray) -> bool:
        """part: query, group, id, score. Whether what is held was cut to the best after it."""
        self.parts.append(part)
        self.size += len(part[0])
        if self.size <= self.limit:
            return False
        kept = self.rows()
        self.parts, self.size = [kept], len(kept[0])
        # More groups than expected only raise what is held before the next round.
        self.limit = max(self.limit, 2 * self.size)
        return True

    def least(self, columns: int) -> np.ndarray:
        """Right after a cut without groups: the score that a row of each query has to reach, as it has k better ones."""
        query, _, _, score = self.parts[0]
        end = np.searchsorted(query, np.arange(columns), side="right")
        full = np.bincount(query, minlength=columns) >= self.k
        return np.where(full, score[end - 1], -np.inf)

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, group, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, group, query))
        query, group, ids, score = query[order], group[order], ids[order], score[order]
        new = np.ones(len(query), bool)
        new[1:] = (query[1:] != query[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(new)
        keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < self.k
        return query[keep], group[keep], ids[keep], score[keep]


class Labels:
    """Numbers for the values of a group column, in the order in which a task meets them."""

    def __init__(self):
        self.number: dict = {}

    def of(self, column: pa.Array) -> np.ndarray:
        return np.array([self.number.setdefault(v, len(self.number)) for v in column.to_pylist()], np.int64)

    def take(self, numbers: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(list(self.number), kind).take(pa.array(numbers))


def _score(shared, k: int, k1: float, b_: float, group: str | None, weigh: bool):
    def run(batches):
        queries, words, idf, start, asking, average = shared.value
        known = pa.array(words, pa.string())
        size = np.diff(start)
        held, labels, kind = Best(k, len(queries)), Labels(), None
        for b in slices(batches, "terms"):
            places = _places(b.column("terms"), known)
            tfs, dls, ids = np.asarray(b.column("tfs").flatten(), dtype=float), np.asarray(b.column("dl"), dtype=float), np.asarray(b.column("doc_id"))
            kinds = labels.of(b.column(group)) if group else np.zeros(b.num_rows, np.int64)
            kind = b.schema.field(group).type if group else None
            # Postings come by row; those of a row, times the queries that have their terms, are an entry of `asked`.
            asked = np.bincount(places[1], weights=size[places[0]], minlength=b.num_rows)
            first = np.searchsorted(places[1], np.arange(b.num_rows + 1))
            for low, high in cuts(asked, HELD_TERMS, max(1, HELD_SCORES // max(len(queries), 1))):
                at, row, place = (x[first[low] : first[high]] for x in places)
                tf, dl, row = tfs[place], dls[row], row - low
                part = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b_ + b_ * dl / average)) if weigh else np.ones(len(at))
                # Every posting counts for each query that has its term; documents and queries that share none have no cell.
                n = size[at]
                which = asking[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                cell = np.repeat(row, n) * len(queries) + which
                if 8 * len(cell) < (high - low) * len(queries):
                    cell, inverse = np.unique(cell, return_inverse=True)
                    score = np.bincount(inverse, weights=np.repeat(part, n), minlength=len(cell))
                else:
                    score = np.bincount(cell, weights=np.repeat(part, n), minlength=1)
                    cell = np.flatnonzero(score)
                    score = score[cell]
                score = np.round(score, 6)
                cell, score = cell[score > 0], score[score > 0]
                row, query = low + cell // max(len(queries), 1), cell % max(len(queries), 1)
                held.add(query, kinds[row], ids[row], score)
        query, label, ids, score = held.rows()
        if len(query):
            out = [pa.array(queries[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score)] + ([labels.take(label, kind)] if group else [])
            yield pa.RecordBatch.from_arrays(out, ["query_id", "doc_id", "score", *([group] if group else [])])

    return run


def search(queries: DataFrame, index: DataFrame, k: int, *, k1: float = K1, b: float = B, group: str | None = None, tokens: Callable[[Column], Column] = terms, weigh: bool = True, asked_terms: int = ASKED_TERMS, stored: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query that have a term of it; with `group`, a column
    of the index, the k best of each group. queries: query_id, query. Ids are whole numbers; queries without terms and
    documents without text have no hits. Without `weigh` the score is how many of a query's different terms a document has.
    tokens: how queries are cut into terms, as the texts of the index were. The hits are a table of the
    shared folder. stored: the index is read from files as it is, and need not be saved to be read twice."""
    spark = index.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).where("query_id IS NOT NULL").distinct()
    blocks = max(1, -(-asked.count() // asked_terms))
    fields = [T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())] + ([index.schema[group]] if group else [])
    with temporary(spark) as keep:
        if not stored:
            index = saved(index, "forward")  # counts and scores of each block of queries read it again
        hits = _hits(asked, blocks, index, k, k1, b, group, weigh, T.StructType(fields))
        order = Window.partitionBy("query_id", *([group] if group else [])).orderBy(F.desc("score"), "doc_id")
        return keep(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "hits")


def _hits(asked: DataFrame, blocks: int, index: DataFrame, k: int, k1: float, b: float, group: str | None, weigh: bool, schema: T.StructType) -> DataFrame:
    """What the tasks hand on, for all blocks of queries."""
    spark, out = index.sparkSession, None
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        ids, query = np.unique(np.asarray(block.column("query_id"), dtype=np.int64), return_inverse=True)
        coded = block.column("term").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        words, term = coded.dictionary, np.asarray(coded.indices)
        order = np.argsort(term, kind="stable")
        start = np.searchsorted(term[order], np.arange(len(words) + 1))
        sc = spark.sparkContext
        counted = index.select("terms", "dl").mapInArrow(_document_counts(sc.broadcast(words.to_pylist())), "term long, n long, dl long")
        counted = {r["term"]: r for r in counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).collect()}
        n_docs, length = (counted[-1]["n"], counted[-1]["dl"]) if -1 in counted else (0, 0)
        df = np.array([counted[t]["n"] if t in counted else 0 for t in range(len(words))], float)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        shared = sc.broadcast((ids, words.to_pylist(), idf, start, query[order], max(length / max(n_docs, 1), 1e-9)))
        hits = index.select("doc_id", "dl", "terms", "tfs", *([group] if group else [])).mapInArrow(_score(shared, k, k1, b, group, weigh), schema)
        out = hits if out is None else out.unionByName(hits)
    return out
