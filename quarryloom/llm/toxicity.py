"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The score of a sentence is the logistic of a bias and its words' weights; that of a
document is the noisy-or of its sentences, so one offending sentence suffices. Weights are trained from document labels
alone, on whole texts. `train_documents` bounds the sample: half the places are for either label, in order of a hash of the
id, and places that one label leaves free go to the other, so with no more labels than that all are learnt from. Where there
are more than four negative documents to a positive one, each counts less, as if there were four.

Spark counts the documents of each word; words are candidates for a weight if they, or their beginnings, stand in
`min_documents` training documents or more and with positives more often than chance allows, the `features` best of them. A
sentence is then known by its candidates alone, so the driver gets how often each set of them stands in negative documents,
and the sets of each positive one, equal ones once: no texts. Scoring is one map over all whole texts; sentences with high
scores are returned with their places.

Null and empty texts have no sentences and score 0. Repeated rows score alike; extra columns pass through `score`, columns
named score and sentences are replaced. Without positive labels all weights are 0. Rows whose id or label is null are not
trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm import textbytes as tb
from quarryloom.llm.storage import saved, temporary
from quarryloom.sources.tables import table

MIN_DOCUMENTS, EPOCHS, FOLDS = 4, 150, 5
TRAIN_DOCUMENTS, FEATURES = 16_000, 20_000
#: Lengths in bytes of word beginnings that are features beside the word.
PREFIXES = (4, 6)
_LOWER = tb.lower_table()
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


class Bags:
    """Words of a batch of texts as numbers, by sentence and document."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        flat = _LOWER[flat]
        start, end, self.document = tb.words(flat, offsets, tb.ALPHANUMERIC)
        prefix = tb.prefix_hash(flat)
        columns = [tb.span_hash(prefix, start, end)]
        for n in PREFIXES:
            columns.append(np.where(end - start > n, tb.span_hash(prefix, start, np.minimum(start + n, end)) ^ np.uint64(n), np.uint64(0)))
        #: A row for each word: the word and its beginnings, by which inflected and joined forms are known; 0 if absent.
        self.word = np.stack(columns, axis=1)
        stop = np.concatenate([[0], np.cumsum(_ENDS[flat])])
        mark = stop[start] if len(start) else start
        new = np.ones(len(start), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (self.document[1:] != self.document[:-1])
        #: First word of each sentence, its document, and its bytes in the document.
        self.first = np.flatnonzero(new)
        self.owner = self.document[self.first]
        last = np.append(self.first[1:], len(start))[: len(self.first)] - 1
        self.begin, self.finish = (start[self.first] - offsets[self.owner], end[last] - offsets[self.owner]) if len(start) else (start, start)
        self.n = len(offsets) - 1


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def sentences(self, bags: Bags) -> np.ndarray:
        total = np.zeros(len(bags.first))
        if len(self.words) and len(bags.word):
            at = np.minimum(np.searchsorted(self.words, bags.word), len(self.words) - 1)
            total = np.add.reduceat(np.where(self.words[at] == bags.word, self.weights[at], 0.0).sum(axis=1), bags.first)
        return logistic(total + self.bias)

    def documents(self, bags: Bags, p: np.ndarray) -> np.ndarray:
        return -np.expm1(np.bincount(bags.owner, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=bags.n))


def _count(batches):
    """Words of labelled documents: in how many, and in how many positive ones; 0 stands for all documents."""
    for b in tb.slices(batches):
        bags = Bags(*tb.texts(b.column("text")))
        label = np.asarray(b.column("_y"), dtype=np.int64)
        flat, owner = bags.word.ravel(), np.repeat(bags.document, bags.word.shape[1])
        order = np.argsort(flat, kind="stable")
        word, owner = flat[order], owner[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])
        new &= word != 0
        word, owner = word[new], owner[new]
        words, start = np.unique(word, return_index=True)
        count = np.diff(np.append(start, len(word)))
        positive = np.add.reduceat(label[owner], start) if len(start) else start
        columns = (np.append(words.view(np.int64), 0), np.append(count, len(label)), np.append(positive, label.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64), pa.int64()) for x in columns], ["word", "n", "positive"])


def _sets(shared):
    """Sentences as sets of candidates (their numbers as bytes): those of each positive document, and the negatives' by set."""
    kind = pa.list_(pa.struct([("s", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        words = shared.value
        for b in tb.slices(batches):
            bags = Bags(*tb.texts(b.column("text")))
            label = np.asarray(b.column("_y"), dtype=np.int64)
            flat = bags.word.ravel()
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            known = np.flatnonzero(words[at] == flat)
            at, sentence = at[known].astype(np.int32), np.searchsorted(bags.first, known // bags.word.shape[1], "right") - 1
            order = np.lexsort((at, sentence))
            at, sentence = at[order], sentence[order]
            which, start = np.unique(sentence, return_index=True)
            plain = np.bincount(bags.owner, minlength=bags.n) - np.bincount(bags.owner[which], minlength=bags.n)
            held: list[dict[bytes, int]] = [{} for _ in range(bags.n)]
            for i in np.flatnonzero(plain):
                held[i][b""] = int(plain[i])
            for i, low, high in zip(bags.owner[which], start, np.append(start[1:], len(at))[: len(start)], strict=True):
                one = at[low:high].tobytes()
                held[i][one] = held[i].get(one, 0) + 1
            negative: dict[bytes, int] = {}
            for i in np.flatnonzero(label == 0):
                for k, n in held[i].items():
                    negative[k] = negative.get(k, 0) + n
            out = [(0, [{"s": k, "n": 1}], n) for k, n in negative.items()]
            out += [(1, [{"s": k, "n": n} for k, n in sorted(held[i].items())], 1) for i in np.flatnonzero(label) if held[i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], kind), pa.array([x[2] for x in out], pa.int64())], ["y", "bag", "c"])

    return run


def train(words: np.ndarray, weights: np.ndarray, bags: pa.Table, *, negative: float = 1.0, epochs: int = EPOCHS) -> Model:
    """Gradient ascent on the noisy-or likelihood from the given weights. bags: y, bag, c, as `_sets` gives them, equal ones
    summed; negative: what a negative document counts beside a positive one."""
    bag = bags.column("bag").combine_chunks()
    if isinstance(bag, pa.ChunkedArray):
        bag = pa.concat_arrays(bag.chunks) if bag.num_chunks else pa.array([], bag.type)
    entries, owner = bag.flatten(), np.repeat(np.arange(len(bag)), np.diff(np.asarray(bag.offsets)))
    coded = entries.field("s").dictionary_encode()
    sets, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    at = np.frombuffer(b"".join(sets), np.int32)
    of = np.repeat(np.arange(len(sets)), [len(x) // 4 for x in sets])
    y, times = (np.asarray(bags.column(c)) for c in ("y", "c"))
    times = times[owner] * np.asarray(entries.field("n")).astype(float)
    positive = y[owner] == 1
    absent = negative * np.bincount(code[~positive], weights=times[~positive], minlength=len(sets))
    code, owner, times = code[positive], owner[positive], times[positive]
    owner = np.unique(owner, return_inverse=True)[1]
    inside = np.asarray(entries.field("n"))[positive].astype(float)
    bias = -6.0
    moment, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for k in range(1, epochs + 1):
        p = logistic(np.bincount(of, weights=weights[at], minlength=len(sets)) + bias)
        q = p[code]
        whole = np.maximum(-np.expm1(np.bincount(owner, weights=inside * np.log1p(-np.minimum(q, 1 - 1e-12)))), 1e-9)[owner]
        slope = np.bincount(code, weights=times * q * (1 - whole) / whole, minlength=len(sets)) - absent * p
        grad = np.append(np.bincount(at, weights=slope[of], minlength=len(words)) - 0.05 * weights, slope.sum())
        moment, second = 0.9 * moment + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = 0.15 * moment / (1 - 0.9**k) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        weights, bias = np.maximum(weights + step[:-1], 0.0), min(bias + step[-1], -3.0)
    return Model(words, weights, float(bias))


def sample(labels: DataFrame, size: int) -> DataFrame:
    """At most `size` rows of (_id, _y): half of either label as far as there are, the rest of the other."""
    has = {r["_y"]: r["count"] for r in labels.groupBy("_y").count().collect()}
    ones = min(has.get(1, 0), max(size // 2, size - has.get(0, 0)))
    take = lambda y, n: labels.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
    return take(1, ones).unionByName(take(0, size - ones))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", min_documents: int = MIN_DOCUMENTS, train_documents: int = TRAIN_DOCUMENTS, features: int = FEATURES, **options) -> Model:
    """Trains on at most `train_documents` labelled documents. Labels: doc_id, label (1 or 0); the greatest counts."""
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y")).where("_y IN (0, 1)")
    chosen = sample(chosen, train_documents)
    found = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select("_y", "text")
    with temporary(docs.sparkSession):
        found = saved(found, "labelled")
        counts = saved(found.mapInArrow(_count, "word long, n long, positive long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")), "words")
        whole = counts.where("word = 0").first()
        if whole is None or whole.positive in (0, whole.n):
            return Model(np.zeros(0, np.uint64), np.zeros(0), -8.0)
        # Only words whose share of positives is above the usual by more than chance allows can make a sentence offend.
        base = (whole.positive + 1) / (whole.n + 2)
        z = (F.col("positive") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)))
        good = counts.where((F.col("word") != 0) & (F.col("n") >= min_documents) & (z > 3)).orderBy(z.desc(), "word").limit(features).toArrow()
        words, n, positive = (np.asarray(good.column(c)) for c in ("word", "n", "positive"))
        order = np.argsort(words.view(np.uint64))
        words, rate = words.view(np.uint64)[order], ((positive + 1) / (n + 2))[order]
        # A word starts from the log odds of the documents that have it.
        weights = 0.4 * np.log(rate / (1 - rate) / (base / (1 - base)))
        if not len(words):
            return Model(words, weights, -6.0)
        sets = found.mapInArrow(_sets(docs.sparkSession.sparkContext.broadcast(words)), "y int, bag array<struct<s:binary,n:long>>, c long")
        return train(words, weights, sets.groupBy("y", "bag").agg(F.sum("c").alias("c")).orderBy("y", "bag").toArrow(), negative=min(1.0, 4 * whole.positive / (whole.n - whole.positive)), **options)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, sentence_score: float = 0.5) -> DataFrame:
    """Adds score and sentences: the places (bytes) and scores of sentences of `sentence_score` or more."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "sentences")]
    carried = list(dict.fromkeys([*names, text]))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("sentences", T.ArrayType(T.StructType.fromDDL("start long, end long, score double")))]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        model = shared.value
        for whole in batches:
            named = whole.rename_columns(["text" if c == text else f"_{c}" for c in whole.schema.names])
            for b in tb.slices([named]):
                bags = Bags(*tb.texts(b.column("text")))
                p = model.sentences(bags)
                places = [[] for _ in range(bags.n)]
                for k in np.flatnonzero(p >= sentence_score):
                    places[bags.owner[k]].append({"start": int(bags.begin[k]), "end": int(bags.finish[k]), "score": float(p[k])})
                columns = [b.column("text" if c == text else f"_{c}") for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.documents(bags, p)), pa.array(places, kind)], [*names, "score", "sentences"])

    return docs.select(*carried).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + fields))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the fold with crc32(doc_id) divisible by five are never learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % FOLDS
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 0)
    scored = score(docs, fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), F.size("sentences").alias("n_sentences"))
