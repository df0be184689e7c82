"""The whole chain of a hybrid search over many queries: two rankings, fusion, filter, second scores, diversity, threshold,
removal of near copies, and what to fall back to.

Up to and with the second scores everything is a join or a ranking over all queries at once. What follows depends on what
was chosen before, so it runs once for each query over its fused list, which is bounded: diversity orders the list, rows
below the threshold and near copies of rows above them go, and if that leaves nothing, the list as diversity ordered it is
the result. A query without a vector keeps its order; a document without one is like no other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.functions.tokens import dot
from quarryloom.operators.fingerprints import NEAR_IN_RESULTS, simhash
from quarryloom.operators.retrieval import _lists, rrf, sigmoid, top_k, with_vectors
from quarryloom.sources.tables import table

#: Candidates after fusion, results, weight of relevance against diversity, and the least second score.
FUSED, RESULTS, RELEVANCE = 20, 10, 0.7
THRESHOLD = 0.7


def diverse(relevance: np.ndarray, like: np.ndarray, lam: float, k: int) -> list[int]:
    """Rows in the order in which they are chosen: each time the one with the best trade of its relevance for its greatest
    likeness to what is chosen already; of equal ones the first."""
    chosen: list[int] = []
    while len(chosen) < min(k, len(relevance)):
        value = np.round(lam * relevance - (1 - lam) * (like[:, chosen].max(axis=1) if chosen else 0.0), 9)
        value[chosen] = -np.inf
        chosen.append(int(value.argmax()))
    return chosen


def without_copies(hi: np.ndarray, lo: np.ndarray, near: int) -> list[int]:
    """Rows, in order, more than `near` bits from every row that stayed before them."""
    kept: list[int] = []
    for i in range(len(hi)):
        if all(int(hi[i] ^ hi[j]).bit_count() + int(lo[i] ^ lo[j]).bit_count() > near for j in kept):
            kept.append(i)
    return kept


def finished(ranked: DataFrame, *, k: int = RESULTS, lam: float = RELEVANCE, threshold: float = THRESHOLD, near: int = NEAR_IN_RESULTS) -> DataFrame:
    """(query_id, doc_id, rank, second, fell_back) of each query's list. ranked: query_id, doc_id, place, second, qv, dv, hi, lo."""

    def run(pdf):
        pdf = pdf.sort_values("place").reset_index(drop=True)
        asked = pdf.qv.iloc[0]
        if asked is not None:
            v = np.stack([np.zeros(len(asked)) if x is None else np.asarray(x, float) for x in pdf.dv])
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            q = np.asarray(asked, float) / max(np.linalg.norm(np.asarray(asked, float)), 1e-12)
            pdf = pdf.loc[diverse(v @ q, v @ v.T, lam, k)].reset_index(drop=True)
        left = pdf[pdf.second >= threshold]
        left = left.iloc[without_copies(left.hi.to_numpy(), left.lo.to_numpy(), near)]
        out = (left if len(left) else pdf).head(k)
        out = out.assign(rank=np.arange(1, len(out) + 1), fell_back=not len(left))
        return out[["query_id", "doc_id", "rank", "second", "fell_back"]]

    return ranked.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int, second double, fell_back boolean")


def candidates(spark, d) -> DataFrame:
    """The fused lists of all queries, of which English documents stay, in the order of their second scores; documents
    without one behind, as they were."""
    docs, vectors = table(spark, d, "documents"), table(spark, d, "embeddings")
    fused = top_k(rrf(_lists(spark, d).withColumn("weight", F.lit(0.5))), FUSED, name="fused_rank")
    kept = fused.join(docs.where("lang = 'en'").select("doc_id", "text"), "doc_id")
    again = with_vectors(kept, vectors, "left").withColumn("second", F.round(sigmoid(dot(F.col("qv"), F.col("dv"))), 6))
    ranked = top_k(again, FUSED, F.desc_nulls_last("second"), F.col("fused_rank"), name="place")
    prints = simhash(ranked.select("doc_id", "text").dropDuplicates(["doc_id"]))
    return ranked.drop("text").join(prints, "doc_id").select("query_id", "doc_id", "place", "second", "qv", "dv", "hi", "lo")


QUERIES = {"hybrid_search_chain": lambda s, d: finished(candidates(s, d))}
ORACLE: dict[str, str] = {}
