"""Term statistics, BM25 and dense retrieval, fusion and ranking. All work on many queries at once; text is joined to
results late, and every ranking ends with the id, so results are the same in any order of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarryloom.functions.lattice import segment_texts
from quarryloom.functions.tokens import dot, terms
from quarryloom.operators import blockmax, bm25
from quarryloom.operators.bm25 import B, K1
from quarryloom.sources.shared import new_path
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table

RRF_K = 60
#: Bytes of query vectors that go to the tasks at once.
QUERY_BYTES = 32 << 20
#: Sides of at most so many characters or rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, which is counted."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


def term_frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, tf)"""
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(terms(F.col(text))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top_k(hits: DataFrame, k: int, *by: Column, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    order = Window.partitionBy(*(group or ["query_id"])).orderBy(*(by or (F.desc("score"), F.col("doc_id"))))
    return hits.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def _unit(column: pa.ListArray) -> np.ndarray:
    """Vectors of an Arrow column as rows of length one; a vector of zeros stays."""
    m = np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _nearest(shared, k: int, group: str | None):
    def run(batches):
        asking, q, kinds = shared.value
        held = bm25.Best(k, len(asking))
        of_group = {g: np.flatnonzero(kinds == g) for g in dict.fromkeys(kinds.tolist())}
        for whole in batches:
            step = max(1, bm25.HELD_SCORES // max(len(asking), 1))
            for low in range(0, whole.num_rows, step):
                b = whole.slice(low, step)
                ids, v = np.asarray(b.column("vec_id")), _unit(b.column("embedding"))
                labels = np.asarray(b.column(group).to_pylist(), dtype=object) if group else np.zeros(len(ids), object)
                for g in dict.fromkeys(labels.tolist()):
                    rows, columns = np.flatnonzero(labels == g), of_group.get(g, ())
                    if len(columns):
                        score = np.round(np.maximum((1 + v[rows] @ q[columns].T) / 2, 0.0), 6)
                        least = np.partition(score, max(len(rows) - k, 0), axis=0)[max(len(rows) - k, 0)]
                        r, c = np.nonzero(score >= least)
                        held.add(columns[c], np.zeros(len(c), np.int64), ids[rows[r]], score[r, c])
        query, _, ids, score = held.rows()
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(asking[query], pa.int64()), pa.array(ids, pa.int64()), pa.array(score)], ["query_id", "doc_id", "score"])

    return run


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, *, group: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, doc_id, score, rank): the k nearest vectors of each query by score (1 + cosine) / 2; with `group`, a column
    of both, among those of the query's group. Exact: blocks of queries of bounded size go to every task, which multiplies
    them with its vectors and hands on its k best for each query once, at its end. queries: query_id, embedding; vectors: vec_id, embedding."""
    columns = [group] if group else []
    first = queries.where("query_id IS NOT NULL AND size(embedding) > 0").select("query_id", "embedding", *columns)
    n, width = first.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 8 // query_bytes))
    out = None
    for i in range(blocks):
        block = first.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow().combine_chunks()
        held = block.column("embedding").combine_chunks() if block.num_rows else pa.array([], pa.list_(pa.float32()))
        held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
        q = _unit(held) if len(held) else np.zeros((0, width))
        kinds = np.asarray(block.column(group).to_pylist(), dtype=object) if group else np.zeros(len(held), object)
        shared = vectors.sparkSession.sparkContext.broadcast((np.asarray(block.column("query_id"), dtype=np.int64), q, kinds))
        hits = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", "embedding", *columns).mapInArrow(_nearest(shared, k, group), "query_id long, doc_id long, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k)


def rrf(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """ranked: query_id, doc_id, rank, weight. One row per query and document with the summed reciprocal ranks."""
    return ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))


def interleave(ranked: DataFrame) -> DataFrame:
    """ranked: query_id, doc_id, rank, list_no. Alternates between the lists; a document counts where it comes first."""
    first = ranked.groupBy("query_id", "doc_id").agg(F.min(F.col("rank") * 2 + F.col("list_no")).alias("place"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "doc_id"))).drop("place")


def sigmoid(x: Column) -> Column:
    return F.when(x.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x)))))


# --- queries ---------------------------------------------------------------------------------------------------------


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks for its neighbours."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


TERMS_SQL = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][\\p{L}\\p{N}_-]*'), lambda x: lower(x)), lambda x: length(x) >= 2)"
TF_SQL = f"""coded AS (SELECT doc_id, {TERMS_SQL} AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM coded) GROUP BY ALL),
dl AS (SELECT doc_id, len(t) AS dl FROM coded),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_dl FROM dl)"""
ASKED_SQL = f"asked AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS_SQL}) AS term FROM benchmark)"


def bm25_sql(k1: float = K1) -> str:
    return f"""{TF_SQL}, {ASKED_SQL},
bm25 AS (SELECT query_id, tf.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avg_dl))), 6) AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = tf.doc_id, st GROUP BY ALL)"""


BM25_TOP_SQL = bm25_sql() + ", sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25) WHERE rank <= @k)"
DENSE_SQL = """unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dense_all AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(greatest(0.0, (1 + list_cosine_similarity(q.v, d.v)) / 2), 6) AS score FROM unit q, unit d WHERE q.vec_id % 20 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense_all) WHERE rank <= @k)"""


def _bm25(spark, d, k=10, docs=None, **o):
    return bm25.search(queries_of(spark, d), bm25.forward(table(spark, d, "documents") if docs is None else docs), k, **o)


def _dense(spark, d, k=10, vectors=None):
    return dense_search(query_vectors(spark, d), table(spark, d, "embeddings") if vectors is None else vectors, k)


def _lists(spark, d, docs=None, vectors=None):
    """Two ranked lists for the queries 0, 20, 40 and so on that have both an item and a vector: sparse and dense."""
    sparse = _bm25(spark, d, 20, docs).select("query_id", "doc_id", "rank", F.lit(0).alias("list_no"))
    dense = _dense(spark, d, 20, vectors).select("query_id", "doc_id", "rank", F.lit(1).alias("list_no"))
    return sparse.unionByName(dense)


LISTS_SQL = BM25_TOP_SQL.replace("@k", "20") + ", " + DENSE_SQL.replace("@k", "20") + ", lists AS (SELECT query_id, doc_id, rank, 0 AS list_no FROM sparse UNION ALL SELECT query_id, doc_id, rank, 1 FROM dense)"


LISTS_EN_SQL = LISTS_SQL.replace("FROM documents", "FROM documents WHERE lang = 'en'").replace("FROM unit q, unit d WHERE", "FROM unit q, unit d WHERE d.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND")


def bm25_with_text(spark, d):
    return _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "score", "rank", "text")


def rrf_query(spark, d):
    return top_k(rrf(_lists(spark, d).withColumn("weight", F.lit(1.0))), 10)


def rrf_weighted(spark, d):
    weight = F.when(F.col("list_no") == 0, 0.4).otherwise(0.6)
    return top_k(rrf(_lists(spark, d).withColumn("weight", weight)), 10)


def hybrid_search(spark, d, threshold: float = 0.7):
    """English documents alone are ranked by terms and by vectors; the two lists are fused, the best 20 of them scored anew
    where query and document have vectors, and those below the threshold dropped, unless that leaves a query nothing. A
    document without a second score keeps its place behind those that have one."""
    docs = table(spark, d, "documents").where("lang = 'en'")
    vectors = table(spark, d, "embeddings")
    english = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    fused = top_k(rrf(_lists(spark, d, docs, english).withColumn("weight", F.lit(0.5))), 20, name="fused_rank")
    again = with_vectors(fused, vectors, "left").withColumn("second", F.round(sigmoid(dot(F.col("qv"), F.col("dv"))), 6))
    passing = F.max((F.col("second") >= threshold).cast("int")).over(Window.partitionBy("query_id"))
    kept = again.withColumn("passing", F.coalesce(passing, F.lit(0))).where((F.col("passing") == 0) | (F.col("second") >= threshold))
    ranked = top_k(kept, 10, F.desc_nulls_last("second"), F.col("fused_rank"))
    return ranked.join(chunks(spark, d).select("doc_id", "source_type"), "doc_id").select("query_id", "doc_id", "score", "second", "rank", "source_type")


def with_vectors(hits: DataFrame, vectors: DataFrame, how: str = "inner") -> DataFrame:
    """hits with the vectors qv of the query and dv of the document."""
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return hits.join(q, "query_id", how).join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("dv")), "doc_id", how)


def dense_filtered(spark, d):
    english = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return _dense(spark, d, 10, table(spark, d, "embeddings").join(english, "vec_id", "left_semi"))


def dense_ivf(spark, d):
    """Approximate neighbours by an inverted file with product codes; see `ivf`. Recall against the exact form is tested."""
    from quarryloom.operators import ivf  # that module ranks with this one's functions

    vectors = table(spark, d, "embeddings")
    return ivf.search(query_vectors(spark, d), ivf.build(vectors), vectors, 10)


def rerank_scores(spark, d):
    """The inner product with the query vector stands for an outside model's score."""
    pairs = with_vectors(_dense(spark, d, 20), table(spark, d, "embeddings"))
    scored = pairs.select("query_id", "doc_id", F.col("score").alias("original_score"), F.round(sigmoid(dot(F.col("qv"), F.col("dv"))), 6).alias("score"))
    return top_k(scored, 10)


def rerank_threshold(spark, d, threshold: float = 0.7):
    scored = rerank_scores(spark, d)
    passing = F.sum((F.col("score") >= threshold).cast("int")).over(Window.partitionBy("query_id"))
    return scored.withColumn("passing", passing).where((F.col("passing") == 0) | (F.col("score") >= threshold)).drop("passing")


def mmr(hits: DataFrame, lam: float = 0.7, k: int = 10) -> DataFrame:
    """hits: query_id, doc_id, score, embedding; at most a few dozen per query. Greedy trade of relevance for diversity."""

    def pick(pdf):
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(pdf.embedding.to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        like, rel, chosen = v @ v.T, pdf.score.to_numpy(), []
        while len(chosen) < min(k, len(pdf)):
            worst = like[:, chosen].max(axis=1) if chosen else np.zeros(len(pdf))
            value = np.round(lam * rel - (1 - lam) * worst, 9)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        out = pdf.loc[chosen, ["query_id", "doc_id", "score"]]
        out["rank"] = np.arange(1, len(out) + 1)
        return out

    return hits.groupBy("query_id").applyInPandas(pick, "query_id long, doc_id long, score double, rank int")


def mmr_query(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return mmr(_dense(spark, d, 30).join(v, "doc_id").select("query_id", "doc_id", "score", "embedding"))


def multi_query_merge(spark, d):
    """Items of one block of four are sub-queries of one question; a document counts with its best score."""
    hits = _bm25(spark, d).withColumn("query_id", F.floor(F.col("query_id") / 4))
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), 10)


def resolve_parent(spark, d):
    hits = _bm25(spark, d).join(chunks(spark, d).select("doc_id", "parent_id"), "doc_id")
    first = top_k(hits, 1, F.col("rank"), group=["query_id", "parent_id"], name="n").drop("n")
    text = table(spark, d, "documents").select(F.col("doc_id").alias("parent_doc"), F.col("text").alias("parent_text"))
    return first.withColumn("parent_doc", F.col("parent_id") * 4).join(text, "parent_doc", "left").select("query_id", "doc_id", "parent_id", "rank", "parent_text")


def stored(spark, d, docs: DataFrame, change=None) -> DataFrame:
    """Terms of an index of `docs` that is written to the shared folder, changed there and read back."""
    path = new_path(spark, "bm25")
    bm25.create(docs, path)
    if change:
        change(path)
    return bm25.vocabulary(bm25.load(spark, path)).withColumn("idf", F.round("idf", 6))


def bm25_add(spark, d):
    """English documents are indexed; then the German ones and every English one with an even id are added."""
    docs = table(spark, d, "documents")
    return stored(spark, d, docs.where("lang = 'en'"), lambda path: bm25.add(docs.where("lang = 'de' OR (lang = 'en' AND doc_id % 2 = 0)"), path)).select("term", "df", "idf")


def bm25_remove(spark, d):
    gone = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return stored(spark, d, table(spark, d, "documents"), lambda path: bm25.remove(gone, path)).select("term", "df", "idf")


def _postings(spark, d) -> str:
    """The inverted index of the documents, as a folder: blocks of one language and of like lengths."""
    path = new_path(spark, "postings")
    blockmax.build(bm25.forward(table(spark, d, "documents"), carry=("lang",)), path, order=("lang", "dl"))
    return path


def bm25_stored_topk(spark, d):
    """The ten best documents of each item, from stored postings alone."""
    return blockmax.search(spark, queries_of(spark, d), _postings(spark, d), 10)[0]


def bm25_blocks_read(spark, d):
    """How many blocks of postings hold a term of each item, and how many of them its ten best documents take."""
    return blockmax.search(spark, queries_of(spark, d), _postings(spark, d), 10)[1]


#: Letters of the texts at hand, which hold no Chinese, as Chinese characters.
LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "的一是在不了有和人这中大为上个国我以要他时来用们生到"


def segment_runs(spark, d):
    """Texts as Chinese ones, letter by letter and without blanks, cut into words again: a sentence is a run, and the
    dictionary holds the words that the texts have three times or more, with their counts."""
    plain = F.regexp_replace(F.lower("text"), "[^a-z. ]", "")
    docs = table(spark, d, "documents").select("doc_id", plain.alias("text"))
    words = docs.select(F.explode(F.split("text", "[. ]+")).alias("w")).where("length(w) BETWEEN 2 AND 12").groupBy("w").agg(F.count("*").alias("freq")).where("freq >= 3")
    chinese = lambda c: F.translate(F.regexp_replace(c, " ", ""), LETTERS, CHARACTERS)
    cut = segment_texts(docs.select("doc_id", chinese(F.col("text")).alias("text")), words.select(chinese(F.col("w")).alias("word"), "freq"))
    joined = F.array_join(F.transform("runs", lambda x: F.array_join(x, " ")), "|")
    n_words = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + F.size(x))
    return cut.select("doc_id", F.size("runs").cast("long").alias("n_runs"), n_words.alias("n_words"), F.md5(joined.cast("binary")).alias("digest"))


def corpus_stats(spark, d):
    index = bm25.forward(table(spark, d, "documents"))
    size = index.agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avg_dl"), F.sum(F.size("terms")).alias("n_postings"))
    # One row each.
    return size.join(F.broadcast(index.select(F.explode("terms").alias("term")).distinct().agg(F.count("*").alias("n_terms"))))


QUERIES = {
    "tokenize": lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(terms(F.col("text")), " ").alias("terms")),
    "segment_runs": segment_runs,
    "term_stats": lambda s, d: bm25.forward(table(s, d, "documents")).where("dl > 0").select("doc_id", F.col("dl").alias("doc_length"), F.size("terms").cast("long").alias("unique_terms"), F.array_max("tfs").cast("long").alias("max_tf")),
    "corpus_stats": corpus_stats,
    "bm25_index": lambda s, d: stored(s, d, table(s, d, "documents")),
    "bm25_add": bm25_add,
    "bm25_remove": bm25_remove,
    "bm25_topk": lambda s, d: _bm25(s, d),
    "bm25_stored_topk": bm25_stored_topk,
    "bm25_blocks_read": bm25_blocks_read,
    "bm25_with_text": bm25_with_text,
    "dense_topk": lambda s, d: _dense(s, d),
    "dense_topk_ivf": dense_ivf,
    "dense_topk_lsh": dense_ivf,
    "dense_topk_filtered": dense_filtered,
    "rrf": rrf_query,
    "rrf_weighted": rrf_weighted,
    "interleave": lambda s, d: interleave(_lists(s, d)),
    "hybrid_search": hybrid_search,
    "rerank_scores": rerank_scores,
    "rerank_threshold": rerank_threshold,
    "mmr": mmr_query,
    "multi_query_merge": multi_query_merge,
    "resolve_parent": resolve_parent,
}
_TOP = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10"
_RERANK = """, sig AS (SELECT n.query_id, n.doc_id, n.score AS original_score, round(1 / (1 + exp(-greatest(-20.0, least(20.0, list_dot_product(q.v, e.v))))), 6) AS score
 FROM dense n JOIN unit q ON q.vec_id = n.query_id JOIN unit e ON e.vec_id = n.doc_id),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sig QUALIFY rank <= 10)"""
_INDEX = "SELECT df.term, df.df, round(ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5)), 6) AS idf FROM df, st"
ORACLE = {
    "tokenize": f"SELECT doc_id, array_to_string({TERMS_SQL}, ' ') AS terms FROM documents",
    "term_stats": f"WITH {TF_SQL} SELECT doc_id, sum(tf) AS doc_length, count(*) AS unique_terms, max(tf) AS max_tf FROM tf GROUP BY doc_id",
    "corpus_stats": f"WITH {TF_SQL} SELECT n_docs, round(avg_dl, 6) AS avg_dl, count(DISTINCT term) AS n_terms, count(*) AS n_postings FROM tf, st GROUP BY ALL",
    "bm25_index": f"WITH {TF_SQL} SELECT df.term, df.df, round(ln(1 + (n_docs - df.df + 0.5) / (df.df + 0.5)), 6) AS idf, cf, first_doc FROM df, st, (SELECT term, sum(tf) AS cf, min(doc_id) AS first_doc FROM tf GROUP BY term) c WHERE c.term = df.term",
    "bm25_add": f"WITH {TF_SQL.replace('FROM documents', "FROM documents WHERE lang IN ('en', 'de')")} {_INDEX}",
    "bm25_remove": f"WITH {TF_SQL.replace('FROM documents', 'FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)')} {_INDEX}",
    "bm25_topk": f"WITH {BM25_TOP_SQL.replace('@k', '10')} SELECT * FROM sparse",
    "bm25_stored_topk": f"WITH {BM25_TOP_SQL.replace('@k', '10')} SELECT * FROM sparse",
    "bm25_with_text": f"WITH {BM25_TOP_SQL.replace('@k', '10')} SELECT query_id, doc_id, score, rank, text FROM sparse JOIN documents USING (doc_id)",
    "dense_topk": f"WITH {DENSE_SQL.replace('@k', '10')} SELECT * FROM dense",
    "dense_topk_filtered": f"WITH {DENSE_SQL.replace('@k', '10')}, fused AS (SELECT * FROM dense_all WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')) {_TOP}",
    "rrf": f"WITH {LISTS_SQL}, fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL) {_TOP}",
    "rrf_weighted": f"WITH {LISTS_SQL}, fused AS (SELECT query_id, doc_id, round(sum(CASE list_no WHEN 0 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END / (60 + rank)), 9) AS score FROM lists GROUP BY ALL) {_TOP}",
    "interleave": f"WITH {LISTS_SQL}, f AS (SELECT query_id, doc_id, min(rank * 2 + list_no) AS place FROM lists GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank FROM f",
    "hybrid_search": f"""WITH {CHUNKS_SQL}, {LISTS_EN_SQL}, fused AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY ALL),
f20 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS fused_rank FROM fused QUALIFY fused_rank <= 20),
sc AS (SELECT f.*, CASE WHEN q.v IS NOT NULL AND e.v IS NOT NULL THEN round(1 / (1 + exp(-greatest(-20.0, least(20.0, list_dot_product(q.v, e.v))))), 6) END AS second FROM f20 f LEFT JOIN unit q ON q.vec_id = f.query_id LEFT JOIN unit e ON e.vec_id = f.doc_id),
kp AS (SELECT * FROM sc QUALIFY coalesce(max((second >= 0.7)::INT) OVER (PARTITION BY query_id), 0) = 0 OR second >= 0.7),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC NULLS LAST, fused_rank) AS rank FROM kp QUALIFY rank <= 10)
SELECT query_id, rk.doc_id, score, second, rank, source_type FROM rk JOIN chunks c ON c.doc_id = rk.doc_id""",
    "rerank_scores": f"WITH {DENSE_SQL.replace('@k', '20')}{_RERANK} SELECT query_id, doc_id, original_score, score, rank FROM reranked",
    "rerank_threshold": f"WITH {DENSE_SQL.replace('@k', '20')}{_RERANK} SELECT query_id, doc_id, original_score, score, rank FROM reranked QUALIFY score >= 0.7 OR count_if(score >= 0.7) OVER (PARTITION BY query_id) = 0",
    "multi_query_merge": f"WITH {BM25_TOP_SQL.replace('@k', '10')}, fused AS (SELECT query_id // 4 AS query_id, doc_id, max(score) AS score FROM sparse GROUP BY ALL) {_TOP}",
    "resolve_parent": f"WITH {BM25_TOP_SQL.replace('@k', '10')} SELECT query_id, s.doc_id, s.doc_id // 4 AS parent_id, rank, p.text AS parent_text FROM sparse s LEFT JOIN documents p ON p.doc_id = (s.doc_id // 4) * 4 QUALIFY row_number() OVER (PARTITION BY query_id, s.doc_id // 4 ORDER BY rank) = 1",
}
