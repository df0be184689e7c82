"""64-bit fingerprints of texts, pairs that are near in Hamming distance, and what of each group stays."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.functions.graph import components
from quarryloom.functions.tokens import WORD
from quarryloom.operators.retrieval import _bm25
from quarryloom.sources.shared import saved, sorted_in, temporary
from quarryloom.sources.tables import table

NEAR, NEAR_IN_RESULTS = 3, 8
#: Where the blocks of bits of a print begin in either half, and how long they are.
BLOCKS = [("hi", 0, 11), ("hi", 11, 11), ("hi", 22, 10), ("lo", 0, 11), ("lo", 11, 11), ("lo", 22, 10)]


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, hi, lo): for each of 64 bits the sign of the summed weights of the words whose md5 has it; weights are
    counts. Kept as two halves of 32 bits, as the whole exceeds a signed number. A document's words never leave its row:
    each batch sums the signs of its different words, with one digest a word."""

    def run(batches):
        known: dict[str, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                b = whole.slice(low, 256)
                found = b.column("_w")
                flat, n = found.flatten().dictionary_encode(), np.diff(np.asarray(found.offsets))
                if len(known) > 1 << 18:
                    known.clear()
                words = flat.dictionary.to_pylist()
                for w in words:
                    if w not in known:
                        known[w] = np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest()[8:], np.uint8)).astype(np.int8) * 2 - 1
                signs = np.stack([known[w] for w in words]) if words else np.zeros((1, 64), np.int8)
                kinds = len(signs)
                key, count = np.unique(np.repeat(np.arange(len(n)), n) * kinds + np.asarray(flat.indices, dtype=np.int64), return_counts=True)
                total = np.zeros((len(n), 64), np.int64)
                if len(key):
                    row = key // kinds
                    first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
                    for at in range(0, len(first), 32):  # the signs of so many documents are spread out at once
                        end = first[at + 32] if at + 32 < len(first) else len(key)
                        part = slice(first[at], end)
                        total[row[first[at : at + 32]]] = np.add.reduceat(signs[key[part] % kinds] * count[part, None], first[at : at + 32] - first[at])
                halves = [(total[:, k : k + 32] > 0) @ (1 << np.arange(31, -1, -1)) for k in (0, 32)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, halves)], ["doc_id", "hi", "lo"])

    words = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    return docs.select("doc_id", words.alias("_w")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("hi long, lo long").fields]))


def hamming(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def near_pairs(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b, distance) of prints at most `near` bits apart. Equal prints are collapsed before the join, so a large group of
    copies meets once; the pairs are of the smallest ids of the prints. Of six blocks of bits, `near` different bits leave
    all but `near` blocks equal, so every choice of that many blocks is a key of 31 bits or more, if near is 3: no pair is
    missed, and unlike prints seldom meet."""
    if not 0 <= near < len(BLOCKS):
        raise ValueError(f"near is less than {len(BLOCKS)}")
    kinds = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"))
    block = [F.shiftrightunsigned(F.col(c), at).bitwiseAND(F.lit((1 << n) - 1)) for c, at, n in BLOCKS]

    def key(chosen: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for k in chosen:
            out = F.shiftleft(out, BLOCKS[k][2]).bitwiseOR(block[k])
        return out

    keys = F.array(*[F.struct(F.lit(i).alias("i"), key(c).alias("v")) for i, c in enumerate(combinations(range(len(BLOCKS)), len(BLOCKS) - near))])
    keyed = kinds.select("doc_id", "hi", "lo", F.explode(keys).alias("key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    d = hamming((F.col("a.hi"), F.col("a.lo")), (F.col("b.hi"), F.col("b.lo")))
    return a.join(sorted_in(b), (F.col("a.key") == F.col("b.key")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), d.cast("int").alias("distance")).where(F.col("distance") <= near).distinct()


def group_near(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, kept): the smallest id of each group of prints that near pairs connect stays."""
    with temporary(prints.sparkSession) as keep:
        prints = keep(prints, "prints")  # pairs, kinds and the result read them again
        label = keep(components(near_pairs(prints, near).select("a", "b"), saved), "components")
    kinds = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"))
    named = kinds.join(sorted_in(label), "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("label"))
    return prints.join(sorted_in(named), ["hi", "lo"]).select("doc_id", (F.col("doc_id") == F.col("label")).alias("kept"))


def _alternate(edges: DataFrame, heads: DataFrame) -> tuple[DataFrame, int]:
    """(id, kept) of the nodes that a row of single smaller neighbours ties to a head, whatever its length, and the number
    of doublings: node by node such a row stays and goes in turn, so each pointer carries the parity of its way."""
    single = edges.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1")
    way = saved(single.select(F.col("b").alias("id"), F.col("a").alias("to"), F.lit(1).alias("odd")), "ways")
    doublings, before = 0, None
    while True:
        now = tuple(way.agg(F.count("*"), F.sum(F.xxhash64("to", "odd").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, doublings = now, doublings + 1
        ahead = way.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("odd").alias("more"))
        way = saved(way.join(sorted_in(ahead), "to", "left").select("id", F.coalesce("further", "to").alias("to"), F.col("odd").bitwiseXOR(F.coalesce("more", F.lit(0))).alias("odd")), "ways")
    return way.join(sorted_in(heads.select(F.col("id").alias("to"))), "to").select("id", (F.col("odd") == 0).alias("kept")), doublings


def first_kept(edges: DataFrame) -> tuple[DataFrame, int]:
    """(dropped ids, rounds): what a pass over all ids in ascending order drops that keeps an id unless a kept one is its
    neighbour in `edges` (a, b): the first maximal independent set in that order.

    A node without smaller neighbours that are undecided stays, and its neighbours go; such rounds are repeated until every
    edge is decided. Nodes with a single smaller neighbour are settled with it in the same round, by pointer doubling, so
    that a long row of near copies costs a logarithm of its length. Only edges with two undecided ends are carried on, and
    each round is saved. `dropped` and the edges between rounds are tables; only counts come to the driver."""
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    dropped, rounds = None, 0
    while not edges.isEmpty():
        rounds += 1
        heads = edges.select(F.col("a").alias("id")).distinct().join(sorted_in(edges.select(F.col("b").alias("id"))), "id", "left_anti")
        heads = saved(heads, "heads")
        along, _ = _alternate(edges, heads)
        kept = saved(heads.unionByName(along.where("kept").select("id")), "kept")
        gone = saved(edges.join(sorted_in(kept.select(F.col("id").alias("a"))), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        decided = kept.unionByName(gone)
        edges = edges.join(sorted_in(decided.select(F.col("id").alias("a"))), "a", "left_anti").join(sorted_in(decided.select(F.col("id").alias("b"))), "b", "left_anti")
        edges = saved(edges, "edges")
    return (edges.select(F.col("a").alias("id")) if dropped is None else dropped), rounds


def keep_first(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, kept): in order of ids, a document stays unless one that stayed is at most `near` bits away. So, unlike in
    `group_near`, a near copy of a dropped document stays if nothing else that stayed is near it. Equal prints are one
    node: their first document stands for all."""
    with temporary(prints.sparkSession) as keep:
        prints = keep(prints, "prints")  # pairs, kinds and the result read them again
        dropped = keep(first_kept(near_pairs(prints, near))[0], "dropped")
    kinds = prints.groupBy("hi", "lo").agg(F.min("doc_id").alias("id"))
    named = kinds.join(sorted_in(dropped.withColumn("gone", F.lit(True))), "id", "left").select("hi", "lo", F.when(F.col("gone").isNull(), F.col("id")).alias("stays"))
    return prints.join(sorted_in(named), ["hi", "lo"]).select("doc_id", F.coalesce(F.col("doc_id") == F.col("stays"), F.lit(False)).alias("kept"))


def post_dedup(results: DataFrame, near: int = NEAR_IN_RESULTS) -> DataFrame:
    """results: query_id, doc_id, rank, hi, lo; at most a few dozen rows per query. In order of rank, a row stays if it is
    more than `near` bits from all that stayed."""

    def run(pdf):
        pdf = pdf.sort_values("rank")
        held, keep = [], []
        for h, low in zip(pdf.hi, pdf.lo, strict=True):
            ok = all(int(h ^ x).bit_count() + int(low ^ y).bit_count() > near for x, y in held)
            keep.append(ok)
            if ok:
                held.append((h, low))
        return pdf.assign(kept=keep)[["query_id", "doc_id", "rank", "kept"]]

    return results.groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int, kept boolean")


def _docs(s, d):
    return table(s, d, "documents")


QUERIES = {
    "simhash": lambda s, d: simhash(_docs(s, d)),
    "dedup_lsh_pairs": lambda s, d: near_pairs(simhash(_docs(s, d))),
    "dedup_lsh": lambda s, d: group_near(simhash(_docs(s, d))),
    "dedup_first_kept": lambda s, d: keep_first(simhash(_docs(s, d))),
    "post_dedup": lambda s, d: post_dedup(_bm25(s, d, 30).join(simhash(_docs(s, d)), "doc_id").select("query_id", "doc_id", "rank", "hi", "lo")),
    "exact_dedup": lambda s, d: _docs(s, d).groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")),
}


def _hamming_by_language(s, d):
    """Distance of each document's print to that of the smallest id in its source and language."""
    p = simhash(_docs(s, d)).join(_docs(s, d).select("doc_id", "source", "lang"), "doc_id")
    first = p.groupBy("source", "lang").agg(F.min(F.struct("doc_id", "hi", "lo")).alias("f"))
    return p.join(first, ["source", "lang"]).select("doc_id", hamming((F.col("hi"), F.col("lo")), (F.col("f.hi"), F.col("f.lo"))).cast("int").alias("distance"))


QUERIES["hamming"] = _hamming_by_language
_HALF = "('0x' || substr(md5(w), {0}, 8))::BIGINT"
_BITS = "(" + " + ".join(f"CASE WHEN sum(CASE WHEN {{0}} & {1 << b} <> 0 THEN n ELSE -n END) > 0 THEN {1 << b} ELSE 0 END" for b in range(32)) + ")::BIGINT"
_SIM = f"""tfw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents) GROUP BY ALL),
hv AS (SELECT doc_id, n, {_HALF.format(17)} AS h, {_HALF.format(25)} AS l FROM tfw),
sim AS (SELECT d.doc_id, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM documents d LEFT JOIN (SELECT doc_id, {_BITS.format('h')} AS hi, {_BITS.format('l')} AS lo FROM hv GROUP BY doc_id) s ON s.doc_id = d.doc_id)"""
ORACLE = {
    "simhash": f"WITH {_SIM} SELECT * FROM sim",
    "hamming": f"WITH {_SIM}, p AS (SELECT s.*, source, lang FROM sim s JOIN documents d ON d.doc_id = s.doc_id), f AS (SELECT source, lang, min_by(hi, doc_id) AS h, min_by(lo, doc_id) AS l FROM p GROUP BY ALL) SELECT doc_id, (bit_count(xor(hi, h)) + bit_count(xor(lo, l)))::INT AS distance FROM p JOIN f ON f.source = p.source AND f.lang = p.lang",
    "dedup_lsh_pairs": f"WITH {_SIM}, k AS (SELECT hi, lo, min(doc_id) AS doc_id FROM sim GROUP BY ALL), p AS (SELECT a.doc_id AS a, b.doc_id AS b, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance FROM k a JOIN k b ON a.doc_id < b.doc_id) SELECT * FROM p WHERE distance <= 3",
    "dedup_lsh": f"WITH RECURSIVE {_SIM}, k AS (SELECT hi, lo, min(doc_id) AS doc_id FROM sim GROUP BY ALL), e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.doc_id <> b.doc_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3), r AS (SELECT doc_id AS a, doc_id AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), g AS (SELECT a, min(b) AS label FROM r GROUP BY a) SELECT s.doc_id, s.doc_id = label AS kept FROM sim s JOIN k ON k.hi = s.hi AND k.lo = s.lo JOIN g ON g.a = k.doc_id",
    "dedup_first_kept": f"""WITH RECURSIVE {_SIM}, k AS (SELECT hi, lo, min(doc_id) AS id FROM sim GROUP BY ALL), e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS n, (SELECT list(a) FROM e WHERE b = id) AS smaller FROM k WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)),
r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept UNION ALL SELECT o.n, CASE WHEN list_has_any(kept, coalesce(smaller, [])) THEN kept ELSE list_append(kept, o.id) END FROM r JOIN o ON o.n = r.n + 1),
f AS (SELECT kept FROM r ORDER BY n DESC LIMIT 1)
SELECT s.doc_id, s.doc_id = k.id AND (k.id NOT IN (SELECT id FROM o) OR list_contains(kept, k.id)) AS kept FROM sim s JOIN k ON k.hi = s.hi AND k.lo = s.lo, f""",
    "exact_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
}
