"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted documents and the whole corpus.

Every word is hashed whole (CRC-32 of its bytes); one- and two-word n-grams fall into `buckets` each. The raw multinomial
counts every n-gram of every document; the target multinomial those of documents labelled as good, at most
`trusted_documents` of them (in order of a hash of the id), which bounds what is broadcast; `prior` n-grams a bucket, shared
out as in the raw counts, smooth it, so that few trusted documents give mild scores. The score of a document is the mean
of log target/raw probability over its n-grams, to four decimals, and a document stays if it passes the base rules and its
score is at least `threshold`. The threshold was chosen on held-out labels (figures in the README). Everything is a
DataFrame expression inside one scan per pass; no text is shuffled. The model, two arrays of fixed length, passes through
the driver.

Null texts have no words and fail the base rules, as empty ones do. Without trusted documents every score is 0, so the base
rules decide alone. Rows stay as they are; repeated rows are judged alike. Columns named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.sources.tables import table

BUCKETS, TRUSTED_DOCUMENTS, THRESHOLD, PRIOR = 16384, 20_000, -0.06, 20.0
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
_SPACES, _SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    for c in _SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def occurrences(text: Column, characters: str) -> Column:
    """Number of the given ASCII characters in a text."""
    out = F.lit(0)
    for c in characters:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out.cast("long")


def hashed(w: Column) -> Column:
    """The CRC-32 of each word."""
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def grams(code: Column, buckets: int) -> Column:
    """Buckets of the n-grams of a text: those of single words, then those of two words."""
    one = F.transform(code, lambda x: F.pmod(x, F.lit(buckets)))
    two = F.transform(F.slice(code, 1, F.greatest(F.size(code) - 1, F.lit(0))), lambda x, i: buckets + F.pmod(x * 31 + F.get(code, i + 1), F.lit(buckets)))
    return F.concat(one, two)


def repeated_words(w: Column, n: int = 5) -> Column:
    """Words inside n-word windows that stand twice or more in the text."""
    at = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
    windows = F.transform(at, lambda _, i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"]))
        spread = lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(n), x - a["last"])).alias("n"), x.alias("last")))["n"]
        return let(ordered, lambda s: let(again(s), spread))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def model(docs: DataFrame, trusted: DataFrame, *, doc_id: str, text: str, buckets: int, trusted_documents: int, prior: float) -> list[float]:
    """Log ratios by bucket. trusted: one column of ids."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id IS NOT NULL").distinct().orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(trusted_documents)
    coded = docs.select(F.col(doc_id).alias("_id"), hashed(words(F.coalesce(F.col(text), F.lit("")))).alias("code"))
    flagged = coded.join(F.broadcast(ids.withColumn("good", F.lit(1))), "_id", "left")
    counts = flagged.select("good", F.explode(let(F.col("code"), lambda c: grams(c, buckets))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good")).collect()
    raw, good = ({r["b"]: r[k] for r in counts} for k in ("raw", "good"))
    out = []
    for half in (range(buckets), range(buckets, 2 * buckets)):
        r_sum, t_sum = (sum(x.get(b, 0) for b in half) for x in (raw, good))
        for b in half:
            r = (raw.get(b, 0) + 1) / (r_sum + buckets)
            out.append(round(math.log((good.get(b, 0) + prior * r * buckets) / (t_sum + prior * buckets) / r), 6) if t_sum else 0.0)
    return out


def judge(docs: DataFrame, trusted: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, trusted_documents: int = TRUSTED_DOCUMENTS, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """docs with the counts, base_failed, score and kept."""
    weights = model(docs, trusted, doc_id=doc_id, text=text, buckets=buckets, trusted_documents=trusted_documents, prior=prior)
    weight = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)

    def total(codes: Column) -> Column:
        return let(grams(codes, buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(weight, b)) / F.size(g)).otherwise(0.0))

    found = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"), let(hashed(w), total).alias("score")))
    base = docs.drop(*RESULTS)
    out = base.withColumn("_q", found)
    out = out.withColumns({
        "n_words": F.col("_q.n_words"),
        "word_chars": (F.length(t) - occurrences(t, _SPACES)).cast("long"),
        "n_symbols": occurrences(t, _SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_q.n_repeat_words"),
        "score": F.round("_q.score", 4),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).select(*base.columns, *RESULTS)


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of every document; the target are the documents labelled quality 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, trusted_ids(spark, sf_dir)).drop("text")


#: CRC-32 has no function in the SQL that this is compared with: a table of 256 values, made by its rule, and a fold over bytes.
ORACLE = f"""
WITH tb AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
h AS (SELECT w, list_transform(range(strlen(w)), lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT) AS bs FROM (SELECT DISTINCT w FROM w)),
vocab AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS code FROM h, tb),
c AS (SELECT doc_id, i, code, w.w FROM w JOIN vocab ON vocab.w = w.w),
n AS (SELECT *, lead(code) OVER o AS code2, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o || chr(1) || lead(w, 4) OVER o AS five FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, code % {BUCKETS} AS b FROM n UNION ALL SELECT doc_id, {BUCKETS} + (code * 31 + code2) % {BUCKETS} FROM n WHERE code2 IS NOT NULL),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {TRUSTED_DOCUMENTS}),
k AS (SELECT b, count(*) AS r, count(x.doc_id) AS t FROM g LEFT JOIN good x ON x.doc_id = g.doc_id GROUP BY b),
s AS (SELECT b >= {BUCKETS} AS h, sum(r) AS rs, sum(t) AS ts FROM k GROUP BY 1),
p AS (SELECT b, t, ts, (r + 1) / (rs + {BUCKETS}) AS q FROM k JOIN s ON s.h = (k.b >= {BUCKETS})),
m AS (SELECT b, CASE WHEN ts > 0 THEN round(ln((t + {PRIOR} * q * {BUCKETS}) / (ts + {PRIOR} * {BUCKETS}) / q), 6) ELSE 0 END AS v FROM p),
sc AS (SELECT doc_id, avg(v) AS score FROM g JOIN m ON m.b = g.b GROUP BY doc_id),
rp AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS f FROM n WHERE five IS NOT NULL), (VALUES (0), (1), (2), (3), (4)) v(j) WHERE f > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
a AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, round(coalesce(score, 0), 4) AS score
  FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN rp ON rp.doc_id = d.doc_id LEFT JOIN sc ON sc.doc_id = d.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score >= {THRESHOLD} AS kept FROM a
"""
