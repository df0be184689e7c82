"""A cache of answers looked up as of each request's own time: the exact question first, else the most similar one.

An entry counts for a request if it was stored before it, at most `ttl` seconds before, in the same collection (a request
without a collection takes any). The same question, white space and case aside, in the same collection is an exact hit: the
entry stored last. Else the entry with the greatest cosine is the hit, if that is `least` or more; of equal ones the newest.

Exact hits come from one sort: entries and requests stand together in buckets of `ttl` seconds, an entry also in the next
one, and each request takes the last entry before it there, so no entry is paired with every request of its question.
Similar ones come from blocks of requests of bounded size that go to every task: entries are dealt out by time, so the
few requests whose time fits those of a task's slice are found by bisection, and only these are compared with it.

Null times never match, null questions are empty ones, vectors without components are like nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.sources.shared import saved, temporary
from quarryloom.sources.tables import table

#: How like a question has to be to one that was answered before, as a cosine, and how long answers last.
SIMILARITY, TTL_SECONDS = 0.92, 3600
#: Bytes of request vectors that go to the tasks at once, and entries that are compared with them at once.
REQUEST_BYTES, SLICE = 16 << 20, 512


def keyed(rows: DataFrame) -> DataFrame:
    """rows with `key`: collection and question, white space made one blank, in lower case; and `us`, microseconds."""
    question = F.lower(F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"\s+", " ")))
    return rows.withColumns({"key": F.concat(F.coalesce("collection", F.lit("")), F.lit("::"), question), "us": F.unix_micros("at")})


def exact(requests: DataFrame, entries: DataFrame, ttl: int) -> DataFrame:
    """(request_id, entry): the entry of the same key that was stored last before each request."""
    long = ttl * 1_000_000
    bucket = F.floor(F.col("us") / long)
    stored = entries.select("key", "us", F.lit(0).alias("asks"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.struct("us", "entry_id").alias("e"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    asked = requests.select("key", "us", F.lit(1).alias("asks"), "request_id", F.lit(None).cast(stored.schema["e"].dataType).alias("e"), bucket.alias("bucket"))
    before = Window.partitionBy("key", "bucket").orderBy("us", "asks", F.desc(F.coalesce("e.entry_id", F.lit(0))))
    found = stored.unionByName(asked).withColumn("last", F.last("e", ignorenulls=True).over(before)).where("asks = 1")
    return found.where(F.col("us") - F.col("last.us") <= long).select("request_id", F.col("last.entry_id").alias("entry"))


def _similar(shared, ttl: int, least: float):
    def run(batches):
        ids, at, q, collection = shared.value  # ascending by time
        long, n = ttl * 1_000_000, len(ids)
        best, best_at, best_id = np.full(n, -2.0), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, SLICE):
                b = whole.slice(low, SLICE)
                us, entry = np.asarray(b.column("us")), np.asarray(b.column("entry_id"))
                order = np.lexsort((entry, -us))  # the newest first, so that the first of equal scores is the hit
                first, stop = np.searchsorted(at, us.min(), "left"), np.searchsorted(at, us.max() + long, "right")
                if first == stop:
                    continue
                v = np.asarray(b.column("embedding").flatten(), dtype=float).reshape(len(us), -1)[order]
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                us, entry = us[order], entry[order]
                of = np.array(b.column("collection").to_pylist(), dtype=object)[order]
                age = at[first:stop][None, :] - us[:, None]
                wanted = collection[first:stop]
                fits = (age >= 0) & (age <= long) & ((of[:, None] == wanted[None, :]) | (wanted == "")[None, :])
                score = np.where(fits, np.round(v @ q[first:stop].T, 6), -2.0)
                row = score.argmax(0)
                top = score[row, np.arange(stop - first)]
                held = slice(first, stop)
                better = (top > best[held]) | ((top == best[held]) & ((us[row] > best_at[held]) | ((us[row] == best_at[held]) & (entry[row] < best_id[held]))))
                for target, new in ((best, top), (best_at, us[row]), (best_id, entry[row])):
                    target[held] = np.where(better, new, target[held])
        some = np.flatnonzero(best >= least)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(best_id[some]), pa.array(best[some]), pa.array(best_at[some])], ["request_id", "entry", "score", "us"])

    return run


def similar(requests: DataFrame, entries: DataFrame, ttl: int, least: float) -> DataFrame:
    """(request_id, entry, score): the most similar entry of each request. Both have vectors of one width."""
    spark = requests.sparkSession
    asked = requests.where("us IS NOT NULL AND size(embedding) > 0").select("request_id", "us", "embedding", F.coalesce("collection", F.lit("")).alias("collection"))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    blocks = max(1, -(-n * width * 8 // REQUEST_BYTES))
    held = entries.where("us IS NOT NULL AND size(embedding) > 0").select("entry_id", "us", "embedding", F.coalesce("collection", F.lit("")).alias("collection"))
    held = held.repartitionByRange("us", "entry_id").sortWithinPartitions("us")
    out = None
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == i).toPandas().sort_values("us", kind="stable")
        q = np.array(block.embedding.tolist(), float).reshape(len(block), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((block.request_id.to_numpy(np.int64), block.us.to_numpy(np.int64), q, block.collection.to_numpy(object)))
        found = held.mapInArrow(_similar(shared, ttl, least), "request_id long, entry long, score double, us long")
        out = found if out is None else out.unionByName(found)
    first = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), F.desc("us"), "entry"))
    return out.withColumn("n", first).where("n = 1").select("request_id", "entry", "score")


def lookup(requests: DataFrame, entries: DataFrame, *, ttl: int = TTL_SECONDS, least: float = SIMILARITY) -> DataFrame:
    """(request_id, entry, how, score): the cached entry of each request; how is exact, similar or miss. requests:
    request_id, at, collection, query, embedding; entries: entry_id and the same. Ids are whole numbers."""
    requests, entries = keyed(requests), keyed(entries)
    with temporary(requests.sparkSession) as keep:
        same = saved(exact(requests.where("us IS NOT NULL"), entries.where("us IS NOT NULL"), ttl), "exact")
        rest = requests.join(same.select("request_id"), "request_id", "left_anti")
        found = same.select("request_id", "entry", F.lit("exact").alias("how"), F.lit(1.0).alias("score"))
        found = found.unionByName(similar(rest, entries, ttl, least).select("request_id", "entry", F.lit("similar").alias("how"), "score"))
        return keep(requests.select("request_id").join(found, "request_id", "left").withColumn("how", F.coalesce("how", F.lit("miss"))), "lookup")


# --- the query -------------------------------------------------------------------------------------------------------

#: Vectors that questions are about, ways to put one, and how far its vector moves with the way.
QUESTIONS, WAYS, MOVE = 10, 4, 0.03


def asked_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event puts one of ten questions, each in one of four ways, which move its vector a little; one in 20 is a request,
    the others are stored answers. Case and blanks change with the event."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") % QUESTIONS).cast("long").alias("question"), F.pmod("user_id", F.lit(WAYS)).cast("long").alias("way"))
    v = table(spark, d, "embeddings").where(F.col("vec_id") < QUESTIONS).select(F.col("vec_id").alias("question"), F.col("embedding").alias("v"))
    text = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("What IS  ")).otherwise(F.lit("what is ")), F.col("question").cast("string"), F.lit(" by "), F.col("way").cast("string"))
    moved = F.transform("v", lambda x, i: x.cast("double") + (F.pmod(i.cast("long") * (F.col("way") + 3), F.lit(7)) - 3) * MOVE)
    # Ten vectors, whatever the table holds.
    return e.join(F.broadcast(v), "question").select("event_id", "at", F.when(F.col("question") % 2 == 0, "even").otherwise("odd").alias("collection"), text.alias("query"), moved.alias("embedding"))


def asof_cache(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth event asks; a third of the requests name no collection."""
    e = asked_events(spark, d)
    requests = e.where("event_id % 20 = 0").withColumnRenamed("event_id", "request_id").withColumn("collection", F.when(F.col("request_id") % 3 != 0, F.col("collection")))
    return lookup(requests, e.where("event_id % 20 <> 0").withColumnRenamed("event_id", "entry_id"))


QUERIES = {"cache_asof_lookup": asof_cache}
ORACLE = {
    "cache_asof_lookup": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < {QUESTIONS}),
w AS (SELECT vec_id AS question, way, list_transform(v, lambda x, i: x + (((i - 1) * (way + 3)) % 7 - 3) * {MOVE}::DOUBLE) AS m FROM v, (SELECT unnest(range({WAYS})) AS way)),
e AS (SELECT event_id, ts, floor(value % {QUESTIONS})::BIGINT AS question, user_id % {WAYS} AS way, CASE WHEN floor(value % {QUESTIONS})::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS c FROM events),
k AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN c END AS rc FROM e WHERE event_id % 20 = 0), s AS (SELECT * FROM e WHERE event_id % 20 <> 0),
p AS (SELECT k.event_id AS request_id, s.event_id AS entry, s.ts AS stored, k.question = s.question AND k.way = s.way AND k.rc IS NOT DISTINCT FROM s.c AS same, round(list_cosine_similarity(a.m, b.m), 6) AS score
  FROM k JOIN s ON s.ts <= k.ts AND s.ts >= k.ts - INTERVAL {TTL_SECONDS} SECOND AND (k.rc IS NULL OR k.rc = s.c) JOIN w a ON a.question = k.question AND a.way = k.way JOIN w b ON b.question = s.question AND b.way = s.way),
x AS (SELECT * FROM p WHERE same OR score >= {SIMILARITY} QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY same DESC, CASE WHEN same THEN 1 ELSE score END DESC, stored DESC, entry) = 1)
SELECT k.event_id AS request_id, entry, CASE WHEN entry IS NULL THEN 'miss' WHEN same THEN 'exact' ELSE 'similar' END AS how, CASE WHEN same THEN 1 ELSE score END::DOUBLE AS score FROM k LEFT JOIN x ON x.request_id = k.event_id""",
}
