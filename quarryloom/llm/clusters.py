"""k-means over integer vectors with zone maps along a space-filling curve.

Vectors are ordered along a Hilbert curve through all their dimensions and cut into blocks; each block is one saved row:
its vectors, the smallest box around them, and their number and sum. A round compares the box with the centroids first:
the distance from a centroid to the nearest point of the box bounds all its distances from below, that to the farthest
point from above, and a centroid nearer to no vector than another is to all of them is no candidate. A block with one
candidate is added to its sums without a look at its vectors; in the others all vectors are compared with the
candidates, exactly and vectorised. Only sums leave the tasks: clusters times dimensions numbers, added up by Spark.

Vectors with another number of components or with one that is null or not finite are left out, as are those with a
component of 2**17 or more in size, whose squared distances need not fit a long. Ties go to the smaller number, empty
clusters keep their centroid, fewer vectors than clusters give fewer clusters, and no vectors no rows. Repeated rows are
vectors like any other; a null id is kept and starts no cluster before others. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.llm.storage import saved, temporary
from quarryloom.sources.tables import table

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Vectors in a block, and bits a dimension gives to the place on the curve.
BLOCK, BITS = 512, 4
LARGEST = 1 << 17
#: Up to this size of components, sums of 64 squared differences are whole numbers that a double holds exactly.
EXACT_DOUBLE = 1 << 22


def scaled(vector: str, dimensions: int, scale: int) -> tuple[Column, Column]:
    """(whether a vector is kept, its components as integers)."""
    v = F.col(vector)
    fine = (F.size(v) == dimensions) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < LARGEST), F.lit(False)))
    return F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows x dimensions, each below 2**bits) along the Hilbert curve, as rows of bytes in ascending
    order. Skilling's transposed form: undo the turns of the subcubes from the coarsest bit on, then take the Gray code."""
    x = np.ascontiguousarray(cells.T.astype(np.uint8))
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, p = np.uint8(1 << level), np.uint8((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint8(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint8)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint8(1 << level)) != 0, np.uint8((1 << level) - 1), np.uint8(0))
    x ^= flip
    planes = np.concatenate([((x >> np.uint8(b)) & np.uint8(1)) for b in range(bits - 1, -1, -1)])
    return np.packbits(planes.T, axis=1)


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False).reshape(-1, dimensions)


def in_blocks(vectors: DataFrame, dimensions: int, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """Blocks of neighbours along the curve, from (id, v): ids, vectors (packed 32-bit integers), low and high corner,
    number and sum."""
    ends = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    low, width = (ends[0], ends[1] - ends[0] + 1) if ends[0] is not None else (0, 1)
    id_type = vectors.schema["id"].dataType

    def place(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"), dimensions)
                keys = curve_keys((v.astype(np.int64) - low) * (1 << bits) // width, bits)
                yield pa.RecordBatch.from_arrays([b.column("id"), packed(v), packed(keys)], ["id", "v", "key"])

    def cut(batches):
        ids, rows = [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            rows += b.column("v").to_pylist()
            while len(ids) >= block:
                yield one(ids[:block], rows[:block])
                ids, rows = ids[block:], rows[block:]
        if ids:
            yield one(ids, rows)

    def one(ids, rows):
        v = np.frombuffer(b"".join(rows), np.int32).reshape(-1, dimensions).astype(np.int64)
        return pa.RecordBatch.from_pylist([{"ids": ids, "v": b"".join(rows), "low": v.min(0).tolist(), "high": v.max(0).tolist(), "n": len(ids), "total": v.sum(0).tolist()}], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    placed = vectors.mapInArrow(place, T.StructType([T.StructField("id", id_type), T.StructField("v", T.BinaryType()), T.StructField("key", T.BinaryType())]))
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("v", T.BinaryType()), T.StructField("low", longs), T.StructField("high", longs), T.StructField("n", T.LongType()), T.StructField("total", longs)])
    arrow = to_arrow_schema(schema)
    # The vector's bytes and the id are in the order as well: equal keys, however many, are split over partitions.
    return placed.repartitionByRange("key", "v", "id").sortWithinPartitions("key", "v", "id").select("id", "v").mapInArrow(cut, schema)


def packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of the box, ascending."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids."""
    if max(np.abs(v).max(), np.abs(centroids).max()) < EXACT_DOUBLE:
        a, b = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], axis=1)


def sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, component sums)} of one assignment of all blocks."""
    k, dims = centroids.shape

    def add(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for v, low, high, n, whole in zip(b.column("v"), matrix64(b, "low"), matrix64(b, "high"), b.column("n").to_pylist(), matrix64(b, "total"), strict=True):
                near = candidates(low, high, centroids)
                if len(near) == 1:
                    count[near[0]] += n
                    total[near[0]] += whole
                else:
                    rows = np.frombuffer(v.as_buffer(), np.int32).reshape(-1, dims).astype(np.int64)
                    nearest = near[distances(rows, centroids[near]).argmin(1)]
                    count += np.bincount(nearest, minlength=k)
                    for c in near:
                        total[c] += rows[nearest == c].sum(0)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, dims)), pa.array(np.tile(np.arange(dims), len(full))), pa.array(np.repeat(count[full], dims)), pa.array(total[full].ravel())], ["cluster", "dimension", "n", "total"])

    out: dict[int, tuple[int, list[int]]] = {}
    found = blocks.drop("ids").mapInArrow(add, "cluster long, dimension long, n long, total long").groupBy("cluster", "dimension").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sorted(found.collect(), key=lambda r: (r.cluster, r.dimension)):
        out.setdefault(r.cluster, (r.n, []))[1].append(r.total)
    return out


def matrix64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    dims, ids = centroids.shape[1], blocks.schema["ids"].dataType.elementType

    def assign(batches):
        for b in batches:
            for v, of, low, high in zip(b.column("v"), b.column("ids"), matrix64(b, "low"), matrix64(b, "high"), strict=True):
                near = candidates(low, high, centroids)
                d = distances(np.frombuffer(v.as_buffer(), np.int32).reshape(-1, dims).astype(np.int64), centroids[near])
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays([of.values, pa.array(near[best].astype(np.int32)), pa.array(d[np.arange(len(d)), best])], ["id", "cluster", "distance"])

    return blocks.select("v", "ids", "low", "high").mapInArrow(assign, T.StructType([T.StructField("id", ids), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def cluster(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance) of every kept vector, final centroids). Vectors with the smallest SHA-256 of seed and id
    start; `rounds` times all are assigned and every centroid moved to the floor of its vectors' mean, then all are
    assigned once more. Rounds that would change nothing are not run."""
    fine, ints = scaled(vector, dimensions, scale)
    vectors = df.where(fine).select(F.col(id).alias("id"), ints.alias("v"))
    with temporary(df.sparkSession) as keep:
        first = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(clusters).select("v").collect()
        centroids = np.array([r.v for r in first], np.int64).reshape(-1, dimensions)
        blocks = saved(in_blocks(vectors, dimensions), "vector-blocks")
        for _ in range(rounds if len(centroids) else 0):
            moved = centroids.copy()
            for c, (n, total) in sums(blocks, centroids).items():
                moved[c] = [t // n for t in total]
            if (moved == centroids).all():
                break
            centroids = moved
        if not len(centroids):
            return keep(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), "assigned"), centroids
        return keep(assigned(blocks, centroids), "assigned"), centroids


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every embedding of 64 components, with the sums over clusters and over all."""
    out, centroids = cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    per = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    digests = [(c, fits(s), fits(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    named = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds one after the other, over components in rows."""
    parts = [
        f"x AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e) AND abs(e) < {LARGEST})) = {DIMENSIONS})",
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS v FROM x)",
        "q AS MATERIALIZED (SELECT r, unnest(v) AS e, generate_subscripts(v, 1) AS d FROM v)",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), v) - 1 AS c FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, d, e FROM s JOIN q ON q.r = s.r WHERE c < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, c, y FROM (SELECT r, c, y, row_number() OVER (PARTITION BY r ORDER BY y, c) AS i FROM (SELECT q.r, z.c, sum((q.e - z.e) * (q.e - z.e))::BIGINT AS y FROM q JOIN c{k} z ON z.d = q.d GROUP BY q.r, z.c)) WHERE i = 1)")
        if k < ROUNDS:
            parts.append(f"m{k} AS (SELECT c, d, sum(e)::BIGINT AS t, count(*) AS n FROM q JOIN a{k} a ON a.r = q.r GROUP BY c, d)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, o.d, CASE WHEN n IS NULL THEN o.e ELSE (t - ((t % n) + n) % n) // n END AS e FROM c{k} o LEFT JOIN m{k} m ON m.c = o.c AND m.d = o.d)")
    return "WITH " + ",\n".join(parts) + f"""
, h AS (SELECT c, sha256(string_agg(e::VARCHAR, ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS "cluster", a.y AS distance, sum(a.y) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.y) OVER ()::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.r = a.r JOIN h ON h.c = a.c"""


ORACLE = _oracle()
