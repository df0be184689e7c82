"""Keeping chunk stores: scans, manifests, upserts, lookups, deletion and counts. Upserts and deletions change stores on
disk, partition by partition; see `sources.partitioned`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators import bm25
from quarryloom.operators.chunking import IMAGES_SQL, image_marks, images, split_window
from quarryloom.operators.retrieval import TERMS_SQL
from quarryloom.sources import partitioned
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table
from quarryloom.streaming.runs import folder

QUESTION_WORDS = "题|习题|exercise|exam|quiz|test|题库|练习"


def infer_source_type(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.when(stem.rlike(QUESTION_WORDS), "question_bank").when(name.endswith(".pptx"), "slide").otherwise("textbook")


def infer_source_from_metadata(source_type: Column, *labels: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *labels))
    return F.when(F.lower(F.trim(source_type)).isin("question_bank", "slide", "textbook"), F.lower(F.trim(source_type))).when(text.rlike("习题|question|quiz|exam|题库"), "question_bank").when(text.rlike(r"\.pptx?|slide|lecture|课件"), "slide").otherwise("textbook")


def skip_unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (hash, collection) has no success in the manifest."""
    return files.join(manifest.where("status = 'success'").select("file_hash", "collection"), ["file_hash", "collection"], "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key; applying it twice changes nothing."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def get_by_ids(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: pos, id. A row for each in order, empty where the store has none."""
    return wanted.join(store, "id", "left").orderBy("pos")


# --- queries ---------------------------------------------------------------------------------------------------------


def files(spark, d) -> DataFrame:
    return chunks(spark, d).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.col("lang").alias("collection"), "source_path")


def manifest(spark, d) -> DataFrame:
    """What earlier runs left: even documents in two versions, every third of them failed at last."""
    f = files(spark, d).where("doc_id % 2 = 0")
    status = F.when(F.col("doc_id") % 6 == 0, "failed").otherwise("success")
    rows = f.select("doc_id", "file_hash", "collection", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return rows.withColumn("status", F.when(F.col("version") == 1, "processing").otherwise(status))


def _latest_manifest(spark, d) -> DataFrame:
    return latest(manifest(spark, d), ["file_hash", "collection"], [F.desc("version"), F.col("doc_id")])


def _upserted_manifest(spark, d):
    """The manifest after two runs: what the second one says of a file replaces what the first one said, by collection."""
    rows, path = manifest(spark, d).drop("doc_id"), folder(spark, "manifest")
    run = lambda n: manifest(spark, d).where(F.col("version") == n).groupBy("file_hash", "collection").agg(F.min_by(F.struct("version", "status"), "doc_id").alias("r")).select("file_hash", "r.*", "collection")
    partitioned.create(run(1), path, ["collection"])
    partitioned.upsert(run(2), path, ["file_hash", "collection"], ["collection"])
    return partitioned.read(spark, path, rows.schema).select("file_hash", "collection", "version", "status")


def _upserted(spark, d):
    """A chunk store by language of what an earlier run left, into which a new run is put."""
    docs, path = table(spark, d, "documents"), folder(spark, "chunk-store")
    row = lambda q, mark: q.select(F.col("doc_id").alias("id"), F.length("text").alias("size"), F.lit(mark).alias("run"), "lang")
    old, new = row(docs.where("lang IN ('en', 'fr')"), "old"), row(docs.where("doc_id % 3 = 0"), "new")
    partitioned.create(old, path, ["lang"])
    partitioned.upsert(new, path, ["id"], ["lang"])
    return partitioned.read(spark, path, new.schema).select("id", "size", "run")


def _lookup(spark, d):
    wanted = table(spark, d, "labels").select((F.col("doc_id") * 2).alias("id")).distinct().withColumn("pos", F.col("id") * 7 % 1009)
    return get_by_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), wanted).select("pos", "id", F.coalesce("source", F.lit("")).alias("source"))


def delete_documents(ids: DataFrame, stores: dict[str, tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Deletes the documents `ids` (doc_id) from stores by language (name: path and rows it was made from), of which only
    the partitions that hold some of them are written anew; gives what is left of each, read from disk."""
    out = {}
    for name, (path, rows) in stores.items():
        partitioned.remove(ids, path, ["doc_id"], ["lang"], rows.schema)
        out[name] = partitioned.read(ids.sparkSession, path, rows.schema)
    return out


def _deleted(spark, d):
    """Rows that the deletion of all English documents of a source leaves in each store that knows of them: chunks, postings,
    images and the manifest."""
    docs = table(spark, d, "documents")
    lang = docs.select("doc_id", "lang")
    pics = image_marks(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[IMAGE: ([^\]]+)\]"), F.lit(1))).alias("image_id"))
    tables = {"chunks": split_window(docs), "postings": bm25.forward(docs).select("doc_id", F.explode("terms").alias("term")), "images": pics, "manifest": _latest_manifest(spark, d)}
    stores = {}
    for name, rows in tables.items():
        rows, path = rows.join(lang, "doc_id"), folder(spark, f"store-{name}")
        partitioned.create(rows, path, ["lang"])
        stores[name] = (path, rows)
    left = delete_documents(docs.where("source = 'src2' AND lang = 'en'"), stores)
    counts = [rows.groupBy("doc_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "doc_id", "n") for name, rows in left.items()]
    return reduce(DataFrame.unionByName, counts)


def list_documents(spark, d):
    pieces = split_window(table(spark, d, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    pics = image_marks(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\[IMAGE: [^\]]+\]"), F.lit(0))).alias("n_images"))
    return chunks(spark, d).select("doc_id", "source_path").join(pieces, "doc_id", "left").join(pics, "doc_id", "left")


TRACE_LINES = "id long, stage string"


def trace_file(spark, d) -> str:
    """Events as lines of trace files, every ninth one damaged."""
    line = F.when(F.pmod("event_id", F.lit(9)) == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("stage"))))
    path = folder(spark, "traces")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return path


def read_lines(spark, path: str, schema: str = TRACE_LINES) -> DataFrame:
    """The lines of JSON files that can be read; damaged ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def damaged_lines(spark, path: str) -> DataFrame:
    """How many lines there are, how many of them cannot be read, and the last id that can."""
    rows = spark.read.schema(TRACE_LINES + ", damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(path)
    return rows.agg(F.count("*").alias("n_lines"), F.count("damaged").alias("n_damaged"), F.max("id").alias("last_id"))


#: Keys whose values an audit log must not show.
SECRET_KEYS = "(?i)key|token|secret|password"


def masked(entries: Column) -> Column:
    return F.transform_values(entries, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("***")).otherwise(v))


def audit_sink(spark, d) -> DataFrame:
    """Calls with their arguments, secret ones masked, appended as JSON lines and read again."""
    path = folder(spark, "audit")
    args = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("api_key"), F.md5(F.col("event_type").cast("binary"))))
    table(spark, d, "events").select("event_id", masked(args).alias("args")).write.mode("append").json(path)
    back = spark.read.schema("event_id long, args map<string,string>").json(path)
    return back.select("event_id", F.element_at("args", "k").alias("k"), F.element_at("args", "api_key").alias("api_key"))


def metrics_sink(spark, d) -> DataFrame:
    """Counts by type, one JSON line each, read again."""
    path = folder(spark, "metrics")
    table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.max("value"), 2).alias("largest")).write.mode("append").json(path)
    return spark.read.schema("event_type string, n long, largest double").json(path)


def json_sink(spark, d) -> DataFrame:
    """Events written as JSON lines, appended in two runs, and read again."""
    path = folder(spark, "sink")
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    e.where("event_id % 2 = 0").write.mode("append").json(path)
    e.where("event_id % 2 = 1").write.mode("append").json(path)
    return spark.read.schema("event_id long, event_type string, value double").json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = {
    "scan_documents": lambda s, d: table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")),
    "infer_source_type": lambda s, d: chunks(s, d).select("doc_id", infer_source_type(F.col("source_path")).alias("source_type")),
    "infer_source_from_metadata": lambda s, d: chunks(s, d).select("doc_id", infer_source_from_metadata(F.when(F.col("doc_id") % 5 == 0, F.col("source_type")), F.col("source_path"), F.substring("text", 1, 60)).alias("source_type")),
    "skip_unchanged": lambda s, d: skip_unchanged(files(s, d), _latest_manifest(s, d)).select("doc_id", "collection"),
    "manifest_upsert": _upserted_manifest,
    "chunk_upsert": _upserted,
    "get_by_ids": _lookup,
    "list_by_metadata": lambda s, d: chunks(s, d).where("source_type = 'slide' AND lang = 'fr'").select("doc_id", "source"),
    "delete_document": _deleted,
    "list_documents": list_documents,
    "document_detail": lambda s, d: split_window(table(s, d, "documents")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x.cast("string")), ",").alias("pieces")),
    "collection_stats": lambda s, d: split_window(table(s, d, "documents")).join(table(s, d, "documents").select("doc_id", "lang"), "doc_id").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")),
    "trace_scan": lambda s, d: read_lines(s, trace_file(s, d)),
    "trace_scan_damaged": lambda s, d: damaged_lines(s, trace_file(s, d)),
    "image_index": lambda s, d: images(s, d).groupBy(F.substring_index("image_id", "_", 1).alias("collection")).agg(F.count("*").alias("n_images"), F.max("page").alias("last_page")),
    "trace_sink": json_sink,
    "audit_sink": audit_sink,
    "metrics_sink": metrics_sink,
}
_P = "pieces AS (SELECT doc_id, (k / 800)::INT AS piece FROM (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0), 800)) AS k FROM documents))"
_F = f"{CHUNKS_SQL}, files AS (SELECT doc_id, sha256(text) AS file_hash, lang AS collection FROM chunks), man AS (SELECT doc_id, file_hash, collection, 2 AS version, CASE WHEN doc_id % 6 = 0 THEN 'failed' ELSE 'success' END AS status FROM files WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY file_hash, collection ORDER BY doc_id) = 1)"
ORACLE = {
    "scan_documents": "SELECT lang, source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY ALL",
    "infer_source_type": f"WITH {CHUNKS_SQL} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'textbook' WHEN 1 THEN 'slide' ELSE 'question_bank' END AS source_type FROM chunks",
    "infer_source_from_metadata": f"WITH {CHUNKS_SQL}, t AS (SELECT doc_id, source_type, lower(source_path || ' ' || substr(text, 1, 60)) AS h FROM chunks) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source_type WHEN regexp_matches(h, '习题|question|quiz|exam|题库') THEN 'question_bank' WHEN regexp_matches(h, '\\.pptx?|slide|lecture|课件') THEN 'slide' ELSE 'textbook' END AS source_type FROM t",
    "skip_unchanged": f"WITH {_F} SELECT f.doc_id, f.collection FROM files f LEFT JOIN man m ON m.file_hash = f.file_hash AND m.collection = f.collection AND status = 'success' WHERE m.doc_id IS NULL",
    "manifest_upsert": f"WITH {_F} SELECT file_hash, collection, version, status FROM man",
    "chunk_upsert": "SELECT doc_id AS id, length(text) AS size, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS run FROM documents WHERE doc_id % 3 = 0 OR lang IN ('en', 'fr')",
    "get_by_ids": "SELECT w.id * 7 % 1009 AS pos, w.id, coalesce(source, '') AS source FROM (SELECT DISTINCT doc_id * 2 AS id FROM labels) w LEFT JOIN documents d ON d.doc_id = w.id",
    "list_by_metadata": f"WITH {CHUNKS_SQL} SELECT doc_id, source FROM chunks WHERE source_type = 'slide' AND lang = 'fr'",
    "delete_document": f"""WITH {_F}, {_P}, {IMAGES_SQL}, gone AS (SELECT doc_id FROM documents WHERE source = 'src2' AND lang = 'en'),
x AS (SELECT 'chunks' AS "table", doc_id FROM pieces UNION ALL SELECT 'postings', doc_id FROM (SELECT DISTINCT doc_id, unnest({TERMS_SQL}) FROM documents) UNION ALL SELECT 'images', doc_id FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[IMAGE: ([^\\]]+)\\]', 1)) FROM marked) UNION ALL SELECT 'manifest', doc_id FROM man)
SELECT "table", doc_id, count(*) AS n FROM x WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY ALL""",
    "list_documents": f"WITH {CHUNKS_SQL}, {_P}, {IMAGES_SQL} SELECT c.doc_id, source_path, n_chunks, len(regexp_extract_all(m.text, '\\[IMAGE: [^\\]]+\\]'))::INT AS n_images FROM chunks c JOIN (SELECT doc_id, count(*) AS n_chunks FROM pieces GROUP BY 1) p ON p.doc_id = c.doc_id JOIN marked m ON m.doc_id = c.doc_id",
    "document_detail": f"WITH {_P} SELECT doc_id, string_agg(piece::VARCHAR, ',' ORDER BY piece) AS pieces FROM pieces GROUP BY 1",
    "collection_stats": f"WITH {_P} SELECT lang AS collection, count(*) AS chunks, count(DISTINCT p.doc_id) AS documents FROM pieces p JOIN documents d ON d.doc_id = p.doc_id GROUP BY 1",
    "trace_scan_damaged": "SELECT count(*) AS n_lines, count_if(event_id % 9 = 0) AS n_damaged, max(CASE WHEN event_id % 9 <> 0 THEN event_id END) AS last_id FROM events",
    "trace_scan": "SELECT event_id AS id, event_type AS stage FROM events WHERE event_id % 9 <> 0",
    "image_index": f"WITH {IMAGES_SQL} SELECT string_split(image_id, '_')[1] AS collection, count(*) AS n_images, max(page) AS last_page FROM images GROUP BY 1",
    "audit_sink": "SELECT event_id, json_extract_string(props, '$.k') AS k, '***' AS api_key FROM events",
    "metrics_sink": "SELECT event_type, count(*) AS n, round(max(value), 2) AS largest FROM events GROUP BY 1",
    "trace_sink": "SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1",
}
