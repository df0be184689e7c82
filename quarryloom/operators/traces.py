"""Traces, call logs and ingest reports, on traces that the event log gives: an event is a stage of the trace of its user and
hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators.chunking import split_window
from quarryloom.operators.retrieval import _bm25, bm25_sql, queries_of, term_frequencies
from quarryloom.sources.shared import saved
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table


def stages(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyyMMddHH")
    kind = F.element_at(F.array(F.lit("query"), F.lit("agent"), F.lit("ingestion"), F.lit("memory")), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    return e.select(F.concat(F.lit("t"), F.col("user_id"), F.lit("_"), hour).alias("trace_id"), kind.alias("type"), "event_id", F.col("event_type").alias("stage"), "ts", F.round("value", 2).alias("elapsed_ms"), F.concat(F.lit("src"), F.pmod("event_id", F.lit(3))).alias("source"))


STAGES_SQL = "stages AS (SELECT 't' || user_id::VARCHAR || '_' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS trace_id, CASE user_id % 4 WHEN 0 THEN 'query' WHEN 1 THEN 'agent' WHEN 2 THEN 'ingestion' ELSE 'memory' END AS type, event_id, event_type AS stage, ts, round(value, 2) AS elapsed_ms, 'src' || (event_id % 3)::VARCHAR AS source FROM events)"


def trace_list(spark, d):
    t = stages(spark, d).groupBy("trace_id", "type").agg(F.min("ts").alias("started"), F.count("*").alias("n_stages"), F.round(F.sum("elapsed_ms"), 2).alias("total_ms"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("started"), "trace_id"))).where("place <= 50").select("trace_id", "type", "n_stages", "total_ms", "place")


def stage_waterfall(spark, d):
    """Stages in order, labelled with their how-many-eth occurrence, and when they began within the trace."""
    s = stages(spark, d)
    w = Window.partitionBy("trace_id").orderBy("ts", "event_id")
    nth = F.row_number().over(Window.partitionBy("trace_id", "stage").orderBy("ts", "event_id"))
    begun = F.coalesce(F.sum("elapsed_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return s.withColumn("nth", nth).select("trace_id", "event_id", F.concat("stage", F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth"))).otherwise("")).alias("label"), F.round(begun, 2).alias("begun_ms"), "elapsed_ms")


def tool_chain(spark, d):
    s = stages(spark, d).where("stage IN ('click', 'purchase')").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "source"))), lambda x: x["source"]).alias("a"))
    return s.select("trace_id", F.array_join("a", ">").alias("chain"), F.array_join(F.array_distinct("a"), ">").alias("distinct_chain"))


def linked_traces(spark, d, most: int = 5):
    """Other traces of the same kind in the same hour, at most five: those among the first six of the hour, which are found
    in parts of each hour first."""
    t = stages(spark, d).select("trace_id", "type", F.substring_index("trace_id", "_", -1).alias("hour")).distinct()
    firsts = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("type", "hour", *by).orderBy("trace_id"))).where(F.col("n") <= most + 1).drop("n")
    few = firsts(firsts(t.withColumn("part", F.pmod(F.xxhash64("trace_id"), F.lit(32))), "part"))
    listed = few.groupBy("type", "hour").agg(F.array_sort(F.collect_list("trace_id")).alias("all"))
    return t.join(listed, ["type", "hour"]).select("trace_id", F.array_join(F.slice(F.array_remove("all", F.col("trace_id")), 1, most), ",").alias("linked"))


def memory_quality(spark, d):
    s = stages(spark, d).where("type = 'memory'")
    return s.groupBy(F.substring_index("trace_id", "_", 1).alias("user")).agg(F.round(F.avg(F.least(F.col("elapsed_ms") / 100, F.lit(1.0))), 6).alias("confidence"), F.round(F.avg((F.col("stage") == "error").cast("int")), 6).alias("conflict_rate"), F.round(F.avg((F.col("stage") == "view").cast("int")), 6).alias("skip_rate"))


def retrieval_summary(spark, d):
    h = _bm25(spark, d, 20).join(chunks(spark, d).select("doc_id", "source_type"), "doc_id")
    base = h.groupBy("query_id").agg(F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.round(F.avg("score"), 5).alias("avg_score"))
    funnel = h.groupBy("query_id").pivot("source_type", ["textbook", "slide", "question_bank"]).agg(F.count("doc_id"))
    return base.join(funnel.na.fill(0), "query_id")


def span_durations(spark, d):
    return stages(spark, d).groupBy("type", "stage").agg(F.count("*").alias("n"), F.round(F.sum("elapsed_ms"), 2).alias("total_ms"), F.round(F.percentile("elapsed_ms", 0.5), 4).alias("p50"), F.round(F.percentile("elapsed_ms", 0.95), 4).alias("p95"))


#: Size of quantile sketches: rank errors stay well below one in a hundred.
SKETCH_K = 400


def duration_sketches(rows: DataFrame) -> DataFrame:
    """(type, stage, hour, n, sketch): a quantile sketch of the durations of each hour. An hour is added when it is over, and
    none is ever read again for a later report; partial sketches of tasks are merged before they are shuffled."""
    return rows.groupBy("type", "stage", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("elapsed_ms", F.lit(SKETCH_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(type, stage, n, p50, p95, ...) from the sketches of any hours, without the durations."""
    whole = sketches.groupBy("type", "stage").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return whole.select("type", "stage", "n", *(F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in at))


def span_quantiles(spark, d):
    """Quantiles of durations by type and stage, from stored sketches of hours."""
    return merged_quantiles(saved(duration_sketches(stages(spark, d)), "sketches"))


def ingest_report(spark, d):
    p = split_window(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return p.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg(F.length("text")), 5).alias("mean_chars"), F.countDistinct("doc_id").alias("documents"), (F.count("*") - F.countDistinct(F.md5(F.col("text").cast("binary")))).alias("repeated"))


def top_terms(spark, d):
    tf = term_frequencies(table(spark, d, "documents"))
    ranked = tf.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term"))).where("n <= 10")
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ").alias("terms"))


def ingest_quality(spark, d):
    """Documents that look failed or too small, and whether any query finds their source at all."""
    found = _bm25(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("hits"))
    flag = F.when(F.length(F.trim("text")) == 0, "empty").when(F.length("text") < 200, "small").otherwise("ok")
    q = table(spark, d, "documents").groupBy("source").agg(F.count_if(flag == "empty").alias("empty"), F.count_if(flag == "small").alias("small"), F.count("*").alias("documents"))
    return q.join(found, "source", "left").select("source", "empty", "small", "documents", F.coalesce("hits", F.lit(0)).alias("hits"))


def result_listing(spark, d):
    """Numbered results of each query as one text; a message where there are none."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 60).alias("t"))
    rows = _bm25(spark, d, 3).join(docs, "doc_id").select("query_id", "rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "), F.col("source"), F.lit(": "), F.col("t")).alias("line"))
    listed = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("listing"))
    return queries_of(spark, d).select("query_id").join(listed, "query_id", "left").select("query_id", F.coalesce("listing", F.lit("No results.")).alias("listing"))


def parse_model_json(spark, d):
    """Properties as a model would return them, half of them inside code fences and some cut short."""
    raw = F.when(F.pmod("event_id", F.lit(7)) == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    fenced = F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    plain = F.trim(F.regexp_replace(fenced, "```(?:json)?|\n", ""))
    return table(spark, d, "events").select("event_id", F.coalesce(F.map_keys(F.from_json(plain, "map<string,string>")), F.array().cast("array<string>")).alias("k")).select("event_id", (F.size("k") > 0).alias("valid"))


QUERIES = {
    "trace_list": trace_list,
    "trace_filter": lambda s, d: stages(s, d).where("type = 'query' AND source = 'src1' AND stage LIKE '%e%'").groupBy("trace_id").agg(F.count("*").alias("n")),
    "stage_timings": lambda s, d: stages(s, d).groupBy("trace_id", "stage").agg(F.round(F.sum("elapsed_ms"), 2).alias("total_ms"), F.count("*").alias("n")),
    "stage_waterfall": stage_waterfall,
    "tool_chain": tool_chain,
    "linked_traces": linked_traces,
    "memory_quality": memory_quality,
    "retrieval_summary": retrieval_summary,
    "call_stats": lambda s, d: stages(s, d).groupBy("source").agg(F.count_if(F.col("stage") == "view").alias("hits"), F.count_if(F.col("stage") != "view").alias("misses"), F.round(F.avg((F.col("stage") == "view").cast("int")), 6).alias("hit_rate")),
    "counters": lambda s, d: stages(s, d).cube("type", "stage").agg(F.count("*").alias("n")),
    "span_durations": span_durations,
    "span_quantiles": span_quantiles,
    "ingest_report": ingest_report,
    "top_terms": top_terms,
    "ingest_quality": ingest_quality,
    "result_listing": result_listing,
    "parse_model_json": parse_model_json,
}
_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9][\\p{L}\\p{N}_-]*'), lambda x: lower(x)), lambda x: length(x) >= 2)) AS term FROM documents) GROUP BY ALL)"
_R = f"{bm25_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25)"
ORACLE = {
    "trace_list": f"WITH {STAGES_SQL}, t AS (SELECT trace_id, type, min(ts) AS started, count(*) AS n_stages, round(sum(elapsed_ms), 2) AS total_ms FROM stages GROUP BY ALL) SELECT trace_id, type, n_stages, total_ms, row_number() OVER (PARTITION BY type ORDER BY started DESC, trace_id) AS place FROM t QUALIFY place <= 50",
    "trace_filter": f"WITH {STAGES_SQL} SELECT trace_id, count(*) AS n FROM stages WHERE type = 'query' AND source = 'src1' AND stage LIKE '%e%' GROUP BY 1",
    "stage_timings": f"WITH {STAGES_SQL} SELECT trace_id, stage, round(sum(elapsed_ms), 2) AS total_ms, count(*) AS n FROM stages GROUP BY ALL",
    "stage_waterfall": f"WITH {STAGES_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY trace_id, stage ORDER BY ts, event_id) AS nth, coalesce(sum(elapsed_ms) OVER (PARTITION BY trace_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM stages) SELECT trace_id, event_id, stage || CASE WHEN nth > 1 THEN '#' || nth::VARCHAR ELSE '' END AS label, round(b, 2) AS begun_ms, elapsed_ms FROM s",
    "tool_chain": f"WITH {STAGES_SQL}, s AS (SELECT *, min(ts) OVER w AS f, first_value(event_id) OVER (PARTITION BY trace_id, source ORDER BY ts, event_id) AS fe, row_number() OVER (PARTITION BY trace_id, source ORDER BY ts, event_id) AS k FROM stages WHERE stage IN ('click', 'purchase') WINDOW w AS (PARTITION BY trace_id, source)) SELECT trace_id, string_agg(source, '>' ORDER BY ts, event_id) AS chain, string_agg(source, '>' ORDER BY ts, event_id) FILTER (WHERE k = 1) AS distinct_chain FROM s GROUP BY 1",
    "linked_traces": f"WITH {STAGES_SQL}, t AS (SELECT DISTINCT trace_id, type, string_split(trace_id, '_')[2] AS hour FROM stages), l AS (SELECT type, hour, list_sort(list(trace_id)) AS a FROM t GROUP BY ALL) SELECT trace_id, array_to_string(list_filter(a, lambda x: x <> trace_id)[1:5], ',') AS linked FROM t JOIN l ON l.type = t.type AND l.hour = t.hour",
    "memory_quality": f"WITH {STAGES_SQL} SELECT string_split(trace_id, '_')[1] AS user, round(avg(least(elapsed_ms / 100, 1.0)), 6) AS confidence, round(avg((stage = 'error')::INT), 6) AS conflict_rate, round(avg((stage = 'view')::INT), 6) AS skip_rate FROM stages WHERE type = 'memory' GROUP BY 1",
    "retrieval_summary": f"WITH {CHUNKS_SQL}, {_R} SELECT query_id, max(score) AS max_score, min(score) AS min_score, round(avg(score), 5) AS avg_score, count_if(source_type = 'textbook')::BIGINT AS textbook, count_if(source_type = 'slide')::BIGINT AS slide, count_if(source_type = 'question_bank')::BIGINT AS question_bank FROM r JOIN chunks c ON c.doc_id = r.doc_id WHERE rank <= 20 GROUP BY 1",
    "call_stats": f"WITH {STAGES_SQL} SELECT source, count_if(stage = 'view')::BIGINT AS hits, count_if(stage <> 'view')::BIGINT AS misses, round(avg((stage = 'view')::INT), 6) AS hit_rate FROM stages GROUP BY 1",
    "counters": f"WITH {STAGES_SQL} SELECT type, stage, count(*) AS n FROM stages GROUP BY CUBE (type, stage)",
    "span_durations": f"WITH {STAGES_SQL} SELECT type, stage, count(*) AS n, round(sum(elapsed_ms), 2) AS total_ms, round(quantile_cont(elapsed_ms, 0.5), 4) AS p50, round(quantile_cont(elapsed_ms, 0.95), 4) AS p95 FROM stages GROUP BY ALL",
    "ingest_report": "WITH p AS (SELECT doc_id, source, substr(text, k::INT + 1, 1000) AS text FROM (SELECT doc_id, source, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 800)) AS k FROM documents)) SELECT source, count(*) AS chunks, round(avg(length(text)), 5) AS mean_chars, count(DISTINCT doc_id) AS documents, count(*) - count(DISTINCT md5(text)) AS repeated FROM p GROUP BY 1",
    "top_terms": f"WITH {_TF}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS n FROM tf) SELECT doc_id, string_agg(term, ' ' ORDER BY n) AS terms FROM r WHERE n <= 10 GROUP BY 1",
    "ingest_quality": f"WITH {_R}, h AS (SELECT source, count(*) AS hits FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 10 GROUP BY 1) SELECT d.source, count_if(length(trim(text, ' ')) = 0)::BIGINT AS empty, count_if(length(trim(text, ' ')) > 0 AND length(text) < 200)::BIGINT AS small, count(*) AS documents, coalesce(max(hits), 0) AS hits FROM documents d LEFT JOIN h ON h.source = d.source GROUP BY 1",
    "result_listing": f"WITH {_R}, l AS (SELECT query_id, string_agg('[' || rank::VARCHAR || '] ' || source || ': ' || substr(regexp_replace(text, '\\s+', ' ', 'g'), 1, 60), chr(10) ORDER BY rank) AS listing FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 3 GROUP BY 1) SELECT item_id AS query_id, coalesce(listing, 'No results.') AS listing FROM benchmark LEFT JOIN l ON l.query_id = item_id",
    "parse_model_json": "SELECT event_id, coalesce(json_valid(CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 5) ELSE props END), false) AND len(coalesce(json_keys(CASE WHEN event_id % 7 = 0 THEN '{}' ELSE props END), [])) > 0 AS valid FROM events",
}
