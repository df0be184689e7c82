"""Source-aware search: budgets by source, each source searched on its own, units, backfill, order of presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators import bm25
from quarryloom.operators.retrieval import bm25_sql, queries_of
from quarryloom.sources.shared import saved
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table

#: Weights of the sources by task, how far to overfetch, and their order by evidence profile.
WEIGHTS = {
    "knowledge_query": {"textbook": 0.55, "slide": 0.30, "question_bank": 0.15},
    "review_summary": {"slide": 0.45, "textbook": 0.40, "question_bank": 0.15},
    "quiz_generator": {"question_bank": 0.60, "textbook": 0.25, "slide": 0.15},
    "quiz_evaluator": {"question_bank": 0.50, "textbook": 0.30, "slide": 0.20},
}
OVERFETCH = {"question_bank": 2, "slide": 2, "textbook": 4}
ORDERS = {"knowledge_query": ["textbook", "slide", "question_bank"], "review_summary": ["slide", "textbook", "question_bank"], "quiz_generator": ["question_bank", "textbook", "slide"], "quiz_evaluator": ["question_bank", "textbook", "slide"]}
TASKS = list(WEIGHTS)
#: The order in which sources fill up what budgets have left over.
FILLING = ["question_bank", "slide", "textbook"]


def weight_table(spark) -> DataFrame:
    return spark.createDataFrame([(t, s, w, OVERFETCH[s], ORDERS[t].index(s)) for t, ws in WEIGHTS.items() for s, w in ws.items()], "task string, source_type string, weight double, overfetch int, place int")


def tasks(spark, d) -> DataFrame:
    """Each item is a query of one of the four tasks, for k of 2 to 11 results, limited to the sources it allows."""
    task = F.element_at(F.array(*map(F.lit, TASKS)), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    return queries_of(spark, d).select("query_id", task.alias("task"), (F.pmod("query_id", F.lit(10)) + 2).cast("int").alias("k"), (F.pmod("query_id", F.lit(7)) == 0).alias("no_slides"))


def normalize_weights(spark, d) -> DataFrame:
    chosen = tasks(spark, d).join(F.broadcast(weight_table(spark)), "task").where("NOT (no_slides AND source_type = 'slide')")
    whole = F.sum("weight").over(Window.partitionBy("query_id"))
    return chosen.withColumn("weight", F.round(F.col("weight") / whole, 6))


def allocate_budget(weights: DataFrame) -> DataFrame:
    """Largest remainder with at least one result for each source if k allows. With at most three sources, a shortfall is
    filled once per source in order of remainders, and an excess (minima above k) is taken from the last sources."""
    q = Window.partitionBy("query_id")
    quota = F.round(F.col("weight") * F.col("k"), 9)
    out = weights.withColumn("quota", quota).withColumn("n_sources", F.count("*").over(q))
    out = out.withColumn("floor", F.floor("quota").cast("int"))
    out = out.withColumn("base", F.when(F.col("k") >= F.col("n_sources"), F.greatest("floor", F.lit(1))).otherwise(F.col("floor")))
    out = out.withColumn("missing", F.col("k") - F.sum("base").over(q))
    rank = F.row_number().over(q.orderBy(F.desc(F.round(F.col("quota") - F.col("floor"), 9)), "place"))
    out = out.withColumn("rank", rank).withColumn("give", F.when(F.col("rank") <= F.col("missing"), 1).otherwise(0))
    # Taking back: what the sources after this one can give up goes first.
    spare = F.col("base") - 1
    later = F.coalesce(F.sum(spare).over(q.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(spare, -F.col("missing") - later))
    budget = F.col("base") + F.col("give") - F.when(F.col("missing") < 0, take).otherwise(0)
    return out.select("query_id", "task", "k", "source_type", "weight", "overfetch", "place", budget.cast("int").alias("budget")).where("budget > 0")


def budgets(spark, d) -> DataFrame:
    return allocate_budget(normalize_weights(spark, d))


def found(spark, d) -> DataFrame:
    """The best hits of each source, searched on its own, with their places in it; as many as any budget, overfetched, or
    any list over all sources can use. One index and one search serve both, as what is best of all is best of its source."""
    index = bm25.forward(chunks(spark, d), carry=("source_type",))
    budget = budgets(spark, d).agg(F.coalesce(F.max(F.greatest(F.col("k"), F.col("budget") * F.greatest("overfetch", F.lit(1)))), F.lit(1))).first()[0]
    hits = bm25.search(queries_of(spark, d), index, budget, group="source_type").withColumnRenamed("rank", "source_rank")
    return hits.withColumn("parent_id", F.floor(F.col("doc_id") / 4))


def per_source(spark, d, hits: DataFrame | None = None) -> DataFrame:
    """Hits of each source, as many as its budget times its overfetch."""
    budget = budgets(spark, d).select("query_id", "source_type", "budget", (F.col("budget") * F.greatest("overfetch", F.lit(1))).alias("raw_k"))
    return (found(spark, d) if hits is None else hits).join(budget, ["query_id", "source_type"]).where("source_rank <= raw_k")


def everywhere(spark, d, hits: DataFrame | None = None) -> DataFrame:
    """Hits over all sources at once, as many as results are wanted, for queries that are not limited to some sources."""
    wanted = tasks(spark, d).where("NOT no_slides").select("query_id", "k")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return (found(spark, d) if hits is None else hits).join(wanted, "query_id").withColumn("rank", rank).where("rank <= k")


def collapse(rows: DataFrame) -> DataFrame:
    """Textbook hits by parent: best score, number of hits, ids."""
    return rows.where("source_type = 'textbook'").groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.count("*").alias("support"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("chunks"))


def units(rows: DataFrame) -> DataFrame:
    """Answer units: parents of textbook hits, and the other hits as they are."""
    parents = collapse(rows).select("query_id", F.concat(F.lit("p"), F.col("parent_id")).alias("unit"), F.lit("textbook").alias("source_type"), "score", "support", "chunks")
    flat = rows.where("source_type <> 'textbook'").select("query_id", F.concat(F.lit("c"), F.col("doc_id")).alias("unit"), "source_type", "score", F.lit(1).cast("long").alias("support"), F.col("doc_id").cast("string").alias("chunks"))
    return parents.unionByName(flat)


def chosen(spark, d, hits: DataFrame | None = None) -> DataFrame:
    """The best units of each source within its budget."""
    ranked = units(per_source(spark, d, hits)).withColumn("source_rank", F.row_number().over(Window.partitionBy("query_id", "source_type").orderBy(F.desc("score"), "unit")))
    return ranked.join(budgets(spark, d).select("query_id", "source_type", "budget", "k", "place"), ["query_id", "source_type"]).where("source_rank <= budget")


def filled(spark, d) -> DataFrame:
    """The chosen units, and where they are fewer than k those of a search over all sources that are not among them, source
    by source; late says which."""
    # Few rows that are read three times; what they come from is not to be searched as often.
    hits = found(spark, d)
    have = saved(chosen(spark, d, hits).select("query_id", "unit", "source_type", "score", "support", "chunks", F.lit(0).alias("late")), "units")
    lacking = tasks(spark, d).select("query_id", "k").join(have.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", (F.col("k") - F.coalesce("n", F.lit(0))).alias("lacking")).where("lacking > 0")
    more = units(everywhere(spark, d, hits)).join(have.select("query_id", "unit"), ["query_id", "unit"], "left_anti").join(lacking, "query_id")
    turn = F.array_position(F.array(*map(F.lit, FILLING)), F.col("source_type"))
    more = more.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(turn, F.desc("score"), "unit"))).where("n <= lacking")
    return have.unionByName(more.select("query_id", "unit", "source_type", "score", "support", "chunks", F.lit(1).alias("late")))


def coalesced(spark, d, rows: DataFrame) -> DataFrame:
    """Units of the same chunks and the same text are one, with the better score and support. The text of a textbook unit is
    its parent's where there is one, else its first chunk's."""
    text = table(spark, d, "documents").select(F.col("doc_id").alias("shown"), F.md5(F.trim("text").cast("binary")).alias("body"))
    first = F.substring_index("chunks", ",", 1).cast("long")
    parent = F.when(F.col("source_type") == "textbook", F.substring("unit", 2, 20).cast("long") * 4)
    own = rows.withColumn("shown", first).join(text, "shown", "left").drop("shown").withColumn("shown", parent).join(text.withColumnRenamed("body", "above"), "shown", "left").drop("shown")
    key = ["query_id", "chunks", F.coalesce("above", "body").alias("body")]
    return own.groupBy(*key).agg(F.min("unit").alias("unit"), F.min_by("source_type", "unit").alias("source_type"), F.max("score").alias("score"), F.max("support").alias("support"))


def coalesce_units(spark, d) -> DataFrame:
    """The units of the sources and those of a search over all of them, brought together."""
    hits = found(spark, d)
    both = units(per_source(spark, d, hits)).unionByName(units(everywhere(spark, d, hits)))
    return coalesced(spark, d, both).select("query_id", "unit", "source_type", "body", "score", "support")


def presented(rows: DataFrame, spark, d) -> DataFrame:
    """Units in the order of sources that suits the task."""
    place = tasks(spark, d).select("query_id", "task", "k").join(F.broadcast(weight_table(spark).select("task", "source_type", "place")), "task")
    order = Window.partitionBy("query_id").orderBy("place", F.desc("score"), "unit")
    return rows.join(place, ["query_id", "source_type"]).withColumn("position", F.row_number().over(order))


def source_aware_search(spark, d) -> DataFrame:
    """Each source searched on its own, units within budgets, gaps filled from all sources, duplicates joined, the k best
    shown in the order of the task."""
    best = coalesced(spark, d, filled(spark, d)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit"))).join(tasks(spark, d).select("query_id", "k"), "query_id").where("rank <= k").drop("k", "rank")
    return presented(best, spark, d).select("query_id", "task", "position", "unit", "source_type", "score")


QUERIES = {
    "normalize_weights": lambda s, d: normalize_weights(s, d).select("query_id", "source_type", "weight"),
    "allocate_budget": lambda s, d: budgets(s, d).select("query_id", "source_type", "k", "budget"),
    "overfetch": lambda s, d: budgets(s, d).select("query_id", "source_type", (F.col("budget") * F.col("overfetch")).alias("raw_k")),
    "per_source_topk": lambda s, d: per_source(s, d).where("source_rank <= budget").select("query_id", "source_type", "doc_id", "score", "source_rank", "budget"),
    "collapse_to_parent": lambda s, d: collapse(per_source(s, d)),
    "flat_units": lambda s, d: units(per_source(s, d)).where("source_type <> 'textbook'"),
    "coalesce_units": coalesce_units,
    "backfill": lambda s, d: filled(s, d).select("query_id", "unit", "source_type", "score", "late"),
    "presentation_order": lambda s, d: presented(chosen(s, d).drop("place", "k"), s, d).select("query_id", "unit", "source_type", "score", "position"),
    "routing_stats": lambda s, d: units(per_source(s, d)).cube("source_type", (F.col("support") > 1).alias("several")).agg(F.count("*").alias("n_units"), F.round(F.avg("score"), 6).alias("avg_score")),
    "source_aware_search": source_aware_search,
}
_T = "(VALUES " + ", ".join(f"('{t}', '{s}', {w}::DOUBLE, {OVERFETCH[s]}, {ORDERS[t].index(s)})" for t, ws in WEIGHTS.items() for s, w in ws.items()) + ") w(task, source_type, weight, overfetch, place)"
_TASKS = "tasks AS (SELECT item_id AS query_id, CASE item_id % 4 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TASKS)) + " END AS task, (item_id % 10 + 2)::INT AS k, item_id % 7 = 0 AS no_slides FROM benchmark)"
_NW = f"{_TASKS}, nw AS (SELECT query_id, t.task, k, source_type, overfetch, place, round(weight / sum(weight) OVER (PARTITION BY query_id), 6) AS weight FROM tasks t JOIN {_T} ON w.task = t.task WHERE NOT (no_slides AND source_type = 'slide'))"
_B = f"""{_NW}, b1 AS (SELECT *, round(weight * k, 9) AS quota, floor(round(weight * k, 9))::INT AS fl, count(*) OVER (PARTITION BY query_id) AS ns FROM nw),
b2 AS (SELECT *, CASE WHEN k >= ns THEN greatest(fl, 1) ELSE fl END AS base FROM b1),
b3 AS (SELECT *, k - sum(base) OVER (PARTITION BY query_id) AS missing, row_number() OVER (PARTITION BY query_id ORDER BY round(quota - fl, 9) DESC, place) AS rk,
  coalesce(sum(base - 1) OVER (PARTITION BY query_id ORDER BY place DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM b2),
budgets AS (SELECT query_id, task, k, source_type, overfetch, place, (base + CASE WHEN rk <= missing THEN 1 ELSE 0 END - CASE WHEN missing < 0 THEN greatest(0, least(base - 1, -missing - later)) ELSE 0 END)::INT AS budget FROM b3)"""
_UNITS = """SELECT query_id, 'p' || parent_id::VARCHAR AS unit, 'textbook' AS source_type, max(score) AS score, count(*) AS support, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS chunks FROM @h WHERE source_type = 'textbook' GROUP BY query_id, parent_id
UNION ALL SELECT query_id, 'c' || doc_id::VARCHAR, source_type, score, 1, doc_id::VARCHAR FROM @h WHERE source_type <> 'textbook'"""
_H = f"""{CHUNKS_SQL}, {bm25_sql()}, {_B}, found AS (SELECT query_id, doc_id, score, source_type, parent_id FROM bm25 JOIN chunks USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, doc_id) AS source_rank FROM found),
hits AS (SELECT r.*, budget FROM ranked r JOIN budgets b ON b.query_id = r.query_id AND b.source_type = r.source_type WHERE source_rank <= budget * greatest(overfetch, 1)),
units AS ({_UNITS.replace('@h', 'hits')})"""
_C = f"""{_H}, chosen AS (SELECT u.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, unit) AS unit_rank FROM units) u JOIN budgets b ON b.query_id = u.query_id AND b.source_type = u.source_type WHERE unit_rank <= budget),
wide AS (SELECT f.* FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM found) f JOIN tasks t ON t.query_id = f.query_id WHERE NOT no_slides AND rank <= k),
wide_units AS ({_UNITS.replace('@h', 'wide')}),
lacking AS (SELECT t.query_id, k - count(unit) AS lacking FROM tasks t LEFT JOIN chosen c ON c.query_id = t.query_id GROUP BY t.query_id, k),
more AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY w.query_id ORDER BY CASE source_type WHEN 'question_bank' THEN 1 WHEN 'slide' THEN 2 ELSE 3 END, score DESC, unit) AS n FROM wide_units w WHERE NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = w.query_id AND c.unit = w.unit)) x JOIN lacking l ON l.query_id = x.query_id WHERE n <= lacking),
filled AS (SELECT query_id, unit, source_type, score, support, chunks, 0 AS late FROM chosen UNION ALL SELECT x.query_id, unit, source_type, score, support, chunks, 1 FROM more x)"""
_MERGED = """SELECT query_id, chunks, coalesce(md5(trim(p.text, ' ')), md5(trim(d.text, ' '))) AS body, min(unit) AS unit, min_by(source_type, unit) AS source_type, max(score) AS score, max(support) AS support
FROM (@u) u LEFT JOIN documents d ON d.doc_id = string_split(chunks, ',')[1]::BIGINT LEFT JOIN documents p ON source_type = 'textbook' AND p.doc_id = CASE WHEN source_type = 'textbook' THEN substr(unit, 2)::BIGINT * 4 END GROUP BY 1, 2, 3"""
_SHOWN = f"JOIN (SELECT query_id, t.task, k, source_type, place FROM tasks t JOIN {_T} ON w.task = t.task) p ON p.query_id = s.query_id AND p.source_type = s.source_type"
ORACLE = {
    "normalize_weights": f"WITH {_NW} SELECT query_id, source_type, weight FROM nw",
    "allocate_budget": f"WITH {_B} SELECT query_id, source_type, k, budget FROM budgets WHERE budget > 0",
    "overfetch": f"WITH {_B} SELECT query_id, source_type, budget * overfetch AS raw_k FROM budgets WHERE budget > 0",
    "per_source_topk": f"WITH {_H} SELECT query_id, source_type, doc_id, score, source_rank, budget FROM hits WHERE source_rank <= budget",
    "collapse_to_parent": f"WITH {_H} SELECT query_id, substr(unit, 2)::BIGINT AS parent_id, score, support, chunks FROM units WHERE source_type = 'textbook'",
    "flat_units": f"WITH {_H} SELECT * FROM units WHERE source_type <> 'textbook'",
    "coalesce_units": f"WITH {_C}, m AS ({_MERGED.replace('@u', 'SELECT * FROM units UNION ALL SELECT * FROM wide_units')}) SELECT query_id, unit, source_type, body, score, support FROM m",
    "backfill": f"WITH {_C} SELECT query_id, unit, source_type, score, late FROM filled",
    "presentation_order": f"WITH {_C} SELECT s.query_id, unit, s.source_type, score, row_number() OVER (PARTITION BY s.query_id ORDER BY p.place, score DESC, unit) AS position FROM chosen s {_SHOWN}",
    "routing_stats": f"WITH {_H} SELECT source_type, support > 1 AS several, count(*) AS n_units, round(avg(score), 6) AS avg_score FROM units GROUP BY CUBE (source_type, support > 1)",
    "source_aware_search": f"WITH {_C}, m AS ({_MERGED.replace('@u', 'SELECT * FROM filled')}), s AS (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY score DESC, unit) AS rank FROM m) SELECT s.query_id, task, row_number() OVER (PARTITION BY s.query_id ORDER BY p.place, score DESC, unit) AS position, unit, s.source_type, score FROM s {_SHOWN} WHERE rank <= k",
}
