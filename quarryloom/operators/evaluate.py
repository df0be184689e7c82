"""Retrieval metrics, reports and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.operators.retrieval import _bm25, bm25_sql, queries_of, small
from quarryloom.sources.shared import new_path, saved
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table, turns

K = 10
#: Two mean values are a regression if the second is lower by more than this; two lists differ if they share less.
REGRESSION, OVERLAP = 0.02, 0.4


def ideal_gain(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, r: a + F.when(r <= n, 1 / F.log2(r + 1)).otherwise(0.0))


def metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """A row per query: hit_rate, mrr, ndcg, precision (of what was returned) and recall. Each relevant id counts once, where
    it comes first. ranked: query_id, doc_id, rank; relevant: query_id, doc_id."""
    top = ranked.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    rel = relevant.distinct().withColumn("rel", F.lit(1))
    found = top.join(rel, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    total = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    out = queries.select("query_id").join(found, "query_id", "left").join(total, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return out.select("query_id", (zero("hits") > 0).cast("double").alias("hit_rate"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), ratio(zero("dcg"), ideal_gain(F.least(zero("n_rel"), F.lit(k))) * (zero("n_rel") > 0).cast("int")).alias("ndcg"), ratio(zero("hits"), zero("n")).alias("precision"), ratio(zero("hits"), zero("n_rel")).alias("recall"))


# --- queries ---------------------------------------------------------------------------------------------------------


def relevance(spark, d, window: int = 6) -> DataFrame:
    """A document is relevant to an item if they share `window` words in a row (all words, if it has fewer), wherever these
    stand: an equi-join on the windows of both."""
    w = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")
    windows = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - window, F.lit(0))), lambda i: F.array_join(F.slice(c, i + 1, window), " ")))
    exploded = lambda df, key, text: df.select(key, w(F.col(text)).alias("w")).where("size(w) > 0").select(key, F.explode(windows(F.col("w"))).alias("window"))
    items = exploded(queries_of(spark, d), "query_id", "query")
    return exploded(table(spark, d, "documents"), "doc_id", "text").join(small(items), "window").select("query_id", "doc_id").distinct()


_W = "list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_WINDOWS = "(SELECT id, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT id, w, unnest(generate_series(0, greatest(len(w) - 6, 0))) AS i FROM (SELECT @id AS id, @w AS w FROM @t) WHERE len(w) > 0))".replace("@w", _W)
REL_SQL = f"""rel AS (SELECT DISTINCT q.id AS query_id, d.id AS doc_id FROM {_WINDOWS.replace('@id', 'item_id').replace('@t', 'benchmark')} q JOIN {_WINDOWS.replace('@id', 'doc_id').replace('@t', 'documents')} d ON d.s = q.s)"""


def _metrics_sql(run: str, name: str, k: int = K) -> str:
    return f"""{name}_f AS (SELECT t.query_id, count(*) AS n, count(r.doc_id) AS hits, min(CASE WHEN r.doc_id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN r.doc_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM {run} t LEFT JOIN rel r ON r.query_id = t.query_id AND r.doc_id = t.doc_id WHERE rank <= {k} GROUP BY t.query_id),
{name} AS (SELECT b.item_id AS query_id, CASE WHEN coalesce(hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
  round(CASE WHEN coalesce(n_rel, 0) > 0 THEN coalesce(dcg, 0) / list_sum([1 / log2(x + 1) for x in generate_series(1, least(n_rel, {k}))]) ELSE 0 END, 6) AS ndcg, round(coalesce(hits::DOUBLE / n, 0), 6) AS precision, round(coalesce(hits::DOUBLE / n_rel, 0), 6) AS recall
  FROM benchmark b LEFT JOIN {name}_f f ON f.query_id = b.item_id LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1) c ON c.query_id = b.item_id)"""


def _runs_sql() -> str:
    other = bm25_sql(0.9)
    other = other[other.index("bm25 AS") :].replace("bm25 AS", "bm25b AS", 1)
    rank = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {0} QUALIFY rank <= 10"
    return f"{bm25_sql()}, {other}, run_a AS ({rank.format('bm25')}), run_b AS ({rank.format('bm25b')}), {REL_SQL}"


def run_metrics(spark, d, **o) -> DataFrame:
    return metrics(_bm25(spark, d, K, **o), relevance(spark, d), queries_of(spark, d))


def source_metrics(spark, d, hits: DataFrame | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """Hit rate and reciprocal rank on sources: each source of a list counts once, where it comes first. The product's
    figures accept for an expected source also those of its group; here src0 serves all."""
    src = chunks(spark, d).select("doc_id", F.lower(F.trim("source")).alias("s"))
    ranked = (_bm25(spark, d) if hits is None else hits).join(src, "doc_id").groupBy("query_id", "s").agg(F.min("rank").alias("rank"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "s")))
    want = (relevance(spark, d) if relevant is None else relevant).join(src, "doc_id").select("query_id", "s").distinct()
    groups = src.select("s").distinct().select("s", F.explode(F.array_distinct(F.array("s", F.lit("src0")))).alias("accepted"))
    wider = want.join(groups, "s").select("query_id", F.col("accepted").alias("s")).distinct()
    first = lambda w, name: ranked.join(w, ["query_id", "s"]).groupBy("query_id").agg(F.min("rank").alias(name))
    out = queries_of(spark, d).select("query_id").join(first(want, "strict"), "query_id", "left").join(first(wider, "product"), "query_id", "left")
    mrr = lambda c: F.round(F.coalesce(1 / F.col(c), F.lit(0.0)), 6)
    return out.select("query_id", F.col("strict").isNotNull().alias("hit"), mrr("strict").alias("mrr"), F.col("product").isNotNull().alias("product_hit"), mrr("product").alias("product_mrr"))


def eval_report(spark, d) -> DataFrame:
    """Each query's metrics and, under a null id, their means."""
    m = run_metrics(spark, d).unpivot("query_id", ["hit_rate", "mrr", "ndcg", "precision", "recall"], "metric", "value")
    return m.rollup("metric", "query_id").agg(F.round(F.avg("value"), 6).alias("value")).where("metric IS NOT NULL")


def compare_runs(spark, d) -> DataFrame:
    """Two runs per query: overlap, what only one has, expected ones that both miss, and whether the lists differ."""
    ids = lambda run, n: run.groupBy("query_id").agg(F.collect_set("doc_id").alias(n))
    a, b = ids(_bm25(spark, d), "a"), ids(_bm25(spark, d, k1=0.9), "b")
    rel = relevance(spark, d).groupBy("query_id").agg(F.collect_set("doc_id").alias("r"))
    both = a.join(b, "query_id", "full_outer").join(rel, "query_id", "left")
    e = lambda c: F.coalesce(c, F.array().cast("array<long>"))
    a, b, r = e("a"), e("b"), e("r")
    jac = F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6)
    return both.select("query_id", jac.alias("jaccard"), F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_except(b, a)).alias("only_b"), F.size(F.array_except(F.array_except(r, a), b)).alias("missed"), (jac < OVERLAP).alias("differs"))


def run_regressions(spark, d) -> DataFrame:
    m = lambda run, n: run.unpivot("query_id", ["hit_rate", "mrr", "ndcg", "recall"], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias(n))
    both = m(run_metrics(spark, d), "a").join(m(run_metrics(spark, d, k1=0.9), "b"), "metric")
    return both.select("metric", "a", "b", (F.col("a") - F.col("b") > REGRESSION).alias("regression"))


def agent_cases(spark, d) -> DataFrame:
    """Conversations as cases: the tools of a case are the words of its turns that stand in a small tool table."""
    t = turns(spark, d)
    tool = F.element_at(F.array(F.lit("knowledge_query"), F.lit("quiz_generator"), F.lit("review_summary"), F.lit("quiz_evaluator")), (F.pmod(F.length("text"), F.lit(4)) + 1).cast("int"))
    called = t.where("role = 'assistant'").withColumn("tool", tool).groupBy("conv_id").agg(F.array_sort(F.collect_set("tool")).alias("called"), F.sum(F.length("text")).alias("latency"))
    asked = t.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.max("turn").alias("n_turns"))
    want = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.array(F.lit("knowledge_query"))).when(F.pmod("conv_id", F.lit(3)) == 1, F.array(F.lit("quiz_generator"), F.lit("review_summary"))).otherwise(F.array().cast("array<string>"))
    return asked.join(called, "conv_id", "left").select("conv_id", "n_turns", F.coalesce("called", F.array().cast("array<string>")).alias("called"), F.coalesce("latency", F.lit(0)).alias("latency"), want.alias("expected"), F.array(F.lit("quiz_evaluator")).alias("forbidden"))


def agent_scores(cases: DataFrame) -> DataFrame:
    hit = F.size(F.array_intersect("called", "expected"))
    recall = F.round(F.when(F.size("expected") > 0, hit / F.size("expected")).otherwise(1.0), 6)
    bad = F.size(F.array_intersect("called", "forbidden"))
    return cases.select("conv_id", recall.alias("tool_recall"), bad.alias("n_forbidden"), ((recall == 1) & (bad == 0)).alias("success"), "latency", F.when(F.size("expected") == 0, "chat").when(F.size("expected") == 1, "knowledge").otherwise("heavy").alias("intent"))


def case_expectations(spark, d) -> DataFrame:
    c = agent_cases(spark, d)
    fails = F.filter(F.array(F.when(F.size(F.array_except("expected", "called")) > 0, "missing tool"), F.when(F.arrays_overlap("called", "forbidden"), "forbidden tool"), F.when(F.col("n_turns") > 8, "too many steps"), F.when(F.size("called") == 0, "no tool")), lambda x: x.isNotNull())
    return c.select("conv_id", F.array_join(fails, "; ").alias("failures"))


def eval_history(spark, d) -> DataFrame:
    """Hourly means of the purchase values as runs: the last ten and the change against the one before."""
    runs = table(spark, d, "events").where("event_type = 'purchase'").groupBy(F.date_trunc("hour", "ts").alias("run")).agg(F.round(F.avg("value"), 6).alias("score"))
    last = runs.orderBy(F.desc("run")).limit(11)
    out = last.withColumn("change", F.round(F.col("score") - F.lag("score").over(Window.orderBy("run")), 6)).withColumn("n", F.row_number().over(Window.orderBy(F.desc("run"))))
    return out.where("n <= 10").select(F.date_format("run", "yyyy-MM-dd HH").alias("run"), "score", "change")


def merge_evaluators(spark, d) -> DataFrame:
    """Metrics of several evaluators; where two give one of the same name, the later wins."""
    hits, relevant = _bm25(spark, d, K), saved(relevance(spark, d), "relevant")  # both evaluators judge the same
    first = metrics(hits, relevant, queries_of(spark, d)).unpivot("query_id", ["hit_rate", "mrr", "ndcg"], "metric", "value").withColumn("place", F.lit(0))
    second = source_metrics(spark, d, hits, relevant).select("query_id", F.lit("mrr").alias("metric"), F.col("mrr").alias("value"), F.lit(1).alias("place"))
    return first.unionByName(second).groupBy("query_id", "metric").agg(F.max_by("value", "place").alias("value"))


CASES_PER_FILE = 100
EVAL_SET = "description string, test_cases array<struct<query_id: long, query: string, expected_ids: array<long>>>"


def eval_set_files(spark, d) -> str:
    """The items with their expected documents as nested JSON over several lines, up to a hundred cases a file; one more
    file is damaged."""
    expected = relevance(spark, d).groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("expected_ids"))
    cases = queries_of(spark, d).join(expected, "query_id", "left").withColumn("file", F.floor(F.col("query_id") / CASES_PER_FILE).cast("int"))
    whole = F.struct(F.lit("items").alias("description"), F.collect_list(F.struct("query_id", "query", F.coalesce("expected_ids", F.array().cast("array<long>")).alias("expected_ids"))).alias("test_cases"))
    files = cases.groupBy("file").agg(F.to_json(whole, {"pretty": "true"}).alias("value"))
    path = new_path(spark, "eval-set")
    files.unionByName(spark.createDataFrame([(-1, '{"description": "cut off", "test_cases": [')], "file int, value string")).write.partitionBy("file").text(path)
    return path


def read_eval_sets(spark, path: str) -> DataFrame:
    """(query_id, query, expected_ids) of all cases of the files that can be read."""
    sets = spark.read.schema(EVAL_SET).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return sets.select(F.explode("test_cases").alias("c")).select("c.*")


def eval_set_scan(spark, d) -> DataFrame:
    return read_eval_sets(spark, eval_set_files(spark, d)).select("query_id", F.size("expected_ids").cast("long").alias("n_expected"), F.array_min("expected_ids").alias("first_expected"))


QUERIES = {
    "eval_set_scan": eval_set_scan,
    "hit_rate": lambda s, d: run_metrics(s, d).select("query_id", "hit_rate", "mrr"),
    "ndcg_at_k": lambda s, d: run_metrics(s, d).select("query_id", "ndcg"),
    "precision_at_k": lambda s, d: run_metrics(s, d).select("query_id", "precision", "recall"),
    "source_metrics": source_metrics,
    "eval_report": eval_report,
    "compare_runs": compare_runs,
    "run_regressions": run_regressions,
    "agent_case_scores": lambda s, d: agent_scores(agent_cases(s, d)),
    "agent_report": lambda s, d: agent_scores(agent_cases(s, d)).rollup("intent").agg(F.count("*").alias("n_cases"), F.round(F.avg("tool_recall"), 6).alias("tool_recall"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success"), F.round(F.avg("latency"), 6).alias("latency")),
    "case_expectations": case_expectations,
    "eval_history": eval_history,
    "merge_evaluators": merge_evaluators,
}
_M = f"{_runs_sql()}, {_metrics_sql('run_a', 'ma')}"
_UNP = "SELECT query_id, 'hit_rate' AS metric, hit_rate AS value FROM {0} UNION ALL SELECT query_id, 'mrr', mrr FROM {0} UNION ALL SELECT query_id, 'ndcg', ndcg FROM {0} UNION ALL SELECT query_id, 'recall', recall FROM {0}"
_SM = """src AS (SELECT doc_id, lower(trim(source)) AS s FROM documents), rk AS (SELECT query_id, s, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), s) AS rank FROM run_a JOIN src ON src.doc_id = run_a.doc_id GROUP BY query_id, s),
want AS (SELECT DISTINCT query_id, s FROM rel JOIN src ON src.doc_id = rel.doc_id), wide AS (SELECT * FROM want UNION SELECT query_id, 'src0' FROM want),
st0 AS (SELECT rk.query_id, min(rank) AS f FROM rk JOIN want w ON w.query_id = rk.query_id AND w.s = rk.s GROUP BY 1), pr AS (SELECT rk.query_id, min(rank) AS f FROM rk JOIN wide w ON w.query_id = rk.query_id AND w.s = rk.s GROUP BY 1),
sm AS (SELECT item_id AS query_id, st0.f IS NOT NULL AS hit, round(coalesce(1.0::DOUBLE / st0.f, 0), 6) AS mrr, pr.f IS NOT NULL AS product_hit, round(coalesce(1.0::DOUBLE / pr.f, 0), 6) AS product_mrr FROM benchmark LEFT JOIN st0 ON st0.query_id = item_id LEFT JOIN pr ON pr.query_id = item_id)"""
_CASES = """ca AS (SELECT conv_id, list_sort(list(DISTINCT CASE length(text) % 4 WHEN 0 THEN 'knowledge_query' WHEN 1 THEN 'quiz_generator' WHEN 2 THEN 'review_summary' ELSE 'quiz_evaluator' END)) AS called, sum(length(text)) AS latency FROM conversations WHERE role = 'assistant' GROUP BY 1),
cases AS (SELECT t.conv_id, n_turns, coalesce(called, []) AS called, coalesce(latency, 0) AS latency, CASE t.conv_id % 3 WHEN 0 THEN ['knowledge_query'] WHEN 1 THEN ['quiz_generator', 'review_summary'] ELSE []::VARCHAR[] END AS expected FROM (SELECT conv_id, max(turn) AS n_turns FROM conversations GROUP BY 1) t LEFT JOIN ca ON ca.conv_id = t.conv_id),
cs AS (SELECT conv_id, round(CASE WHEN len(expected) > 0 THEN len(list_intersect(called, expected))::DOUBLE / len(expected) ELSE 1.0 END, 6)::DOUBLE AS tool_recall, CASE WHEN list_contains(called, 'quiz_evaluator') THEN 1 ELSE 0 END AS n_forbidden, latency, CASE len(expected) WHEN 0 THEN 'chat' WHEN 1 THEN 'knowledge' ELSE 'heavy' END AS intent FROM cases)"""
ORACLE = {
    "eval_set_scan": f"WITH {REL_SQL} SELECT item_id AS query_id, count(doc_id) AS n_expected, min(doc_id) AS first_expected FROM benchmark LEFT JOIN rel ON rel.query_id = item_id GROUP BY 1",
    "hit_rate": f"WITH {_M} SELECT query_id, hit_rate, mrr FROM ma",
    "ndcg_at_k": f"WITH {_M} SELECT query_id, ndcg FROM ma",
    "precision_at_k": f"WITH {_M} SELECT query_id, precision, recall FROM ma",
    "source_metrics": f"WITH {_runs_sql()}, {_SM} SELECT * FROM sm",
    "eval_report": f"WITH {_M}, u AS ({_UNP.format('ma')} UNION ALL SELECT query_id, 'precision', precision FROM ma) SELECT metric, query_id, round(avg(value), 6) AS value FROM u GROUP BY GROUPING SETS ((metric, query_id), (metric))",
    "compare_runs": f"WITH {_runs_sql()}, a AS (SELECT query_id, list(doc_id) AS a FROM run_a GROUP BY 1), b AS (SELECT query_id, list(doc_id) AS b FROM run_b GROUP BY 1), r AS (SELECT query_id, list(doc_id) AS r FROM rel GROUP BY 1), j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a, []) AS a, coalesce(b, []) AS b, coalesce(r, []) AS r FROM a FULL JOIN b ON a.query_id = b.query_id LEFT JOIN r ON r.query_id = coalesce(a.query_id, b.query_id)), k AS (SELECT *, round(len(list_intersect(a, b))::DOUBLE / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard FROM j) SELECT query_id, jaccard, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_a, len(list_filter(b, lambda x: NOT list_contains(a, x)))::INT AS only_b, len(list_filter(r, lambda x: NOT list_contains(a, x) AND NOT list_contains(b, x)))::INT AS missed, jaccard < 0.4 AS differs FROM k",
    "run_regressions": f"WITH {_M}, {_metrics_sql('run_b', 'mb')}, a AS (SELECT metric, round(avg(value), 6) AS a FROM ({_UNP.format('ma')}) GROUP BY 1), b AS (SELECT metric, round(avg(value), 6) AS b FROM ({_UNP.format('mb')}) GROUP BY 1) SELECT a.metric, a, b, a - b > 0.02 AS regression FROM a JOIN b ON a.metric = b.metric",
    "agent_case_scores": f"WITH {_CASES} SELECT conv_id, tool_recall, n_forbidden, tool_recall = 1 AND n_forbidden = 0 AS success, latency, intent FROM cs",
    "agent_report": f"WITH {_CASES} SELECT intent, count(*) AS n_cases, round(avg(tool_recall), 6) AS tool_recall, round(avg(CASE WHEN tool_recall = 1 AND n_forbidden = 0 THEN 1 ELSE 0 END), 6) AS success, round(avg(latency), 6) AS latency FROM cs GROUP BY ROLLUP (intent)",
    "case_expectations": f"WITH {_CASES} SELECT conv_id, array_to_string(list_filter([CASE WHEN len(list_filter(expected, lambda x: NOT list_contains(called, x))) > 0 THEN 'missing tool' END, CASE WHEN list_contains(called, 'quiz_evaluator') THEN 'forbidden tool' END, CASE WHEN n_turns > 8 THEN 'too many steps' END, CASE WHEN len(called) = 0 THEN 'no tool' END], lambda x: x IS NOT NULL), '; ') AS failures FROM cases",
    "eval_history": "WITH r AS (SELECT date_trunc('hour', ts) AS run, round(avg(value), 6) AS score FROM events WHERE event_type = 'purchase' GROUP BY 1), l AS (SELECT run, score, round(score - lag(score) OVER (ORDER BY run), 6) AS change, row_number() OVER (ORDER BY run DESC) AS n FROM r) SELECT strftime(run, '%Y-%m-%d %H') AS run, score, change FROM l WHERE n <= 10",
    "merge_evaluators": f"WITH {_M}, {_SM} SELECT query_id, 'hit_rate' AS metric, hit_rate AS value FROM ma UNION ALL SELECT query_id, 'ndcg', ndcg FROM ma UNION ALL SELECT query_id, 'mrr', mrr FROM sm",
}
