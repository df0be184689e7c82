"""URL filters by a sort-merge range join.

A host becomes a key of its labels in reverse, each followed by a dot, so a rule for a host and its subdomains is the
interval of all keys that begin with the rule's. Intervals nest or are apart. Distinct hosts and the two ends of every
interval are dealt into `salts` parts (hosts by hash; intervals to each part), sorted by key and swept: a start makes
its rule host the top of the stack of active ones, an end makes the enclosing one the top again, and each host takes the
top that stands. The top brings the rules of all hosts on the stack; of those whose path begins the url's path, the
longest wins (host and path together, then the longer host, then the smaller action).

Null urls and urls without :// have an empty host and path, which no rule fits; they and all urls that no rule fits get
`default`. Pages are joined back by host, so repeated rows and extra columns pass through; columns named like the
results are replaced. Repeated rules act once. Rules with a null host, path or action are left out. A rule with an empty
host fits only urls with an empty host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarryloom.sources.tables import table

SALTS = 64
CONTRACT_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
RESULTS = ["host", "path", "rule", "verdict"]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_hosts(rules: DataFrame) -> DataFrame:
    """host, key, parent (key of the nearest enclosing rule host or ''), rules (of the host and all that enclose it)."""
    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "action").dropna().distinct()
    own = rules.groupBy("host").agg(F.collect_list(F.struct("path", "action")).alias("own"))
    labels = F.split("host", r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = own.select("host", F.explode(tails).alias("outer"))
    listed = above.join(own.select(F.col("host").alias("outer"), "own"), "outer")
    rule = F.transform("own", lambda r: F.struct((F.length("outer") + F.length(r["path"])).alias("size"), F.length("outer").alias("host_size"), F.col("outer").alias("host"), r["path"].alias("path"), r["action"].alias("action")))
    outer = F.when(F.col("outer") != F.col("host"), F.struct(F.length("outer").alias("n"), F.col("outer").alias("outer")))
    listed = listed.groupBy("host").agg(F.flatten(F.collect_list(rule)).alias("rules"), F.max(outer).alias("parent"))
    return listed.select("host", host_key(F.col("host")).alias("key"), F.coalesce(host_key(F.col("parent.outer")), F.lit("")).alias("parent"), "rules")


def sweep(hosts: DataFrame, nodes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, top): the key of the innermost rule host for each distinct host; '' if none."""
    part = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    ends = nodes.select(part.alias("part"), F.explode(F.array(
        F.struct(F.col("key"), F.lit(0).alias("kind"), F.col("key").alias("active")),
        F.struct(F.concat("key", F.lit("\U0010ffff")).alias("key"), F.lit(2).alias("kind"), F.col("parent").alias("active")),
    )).alias("e")).select("part", "e.*", F.lit(None).cast("string").alias("host"))
    # A longer key that ends at the same place closes first, so the enclosing rule is on top afterwards.
    events = hosts.select(F.pmod(F.xxhash64("host"), F.lit(salts)).cast("int").alias("part"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("active"), "host")
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.unionByName(ends).withColumn("top", F.last("active", ignorenulls=True).over(order))
    return swept.where("kind = 1").select("host", F.coalesce("top", F.lit("")).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", salts: int = SALTS) -> DataFrame:
    """pages with host, path, rule (host and path of the rule that wins, or null) and verdict. rules: host, path, action."""
    host, path = host_path(F.col(url))
    base = pages.drop(*RESULTS).withColumns({"host": host, "path": path})
    nodes = rule_hosts(rules)
    tops = sweep(base.select("host").distinct(), nodes, salts)
    found = tops.join(nodes.select(F.col("key").alias("top"), "rules"), "top").select("host", "rules")
    fit = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    out = base.join(found, "host", "left").withColumn("_r", fit)
    return out.select(*pages.drop(*RESULTS).columns, "host", "path", F.concat("_r.host", "_r.path").alias("rule"), F.coalesce("_r.action", F.lit(default)).alias("verdict"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, winning rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "action")])
    return judge(pages, spark.createDataFrame(CONTRACT_RULES, schema)).drop("url")


ORACLE = """
WITH rules(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.action,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost) + length(r.rpath) DESC, length(r.rhost) DESC) AS n
         FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE n = 1
"""
