"""Queries in SQL over the registered table functions."""

from __future__ import annotations

from quarryloom.functions.tables import register, split_sql
from quarryloom.operators.chunking import structured
from quarryloom.sources.tables import table


def embed_sql(spark, d):
    """Pairs of neighbouring pieces of a text and how like they are, all in SQL: pieces by a table function, vectors by embed."""
    register(spark)
    return spark.sql(
        """WITH p AS (SELECT d.doc_id, s.piece, embed(s.text) AS v FROM {docs} d, LATERAL split_structure(d.text, 1200, 0) s),
        n AS (SELECT doc_id, piece, v, lead(v) OVER (PARTITION BY doc_id ORDER BY piece) AS w FROM p)
        SELECT doc_id, piece, round(aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x), 6) AS near FROM n WHERE w IS NOT NULL""",
        docs=structured(table(spark, d, "documents")),
    )


QUERIES = {
    "sql_split_recursive": lambda s, d: split_sql(s, table(s, d, "documents").select("doc_id", "text"), "split_recursive", 1000, 200),
    "sql_split_textbook": lambda s, d: split_sql(s, table(s, d, "documents").select("doc_id", "text"), "split_textbook", 1500, 300),
    "sql_split_window": lambda s, d: split_sql(s, table(s, d, "documents").select("doc_id", "text"), "split_window", 1000, 200),
    "sql_embed": embed_sql,
}
ORACLE = {
    "sql_split_window": "SELECT doc_id, (k / 800)::INT AS piece, k::INT AS start, substr(text, k::INT + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 800)) AS k FROM documents)",
}
