r"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form each belongs to.

All words stand in two tries, one of the words and one of the reversed words, whose nodes are numbered (see `trie`). A
word with the code point at i left out is the pair of integers (node of what precedes i, node of what follows it); the
same pair of two words of one length means one replaced code point. A word cut before i without leaving anything out is a
pair too, and where it meets a pair of the other kind, one word is the other with one more code point. Equal numbers are
equal strings, so an equi-join on the pairs gives exactly the neighbours: no candidates, no check of distances. Per pair
at most one word is cut there, and the words that leave something out there differ in that code point alone, so a group
is no larger than the alphabet.

A word's form is its neighbour with the largest count, if that is `factor` times its own or more; ties go to the smallest
word in code-point order. Roots follow forms to the last, by pointer doubling.

Null words are left out and rows of one word are added up. Words of any length cost in proportion to their length.
Null texts have no words; a null document id counts as an empty one. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.storage import saved, temporary
from quarryloom.sources.tables import table

#: A node is its partition in the upper bits and its place there in these; so is the number of a word.
PLACE_BITS = 40
LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
#: One in so many documents and words has a letter dropped, by the contract of `op11_spelling_variants`.
DAMAGED = 199
RUN = "[A-Za-z\u00c0-\u00ff]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving: slices are compared at once, whatever their length."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def trie(words: DataFrame, name: str) -> DataFrame:
    """Adds `id`, a number that ascends with `word`, and `nodes`: the trie nodes of its prefixes, the empty one first.

    Words are range-partitioned and sorted; in each partition a word shares the nodes of the prefix it has in common with
    the word before it and takes new numbers for the rest. What a partition's first word shares with the last one of the
    partition before it was numbered there: of each partition only its first and last word and the nodes of the last are
    gathered, and the numbers they settle are broadcast. Both are bounded by the number of partitions, and no prefix is
    ever written out. The numbers are saved before they are used, as a second run of the same plan may cut the ranges
    elsewhere."""
    spark, names = words.sparkSession, [c for c in words.columns if c != "word"]
    ordered = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id().cast("long"))

    def number(batches):
        last, path, place, free = "", [0], 0, 1
        for pdf in batches:
            rows = []
            for word in pdf.word:
                k = shared(last, word)
                path = path[: k + 1] + list(range(free, free + len(word) - k))
                free += len(word) - k
                rows.append((place, path))
                last, place = word, place + 1
            pdf["place"], pdf["nodes"] = [r[0] for r in rows], [r[1] for r in rows]
            yield pdf

    types = ", ".join(f"`{c}` {words.schema[c].dataType.simpleString()}" for c in names)
    local = saved(ordered.mapInPandas(number, ", ".join(filter(None, ["word string", types, "part long, place long, nodes array<long>"]))), name)
    ends = local.groupBy("part").agg(F.min_by("word", "place").alias("first"), F.max_by("word", "place").alias("last"), F.max_by("nodes", "place").alias("nodes"))
    settled, before = [], None
    for row in sorted(ends.collect(), key=lambda r: r.part):
        known = []
        if before is not None:
            part, last, nodes, of_part = before
            known = [of_part[x] if x < len(of_part) else (part << PLACE_BITS) + x for x in nodes[: shared(last, row.first) + 1]]
        settled.append((row.part, known))
        before = row.part, row.last, row.nodes, known
    table_ = F.broadcast(spark.createDataFrame(settled, "part long, known array<long>"))
    base = F.shiftleft("part", PLACE_BITS)
    nodes = F.transform("nodes", lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(base + x))
    return local.join(table_, "part").select("word", *names, (base + F.col("place")).alias("id"), nodes.alias("nodes"))


def neighbours(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(id, other, other_n): every ordered pair of words at distance one. `forward` has id, n and the nodes of each word,
    `backward` id and the nodes of the reversed word."""
    words = forward.select("id", "n", F.col("nodes").alias("before")).join(backward.select("id", F.col("nodes").alias("after")), "id")
    size = F.size("before") - 1

    def cut(last: Column, skipped: int) -> DataFrame:
        at = words.select("id", "n", "before", "after", size.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("at"))
        return at.select(F.get("before", F.col("at")).alias("head"), F.get("after", F.col("size") - F.col("at") - skipped).alias("tail"), "id", "n")

    whole = cut(size, 0)
    words = words.where(size > 0)
    without = cut(size - 1, 1)
    other = lambda df: df.select("head", "tail", F.col("id").alias("other"), F.col("n").alias("other_n"))
    replaced = without.join(other(without), ["head", "tail"]).where("id <> other").select("id", "n", "other", "other_n")
    # A letter left out of a run of equal ones gives the same word at each place of the run.
    longer = without.join(other(whole), ["head", "tail"]).select("id", "n", "other", "other_n").distinct()
    shorter = longer.select(F.col("other").alias("id"), F.col("other_n").alias("n"), F.col("id").alias("other"), F.col("n").alias("other_n"))
    return replaced.unionByName(longer).unionByName(shorter).select("id", "other", "other_n")


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(id, root) from (id, form): each form is followed to the last. `steps` is the length of the longest chain at most."""
    out = forms.select("id", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = out.select(F.col("id").alias("root"), F.col("root").alias("further"))
        out = saved(out.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root")), f"roots-{k}")
    return out


def variants(words: DataFrame, *, factor: int = FACTOR) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of `words` (word, n)."""
    spark = words.sparkSession
    words = words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    with temporary(spark) as keep:
        forward = trie(words, "forward-trie")
        backward = trie(forward.select(F.reverse("word").alias("word"), F.col("id").alias("of")), "backward-trie").select(F.col("of").alias("id"), "nodes")
        near = neighbours(forward, backward).groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct(F.col("other_n").alias("n"), (-F.col("other")).alias("minus"))).alias("best"))
        plain = forward.select("id", "word", "n")
        known = plain.join(near, "id", "left")
        has_form = F.col("best.n") >= factor * F.col("n")
        known = known.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, -F.col("best.minus")).alias("form"), F.when(has_form, F.col("best.n")).alias("form_n"))
        known = saved(known, "forms")
        most = known.agg(F.max("n") / F.min("n")).first()[0] or 1
        last = roots(known.where("form IS NOT NULL").select("id", "form"), int(math.log(max(most, 1), factor) + 1e-9) + 1)
        names = plain.select("id", "word")
        form = names.select(F.col("id").alias("form"), F.col("word").alias("form_word"))
        root = names.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
        out = known.join(last, "id", "left").join(form, "form", "left").join(root, "root", "left")
        return keep(out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def counted(docs: DataFrame, *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case. Where the CRC-32 of document and run is divisible by
    `damaged`, the run's code point at that number modulo its length is left out first."""
    runs = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))
    w = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run")).where(F.length("run") >= least_chars)
    w = w.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % damaged == 0, cut).otherwise(F.col("run"))
    return w.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words, form and root."""
    return variants(counted(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: CRC-32 as a fold over bytes with a table made by its rule; neighbours by the strings that remain when a code point is cut out.
ORACLE = f"""
WITH RECURSIVE tb AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS c, doc_id || ':' || run AS s FROM r WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
b AS (SELECT run, c, list_transform(range(strlen(s)), lambda j: ('0x' || substr(hex(encode(s)), 2 * j + 1, 2))::BIGINT) AS bs FROM o),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda y, x: xor(y >> 8, t[(xor(y, x) & 255) + 1])), 4294967295) AS h FROM b, tb),
w AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
v AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
p AS MATERIALIZED (SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS z FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
s AS (SELECT p.word AS x, v.word AS y FROM p JOIN v ON v.word = p.a || p.z),
e AS MATERIALIZED (SELECT p.word AS x, q.word AS y FROM p JOIN p q ON q.a = p.a AND q.z = p.z AND q.word <> p.word UNION SELECT x, y FROM s UNION SELECT y, x FROM s),
k AS (SELECT x, y, v.n, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS i, count(*) OVER (PARTITION BY x) AS n_near FROM e JOIN v ON v.word = y),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= {FACTOR} * v.n THEN k.y END AS form, CASE WHEN k.n >= {FACTOR} * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON k.x = v.word AND k.i = 1),
g AS (SELECT word, word AS at FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word JOIN f z ON z.word = g.at AND z.form IS NULL
"""
