"""Mastery, review, errors, sessions, quizzes and pacing of learners, from tables of answers and turns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions.tokens import words
from quarryloom.operators.evidence import filter_injection
from quarryloom.operators.queryprep import _FILTERED, _REQ, requests
from quarryloom.operators.retrieval import _bm25, bm25_sql, queries_of, small
from quarryloom.sources.shared import new_path
from quarryloom.sources.tables import ANSWERS_SQL, answers, table, turns

GAIN, LOSS, WEAK, STRONG, DECAYED = 0.1, 0.15, 0.5, 0.8, 0.45


#: Mastery in steps of .05: a right answer adds two, a wrong one takes three, within 0 and 20.
UP, DOWN, FULL = 2, 3, 20
#: The review intervals that doubling (to 30 at most) and halving reach from one day.
INTERVALS = [1, 2, 3, 4, 6, 7, 8, 12, 14, 15, 16, 24, 28, 30]


def mastery(df: DataFrame) -> DataFrame:
    """Folds each learner's answers on a concept in order of time: a right one adds .1, a wrong one takes .15, within 0 and 1;
    the review interval doubles or halves within 1 and 30 days. The answers of a minute are folded on their own, to a shift
    with a lower and an upper bound and to a map of intervals; such folds compose, so the minutes of a day become one, and
    the days are then applied in order. An array holds what one learner answered on one concept in a minute, the minutes of
    a day, or the days."""
    within = lambda x: F.greatest(F.lit(0), F.least(F.lit(FULL), x))
    known = F.array(*map(F.lit, INTERVALS))
    nothing = F.struct(F.lit(0).alias("shift"), F.lit(0).alias("low"), F.lit(FULL).alias("high"), known.alias("days"))

    def step(s: Column, ok: Column) -> Column:
        by = F.when(ok, UP).otherwise(-DOWN)
        days = F.transform(s["days"], lambda x: F.when(ok, F.least(F.lit(30), x * 2)).otherwise(F.greatest(F.lit(1), F.floor(x / 2).cast("int"))))
        return F.struct((s["shift"] + by).alias("shift"), within(s["low"] + by).alias("low"), within(s["high"] + by).alias("high"), days.alias("days"))

    def then(s: Column, x: Column) -> Column:
        f = x["f"]
        bound = lambda c: F.least(f["high"], F.greatest(f["low"], c + f["shift"]))
        days = F.transform(s["days"], lambda d: F.element_at(f["days"], F.array_position(known, d).cast("int")))
        return F.struct((s["shift"] + f["shift"]).alias("shift"), bound(s["low"]).alias("low"), bound(s["high"]).alias("high"), days.alias("days"))

    key = ["user_id", "concept"]
    part = df.groupBy(*key, F.date_trunc("minute", "ts").alias("at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "correct"))), lambda x: x["correct"]).alias("a"), F.max("ts").alias("last"))
    part = part.select(*key, "at", F.aggregate("a", nothing, step).alias("f"), F.size("a").alias("n"), F.size(F.filter("a", lambda ok: ok)).alias("right"), "last")
    for unit in ("day", None):
        by = [F.date_trunc(unit, "at").alias("unit")] if unit else []
        part = part.groupBy(*key, *by).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("h"), F.sum("n").cast("int").alias("n"), F.sum("right").cast("int").alias("right"), F.max("last").alias("last"))
        part = part.select(*key, *([F.col("unit").alias("at")] if unit else []), F.aggregate("h", nothing, then).alias("f"), "n", "right", "last")
    m = F.least(F.col("f.high"), F.greatest(F.col("f.low"), F.col("f.shift")))
    return part.select(*key, F.round(m / FULL, 6).alias("mastery"), F.element_at("f.days", 1).alias("interval_days"), F.col("n").alias("quiz_count"), F.col("right").alias("correct_count"), F.col("last").alias("last_reviewed"))


def decay(m: Column, idle_days: Column, interval: Column) -> Column:
    """Mastery after a pause; changes of a hundredth or less and pauses under half a day are ignored."""
    new = F.round(m * F.exp(-idle_days / (2 * interval)), 3)
    return F.when((idle_days < 0.5) | (F.abs(m - new) <= 0.01), m).otherwise(new)


def nodes(spark, d) -> DataFrame:
    """Mastery with its decayed value as of the newest event."""
    a = answers(spark, d)
    now = a.agg(F.max("ts").alias("as_of"))
    idle = F.unix_timestamp("as_of") - F.unix_timestamp("last_reviewed")
    return mastery(a).join(F.broadcast(now)).withColumn("idle_seconds", idle).withColumn("idle_days", F.round(idle / 86400, 6)).withColumn("decayed", decay(F.col("mastery"), F.col("idle_days"), F.col("interval_days")))


def top(df: DataFrame, k: int, group: list[str], *order: Column, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def joined(values: Column) -> Column:
    return F.array_join(values, ",")


# --- queries ---------------------------------------------------------------------------------------------------------

_NODE_COLS = ["user_id", "concept", "mastery", "decayed"]


def due_for_review(spark, d):
    return nodes(spark, d).where("idle_days >= interval_days").select("user_id", "concept", "interval_days", "idle_seconds")


def weak_nodes(spark, d):
    n = nodes(spark, d)
    return n.select("user_id", "concept", (F.col("mastery") < WEAK).alias("weak"), (F.col("decayed") < DECAYED).alias("faded"), (F.col("mastery") >= STRONG).alias("strong")).where("weak OR faded OR strong")


def error_list(spark, d):
    wrong = answers(spark, d).where("NOT correct")
    return top(wrong, 50, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "concept", "n")


def weak_concepts(spark, d):
    newest = top(answers(spark, d).where("NOT correct"), 200, ["user_id"], F.desc("ts"), F.desc("event_id"))
    counts = newest.groupBy("user_id", "concept").agg(F.count("*").alias("errors"))
    return top(counts, 20, ["user_id"], F.desc("errors"), F.col("concept"), name="rank")


def profile_rollup(spark, d):
    a = answers(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.max("event_id").alias("last_event"))
    n = nodes(spark, d)
    side = lambda test, name: n.where(test).groupBy("user_id").agg(joined(F.slice(F.array_sort(F.collect_set("concept")), 1, 15)).alias(name))
    return a.join(side(f"mastery < {WEAK}", "weak"), "user_id", "left").join(side(f"mastery >= {STRONG}", "strong"), "user_id", "left")


#: Topics of lessons, in the order in which they are looked for, and what tells a learner's preferences.
TOPICS = [
    "TCP|UDP|IP|HTTP|HTTPS|DNS|DHCP|ARP|ICMP|FTP|SMTP|POP3|IMAP|BGP|OSPF|RIP",
    "三次握手|四次挥手|拥塞控制|流量控制|滑动窗口|慢启动|快速重传|快速恢复",
    "子网掩码|路由|交换机|防火墙|NAT|VLAN|以太网|无线网络|WiFi",
    "OSI|TCP/IP|网络层|运输层|应用层|链路层|物理层|数据报|分组",
    "第[一二三四五六七八九十0-9]+章",
]
CONCISE, DETAILED = "简洁|简单|简短|brief|concise|不用太详细", "详细|详尽|展开|细致|detailed|elaborate|深入"
EXAM, EXAMPLES = "考点|考试|重点|要点|exam|key.?point|应试", "举例|例子|示例|example|举个"
#: Behind the user turns at hand, which speak of no lesson, one of these.
LESSONS = [" 请详细解释 TCP 的三次握手？", " 考试重点是第三章的拥塞控制吗?", "", " 简单说说 DNS，举个例子", " 不用太详细，深入讲路由和 NAT", " What is UDP?"]


def lessons(spark, d) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, LESSONS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(LESSONS))) + 1).cast("int"))
    return turns(spark, d).withColumn("text", F.when(F.col("role") == "user", F.concat("text", tail)).otherwise(F.col("text")))


def extracted(t: DataFrame) -> DataFrame:
    """Per conversation: topics (ten at most, each once whatever its case), preferences and which of them contradict each
    other, the first three questions, and a summary."""
    listed = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    c = t.groupBy("conv_id").agg(listed("user").alias("u"), listed("assistant").alias("a"))
    every = F.array_join(F.concat("u", "a"), " ")
    found = F.concat(*[F.regexp_extract_all(every, F.lit(("(?i)" if n == 0 else "") + p), F.lit(0)) for n, p in enumerate(TOPICS)])
    lower = F.transform("found", F.lower)
    once = F.filter("found", lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)
    asked = F.filter("u", lambda x: F.rtrim(F.regexp_replace(x, r"\s+$", "")).rlike("[？?]$") & (F.length(x) > 5))
    has = lambda p: F.array_join("u", " ").rlike(f"(?i){p}")
    out = c.select("conv_id", "u", found.alias("found"), has(CONCISE).alias("concise"), has(DETAILED).alias("detailed"), has(EXAM).alias("exam"), has(EXAMPLES).alias("examples"))
    out = out.withColumn("topics", F.slice(once, 1, 10)).withColumn("questions", F.slice(F.transform(asked, lambda x: F.substring(F.regexp_replace(x, r"^\s+|\s+$", ""), 1, 100)), 1, 3))
    # Preferences that contradict each other are none.
    detail = F.when(F.col("concise") & F.col("detailed"), None).when(F.col("concise"), "concise").when(F.col("detailed"), "detailed")
    style = F.when(F.col("exam") & F.col("examples"), None).when(F.col("exam"), "exam_focused").when(F.col("examples"), "example_heavy")
    conflicts = (F.col("concise") & F.col("detailed")).cast("int") + (F.col("exam") & F.col("examples")).cast("int")
    summary = F.when(F.size("topics") > 0, F.concat(F.lit("讨论了"), F.array_join(F.slice("topics", 1, 3), ", "))).otherwise("")
    return out.select("conv_id", "topics", detail.alias("detail_level"), style.alias("style"), conflicts.alias("conflicts"), "questions", summary.alias("summary"))


def extract_learning(spark, d):
    e = extracted(lessons(spark, d))
    return e.select("conv_id", F.array_join("topics", ",").alias("topics"), "detail_level", "style", F.array_join("questions", "|").alias("questions"), "summary")


def extraction_confidence(spark, d, session: float = 0.2, profile: float = 0.65):
    """How sure an extraction is by its signals, less a quarter for each contradiction, and whether it may be written to the
    session and, as preferences, to the profile."""
    e = extracted(lessons(spark, d))
    fields = F.col("detail_level").isNotNull().cast("int") + F.col("style").isNotNull().cast("int")
    most = lambda c, n: F.least(c, F.lit(n))
    some = (F.size("topics") + F.size("questions") + fields) > 0
    score = 0.15 + most(F.size("topics"), 3) * 0.18 + most(F.size("questions"), 2) * 0.10 + (F.size("topics") > 0).cast("int") * 0.12 + most(fields, 2) * 0.24 - F.col("conflicts") * 0.25
    confidence = F.when(some, F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3)).otherwise(0.0)
    return e.select("conv_id", confidence.alias("confidence"), (some & (confidence >= session)).alias("write_session"), ((F.col("conflicts") == 0) & (fields > 0) & (confidence >= profile)).alias("write_profile"))


def pacing(spark, d):
    """By learner: faster or slower if the last two answers agree, else as before."""
    a = answers(spark, d).select("user_id", "ts", "event_id", "correct")
    last = top(a, 2, ["user_id"], F.desc("ts"), F.desc("event_id"))
    return last.groupBy("user_id").agg(F.when(F.count("*") < 2, "steady").when(F.min(F.col("correct").cast("int")) == 1, "faster").when(F.max(F.col("correct").cast("int")) == 0, "slower").otherwise("steady").alias("pace"))


#: What asks for depth, and under how many characters on average messages are a sign of doubt.
DEPTH, SHORT_MESSAGE = "(?i)(为什么|底层|更深入|深入一点|原理|本质|机制)", 5
#: What some learners say at last, by their number.
LAST_WORDS = {0: "为什么?", 1: "ok", 2: "讲讲底层机制"}


def turn_pacing(spark, d):
    """The pace of each conversation. Two last answers that are right or wrong alike decide; else the last two messages of
    the user that say something: faster if one asks for depth, slower if they have under five characters on average."""
    g = top(graded(spark, d), 2, ["conv_id"], F.desc("no")).groupBy("conv_id").agg(F.count("*").alias("n_answers"), F.min("score").alias("least"), F.max("score").alias("most"))
    said = F.when(F.pmod("conv_id", F.lit(5)) < 3, F.element_at(F.create_map(*(F.lit(x) for kv in LAST_WORDS.items() for x in kv)), F.pmod("conv_id", F.lit(5)).cast("int")))
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    t = turns(spark, d).where("role = 'user'").withColumn("text", F.trim(F.when(newest <= 2, F.coalesce(said, "text")).otherwise(F.col("text")))).where("length(text) > 0")
    last = top(t, 2, ["conv_id"], F.desc("turn")).groupBy("conv_id").agg(F.max(F.col("text").rlike(DEPTH)).alias("deep"), F.avg(F.length("text")).alias("mean"))
    alike = F.coalesce(F.col("n_answers") == 2, F.lit(False))
    pace = F.when(alike & (F.col("least") == 100), "accelerate").when(alike & (F.col("most") == 0), "decelerate").when(F.col("deep"), "accelerate").when(F.col("mean") < SHORT_MESSAGE, "decelerate").otherwise("normal")
    return last.join(g, "conv_id", "left").select("conv_id", pace.alias("pace"), F.round("mean", 6).alias("mean_chars"))


#: Messages that say nothing, and words of the course that make even a short one say something.
GREETING = "^(你好|您好|hi|hello|hey|在吗|在不在|有人吗|嗨)$"
COURSE = "tcp|udp|dns|ip|http|osi|三次握手|四次挥手|拥塞控制|流量控制|子网|crc|滑动窗口|路由|网络层|传输层|应用层"
#: What learners say when they come back, by their number.
MESSAGES = ["hi", "ok", "tcp", "please explain the third chapter", "", "你好"]


def low_information(message: Column) -> Column:
    text, compact = F.trim(message), F.regexp_replace(message, r"\s+", "")
    return (F.length(text) == 0) | text.rlike(f"(?i){GREETING}") | ((F.length(compact) < 5) & ~message.rlike(f"(?i){COURSE}"))


def review_recommendation(spark, d):
    """What learners are reminded of whose message says nothing: their most faded concepts, those that they get wrong most
    often, and for how many whole days they have been away."""
    n = nodes(spark, d)
    listed = lambda df, order: df.groupBy("user_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct(order, "concept"))), lambda x: x["concept"])).alias("l"))
    faded = listed(top(n.where(F.col("decayed") < DECAYED), 5, ["user_id"], F.col("decayed"), F.col("concept")), "n").withColumnRenamed("l", "faded")
    weak = listed(weak_concepts(spark, d).where("rank <= 3"), "rank").withColumnRenamed("l", "weak")
    idle = n.groupBy("user_id").agg(F.floor(F.min("idle_seconds") / 86400).cast("int").alias("days"))
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.pmod("user_id", F.lit(len(MESSAGES))) + 1).cast("int"))
    out = idle.join(faded, "user_id", "left").join(weak, "user_id", "left").withColumn("low", low_information(message))
    some = F.col("faded").isNotNull() | F.col("weak").isNotNull() | (F.col("days") > 0)
    reason = F.when(~F.col("low"), "message_not_low_information").when(some, "low_information_message_with_learning_signals").otherwise("no_decay_or_weak_signals")
    shown = lambda c: F.when(F.col("low"), F.col(c))
    return out.select("user_id", (F.col("low") & some).alias("triggered"), reason.alias("reason"), shown("faded").alias("faded"), shown("weak").alias("weak"), shown("days").alias("days"))


def ontology(spark, d) -> DataFrame:
    """Concepts are nations: within a region, those before one are its prerequisites and those after it its subtopics;
    nations of other regions that begin alike are confusable with it."""
    p = table(spark, d, "nation").select(F.col("n_name").alias("concept"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("pos"))
    a, b = p.alias("a"), p.alias("b")
    near = F.col("a.region") == F.col("b.region")
    # Both sides are joined on a key that they share: the region, or the first letter.
    by = lambda key: a.join(b, (key("a") == key("b")) & (F.col("a.concept") != F.col("b.concept")))
    edges = by(lambda x: F.col(f"{x}.region")).select("a.concept", F.when(F.col("b.pos") < F.col("a.pos"), "prerequisite").otherwise("subtopic").alias("relation"), F.col("b.concept").alias("target"), F.col("b.pos").alias("pos"))
    alike = by(lambda x: F.substring(f"{x}.concept", 1, 1)).where(~near).select("a.concept", F.lit("confusable").alias("relation"), F.col("b.concept").alias("target"), F.col("b.pos").alias("pos"))
    return edges.unionByName(alike)


def named_concepts(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, concept): the concept that is called as asked, whatever the case, else the first one that contains the name."""
    n = names.select("name", F.lower(F.trim("name")).alias("key")).distinct()
    c = concepts.select("concept", F.lower("concept").alias("full")).distinct()
    exact = n.join(c, n.key == c.full).select("name", "concept")
    # The concepts of an ontology are a few, and are counted.
    part = n.join(exact, "name", "left_anti").join(small(c), (F.length("key") > 0) & F.contains(F.col("full"), F.col("key"))).groupBy("name").agg(F.min("concept").alias("concept"))
    return exact.unionByName(part)


def nation_mastery(spark, d) -> DataFrame:
    """Customers of a nation with money as learners who know it."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg((F.col("c_acctbal") > 5000).cast("int")), 6).alias("mastery"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("target"), "mastery")


def concept_neighbors(spark, d):
    """Neighbours of the concepts that are asked for: nations by their whole names, by these in other case, and by the end of
    the name alone."""
    e = ontology(spark, d).join(nation_mastery(spark, d), "target", "left")
    way = F.pmod("n_nationkey", F.lit(3))
    asked = table(spark, d, "nation").select(F.when(way == 0, F.col("n_name")).when(way == 1, F.lower("n_name")).otherwise(F.lower(F.substring("n_name", 4, 100))).alias("name"))
    named = named_concepts(asked, table(spark, d, "nation").select(F.col("n_name").alias("concept")))
    return named.join(e, "concept").select("name", "concept", "relation", "target", "mastery", (F.coalesce("mastery", F.lit(0.4)) < WEAK).alias("weak"))


def review_order(spark, d):
    """Prerequisites before subtopics, each once; the less known first (unknown counts as .4)."""
    e = ontology(spark, d).where("relation <> 'confusable'").join(nation_mastery(spark, d), "target", "left")
    order = Window.partitionBy("concept").orderBy(F.coalesce("mastery", F.lit(0.4)), F.when(F.col("relation") == "prerequisite", 0).otherwise(1), "pos")
    return e.withColumn("place", F.row_number().over(order)).select("concept", "target", "place")


QUIZ = r"(?m)^\s*Q?([0-9]+)[.)]\s*(.+)$"


def quiz_texts(spark, d) -> DataFrame:
    """Each conversation as a quiz: its user turns are questions, the assistant's next turns answers."""
    t = turns(spark, d).withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    line = lambda c: F.regexp_replace(c, r"\s+", " ")
    q = t.withColumn("no", no).select("conv_id", "no", F.concat(F.lit("Q"), F.col("no"), F.lit(". "), line(F.col("text")), F.lit("\nAnswer: "), line(F.coalesce("next", F.lit("none"))), F.lit("\n")).alias("b"))
    return q.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "b"))), lambda x: x["b"]), "").alias("text"))


def parse_quiz(df: DataFrame) -> DataFrame:
    blocks = F.filter(F.split("text", r"(?m)^Q(?=[0-9]+\. )"), lambda b: F.length(F.trim(b)) > 0)
    b = df.select("conv_id", F.posexplode(blocks).alias("pos", "b"))
    return b.select("conv_id", F.regexp_extract("b", r"^([0-9]+)\.", 1).cast("int").alias("no"), F.trim(F.regexp_extract("b", r"^[0-9]+\. ([^\n]*)", 1)).alias("question"), F.trim(F.regexp_extract("b", r"\nAnswer: ([^\n]*)", 1)).alias("answer"))


#: What counts in comparing questions, and how like they have to be.
QUESTION_TOKEN, ALIKE = r"[A-Za-z0-9\u4e00-\u9fff]+", 0.45


def question_similarity(a: str, b: str) -> float:
    """1 for questions of the same letters and digits, the ratio of lengths if one contains the other, else 0."""
    if not a or not b:
        return 0.0
    return min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0


def aligned(numbers: list[int | None], items: list[str], bundle: list[str]) -> list[int]:
    """For each item the number of its question in the bundle (0: none), in order: by its own number, else the most similar
    question that no item before it has taken, if that is similar enough; of equal ones the first."""
    taken: set[int] = set()
    out = []
    for number, item in zip(numbers, items, strict=True):
        if number is not None and 1 <= number <= len(bundle):
            found = number
        else:
            best = max(((question_similarity(item, q), -n) for n, q in enumerate(bundle, 1) if n not in taken), default=(0.0, 0))
            found = -best[1] if best[0] >= ALIKE else 0
        if found:
            taken.add(found)
        out.append(found)
    return out


def given_answers(quiz: DataFrame) -> DataFrame:
    """The same quiz as it is handed in: every third question without its number, of these every other one cut to two thirds
    and every fourth put in other words."""
    bare = F.col("no") % 3 == 0
    part = F.substring("question", F.lit(1), F.ceil(F.length("question") * 2 / 3).cast("int"))
    text = F.when(bare & (F.col("no") % 4 == 0), F.concat(F.lit("something else on "), F.reverse("question"))).when(bare & (F.col("no") % 2 == 0), part).otherwise(F.upper("question"))
    return quiz.select("conv_id", "no", F.when(~bare, F.col("no")).alias("given_no"), text.alias("given"), "question")


def align_answers(spark, d):
    """Given answers to questions; see `aligned`. A conversation is one group of a few rows."""
    letters = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(QUESTION_TOKEN), F.lit(0)), "")
    q = given_answers(parse_quiz(quiz_texts(spark, d))).select("conv_id", "no", "given_no", letters("given").alias("item"), letters("question").alias("source"))

    def run(pdf):
        pdf = pdf.sort_values("no").reset_index(drop=True)
        numbers = [None if n is None or n != n else int(n) for n in pdf.given_no]
        return pdf.assign(aligned=aligned(numbers, pdf["item"].tolist(), pdf["source"].tolist()))[["conv_id", "no", "aligned"]]

    return q.groupBy("conv_id").applyInPandas(run, "conv_id long, no int, aligned int")


def grade(answer: Column, truth: Column) -> Column:
    same = F.lower(F.trim(answer)) == F.lower(F.trim(truth))
    return F.when(F.length(F.trim(F.coalesce(answer, F.lit("")))) == 0, 0).when(same, 100).otherwise(60)


def graded(spark, d):
    """Parsed answers against those of the question before: equal, partly right, or empty where there is none."""
    q = parse_quiz(quiz_texts(spark, d))
    given = F.when(F.col("no") % 4 == 0, F.lit("")).when(F.col("no") % 2 == 0, F.col("answer")).otherwise(F.upper(F.col("question")))
    return q.select("conv_id", "no", grade(given, F.col("answer")).alias("score"))


def grade_batch(spark, d):
    return graded(spark, d).groupBy("conv_id").agg(F.bround(F.avg("score"), 0).cast("int").alias("score"), joined(F.transform(F.array_sort(F.collect_set("score")), lambda x: x.cast("string"))).alias("scores")).withColumn("verdict", F.when(F.col("score") >= 90, "correct").when(F.col("score") >= 60, "partial").otherwise("incorrect"))


def latest_outcomes(spark, d, n: int = 2):
    g = graded(spark, d)
    last = top(g, n, ["conv_id"], F.desc("no"))
    return last.groupBy("conv_id").agg(joined(F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda x: x["score"].cast("string"))).alias("outcomes"))


def sample_questions(spark, d):
    """Question-bank hits of a query if there are three or more, else six of any kind."""
    hits = _bm25(spark, d, 30).withColumn("bank", (F.col("doc_id") % 3 == 2).cast("int"))
    n = F.sum("bank").over(Window.partitionBy("query_id"))
    kept = hits.withColumn("n_bank", n).where((F.col("n_bank") < 3) | (F.col("bank") == 1))
    return top(kept, 6, ["query_id"], F.desc("score"), F.col("doc_id"), name="pos").select("query_id", "pos", "doc_id", F.when(F.col("n_bank") >= 3, "bank").otherwise("general").alias("kind"))


#: Questions made of what was found, by template, and how much of it they show.
SNIPPET, TOPIC = 90, 80
CHOICE = "关于 {t}，以下哪一项最符合课程资料中的描述？（第 {n} 题）\nA. {s}\nB. {t} 与该知识点无关\nC. {t} 只在物理层中使用\nD. {t} 不涉及任何状态或控制机制\nA\n课程证据指出：{s}"
SHORT_ANSWER = "请简述 {t} 的一个核心知识点。（第 {n} 题）\n{s}\n可结合课程证据作答：{s}"


def quiz_snippet(text: Column) -> Column:
    """The first sentence, by the first kind of end that the text has, without injections; at most 90 characters."""
    clean = F.trim(F.regexp_replace(filter_injection(text), r"\n", " "))
    out = F.lit(None).cast("string")
    for end in reversed(("。", "！", "？", ". ")):
        head = F.trim(F.substring_index(clean, end, 1))
        out = F.when(F.contains(clean, F.lit(end)) & (F.length(head) > 0), head).otherwise(out)
    return F.substring(F.coalesce(out, clean), 1, SNIPPET)


def filled_in(template: str, **values: Column) -> Column:
    """A text with columns in its places."""
    parts = re.split(r"\{(\w)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def fast_quiz(spark, d):
    """Three questions on each query from its best hits, in turn if there are fewer: with four options for queries of even
    numbers, else to be answered in words."""
    text = table(spark, d, "documents").select("doc_id", quiz_snippet(F.col("text")).alias("snippet"))
    hits = sample_questions(spark, d).join(text, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "snippet"))).alias("hits"))
    topic = queries_of(spark, d).select("query_id", filter_injection(F.col("query"), TOPIC).alias("topic"))
    q = hits.join(topic, "query_id").select("query_id", "topic", "hits", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    found = F.get("hits", ((F.col("n") - 1) % F.size("hits")).cast("int"))["snippet"]
    s = F.when(F.length(found) > 0, found).otherwise(F.concat("topic", F.lit(" 的核心概念与适用场景")))
    fill = lambda template: filled_in(template, t=F.col("topic"), n=F.col("n").cast("string"), s=s)
    return q.select("query_id", F.col("n").alias("no"), F.when(F.col("query_id") % 2 == 0, fill(CHOICE)).otherwise(fill(SHORT_ANSWER)).alias("question"))


def fast_summary(spark, d):
    """The first sentence of each of a query's five best documents as key points, with their sources."""
    text = table(spark, d, "documents").select("doc_id", F.concat(F.lit("- "), F.trim(F.get(F.split("text", r"[.\n]", 2), F.lit(0))), F.lit(" ("), F.col("source"), F.lit(")")).alias("point"))
    rows = _bm25(spark, d, 5).join(text, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "point"))).alias("p"))
    return rows.select("query_id", F.concat(F.lit("Key points:\n"), F.array_join(F.transform("p", lambda x: x["point"]), "\n")).alias("summary"))


def feedback(spark, d) -> DataFrame:
    """Clicks and errors as ratings up and down."""
    return table(spark, d, "events").where("event_type IN ('click', 'error')").select("event_id", "user_id", F.when(F.col("event_type") == "click", "up").otherwise("down").alias("rating"), "ts")


def conversation_list(spark, d):
    c = turns(spark, d).groupBy(F.pmod("conv_id", F.lit(5)).alias("user"), "conv_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.substring(F.min_by("text", "turn"), 1, 40), F.lit("")).alias("title"))
    return top(c, 20, ["user"], F.desc("conv_id"), name="place")


def context_budget(spark, d, tokens: int = 400, most: int = 40):
    """The newest turns of a conversation that fit the budget; the newest one always."""
    cost = F.floor(F.length("text") / 1.5).cast("long") + 1
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns(spark, d).withColumn("cost", cost).withColumn("n", F.row_number().over(w)).withColumn("used", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.where(((F.col("used") <= tokens) & (F.col("n") <= most)) | (F.col("n") == 1)).select("conv_id", "turn", "cost", "used")


def offload_long(spark, d, size: int = 200):
    digest = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 12)
    return turns(spark, d).select("conv_id", "turn", F.when(F.length("text") > size, F.concat(F.substring("text", 1, 50), F.lit("... ["), digest, F.lit("]"))).otherwise(F.col("text")).alias("text"))


def compaction_split(spark, d, keep: int = 3):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns(spark, d).select("conv_id", "turn", (n > keep).alias("compact"))


def memory_summary(spark, d):
    """Per learner: the last three topics, weak concepts, due ones, and the errors with how often each was repeated; all from
    one pass over the learner's concepts."""
    n = nodes(spark, d).withColumn("wrong", F.col("quiz_count") - F.col("correct_count"))
    listed = lambda which, what=F.col("concept"): F.array_sort(F.collect_list(F.when(which, what)))
    found = n.groupBy("user_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.unix_micros("last_reviewed")).alias("at"), "concept"))), 1, 3).alias("topics"),
        listed(F.col("mastery") < WEAK).alias("weak"),
        listed(F.col("idle_days") >= F.col("interval_days")).alias("due"),
        F.transform(listed(F.col("wrong") > 0, F.struct("concept", "wrong")), lambda x: F.concat(x["concept"], F.lit("x"), x["wrong"].cast("string"))).alias("errors"),
    )
    text = lambda c: F.when(F.size(c) > 0, joined(F.col(c)))
    return found.select("user_id", joined(F.transform("topics", lambda x: x["concept"])).alias("topics"), text("weak").alias("weak"), text("due").alias("due"), text("errors").alias("errors"))


def tool_chains(spark, d):
    t = turns(spark, d)
    tool = F.element_at(F.array(F.lit("search"), F.lit("quiz"), F.lit("review")), (F.pmod(F.length("text"), F.lit(3)) + 1).cast("int"))
    called = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct(F.col("turn"), tool.alias("tool")))))
    return t.groupBy("conv_id").agg(F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("turn")).otherwise(F.col("turn") + 1000)), 1, 200).alias("question"), joined(F.transform(called, lambda x: x["tool"])).alias("tools"))


def merge_preferences(spark, d):
    """Properties of events as preferences by user: the latest value of each key that is not the default wins."""
    kv = table(spark, d, "events").select("user_id", "ts", "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value")).where("value IS NOT NULL AND value <> ''")
    return kv.groupBy("user_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


#: Number words, kinds of questions and how a request says how hard they shall be.
NUMBER_WORDS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
COUNT = "([0-9]+|[一二两三四五六七八九十])\\s*道"
KINDS = [("选择题", "选择题"), ("填空题", "填空题"), ("简答题", "简答题"), ("SQL题", "sql题|sql 题")]
HARDNESS = [(1, "难度\\s*1|简单|基础"), (2, "难度\\s*2"), (3, "难度\\s*3|中等"), (4, "难度\\s*4|困难"), (5, "难度\\s*5")]
NO_TOPIC = [
    "[，。！？；,!?;]+", "解释|讲解|说明|分析|详细解释|详细介绍|为什么|原理|是什么|区别|对比|比较", "复习|总结|梳理|回顾|考点|重点|复习摘要|复习重点|考试复习|期末复习",
    "出题|做题|练习|习题|刷题|测验|生成.*?题|来.*?道题|出.*?道题|题目", "判分|评分|批改|评估答案|帮我判|检查答案|我的答案是|请帮我判", COUNT, "选择题|填空题|简答题|sql题|SQL题", "难度\\s*[1-5]|基础|中等|困难|简单",
]


def request_slots(spark, d):
    """How many questions of what kind and difficulty a request asks for, and on what: what is left of it without these."""
    said = F.regexp_extract("text", COUNT, 1)
    number = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    kind = level = None
    for name, p in KINDS:
        kind = F.when(F.col("text").rlike(f"(?i){p}"), name) if kind is None else kind.when(F.col("text").rlike(f"(?i){p}"), name)
    for n, p in HARDNESS:
        level = F.when(F.col("text").rlike(p), n) if level is None else level.when(F.col("text").rlike(p), n)
    topic = F.col("text")
    for p in NO_TOPIC:
        topic = F.regexp_replace(topic, p, " ")
    topic = F.regexp_replace(F.regexp_replace(topic, r"\s+", " "), "^[ ，。！？；,!?;：:]+|[ ，。！？；,!?;：:]+$", "")
    whole = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120)
    return requests(spark, d).select("conv_id", "turn", F.coalesce(said.try_cast("int"), F.element_at(number, said)).alias("count"), kind.alias("kind"), level.alias("difficulty"), F.when(F.length(topic) > 0, topic).otherwise(whole).alias("topic"))


def flashcards(spark, d):
    """The first five lines of an assistant turn as cards of front, back and tags, written as tab-separated text and read
    again."""
    line = turns(spark, d).where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.slice(F.filter(F.split("text", r"[.\n]"), lambda x: F.length(F.trim(x)) > 0), 1, 5)).alias("pos", "l"))
    back = F.regexp_replace(F.trim("l"), r"\s+", " ")
    cards = line.select("conv_id", "turn", "pos", F.substring(back, 1, 20).alias("front"), back.alias("back"), F.lit("review").alias("tags"))
    path = new_path(spark, "cards")
    cards.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return spark.read.schema(cards.schema).option("sep", "\t").option("header", True).csv(path)


QUERIES = {
    "mastery_update": lambda s, d: mastery(answers(s, d)).drop("last_reviewed"),
    "mastery_decay": lambda s, d: nodes(s, d).select("user_id", "concept", "mastery", "decayed"),
    "due_for_review": due_for_review,
    "weak_nodes": weak_nodes,
    "error_list": error_list,
    "mark_mastered": lambda s, d: answers(s, d).groupBy("user_id", "concept").agg(F.max(F.when(F.col("correct"), F.struct("ts", "event_id"))).alias("ok"), F.max(F.when(~F.col("correct"), F.struct("ts", "event_id"))).alias("err")).where("err IS NOT NULL").select("user_id", "concept", F.coalesce(F.col("ok") > F.col("err"), F.lit(False)).alias("mastered")),
    "weak_concepts": weak_concepts,
    "profile_rollup": profile_rollup,
    "extract_learning": extract_learning,
    "extraction_confidence": extraction_confidence,
    "pacing": pacing,
    "turn_pacing": turn_pacing,
    "review_recommendation": review_recommendation,
    "concept_neighbors": concept_neighbors,
    "review_order": review_order,
    "parse_quiz_blocks": lambda s, d: parse_quiz(quiz_texts(s, d)),
    "align_answers": align_answers,
    "grade_exact": graded,
    "grade_batch": grade_batch,
    "latest_outcomes": latest_outcomes,
    "sample_questions": sample_questions,
    "fast_quiz": fast_quiz,
    "fast_summary": fast_summary,
    "feedback_stats": lambda s, d: feedback(s, d).groupBy("user_id").agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.round(F.avg((F.col("rating") == "up").cast("int")), 6).alias("share")),
    "feedback_recent": lambda s, d: feedback(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "rating"),
    "conversation_list": conversation_list,
    "context_budget": context_budget,
    "offload_long": offload_long,
    "compaction_split": compaction_split,
    "memory_summary": memory_summary,
    "tool_chains": tool_chains,
    "merge_preferences": merge_preferences,
    "request_slots": request_slots,
    "flashcard_export": flashcards,
}
_FOLD = f"""{ANSWERS_SQL}, o AS (SELECT user_id, concept, list(correct ORDER BY ts, event_id) AS a, max(ts) AS last_reviewed FROM answers GROUP BY ALL),
n0 AS (SELECT user_id, concept, a, last_reviewed, list_reduce(list_prepend({{'m': 0.0::DOUBLE, 'days': 1::INT}}, list_transform(a, lambda c: {{'m': (CASE WHEN c THEN 1.0 ELSE -1.0 END)::DOUBLE, 'days': 0::INT}})),
  lambda s, x: {{'m': round(CASE WHEN x.m > 0 THEN least(1.0, s.m + 0.1) ELSE greatest(0.0, s.m - 0.15) END, 6)::DOUBLE, 'days': (CASE WHEN x.m > 0 THEN least(30, s.days * 2) ELSE greatest(1, s.days // 2) END)::INT}}) AS f FROM o),
n1 AS (SELECT user_id, concept, f.m AS mastery, f.days AS interval_days, len(a)::INT AS quiz_count, last_reviewed, len(list_filter(a, lambda c: c))::INT AS correct_count, (epoch(date_trunc('second', (SELECT max(ts) FROM answers))) - epoch(date_trunc('second', last_reviewed)))::BIGINT AS idle_seconds, round((epoch(date_trunc('second', (SELECT max(ts) FROM answers))) - epoch(date_trunc('second', last_reviewed))) / 86400, 6) AS idle_days FROM n0),
nodes AS (SELECT *, CASE WHEN idle_days < 0.5 OR abs(mastery - round(mastery * exp(-idle_days / (2 * interval_days)), 3)) <= 0.01 THEN mastery ELSE round(mastery * exp(-idle_days / (2 * interval_days)), 3) END AS decayed FROM n1)"""
_HAS = lambda p, name: f"regexp_matches(array_to_string(u, ' '), '(?i){p}') AS {name}"
_EXT = f"""t AS (SELECT conv_id, turn, role, text || CASE WHEN role = 'user' THEN CASE (conv_id + turn) % {len(LESSONS)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LESSONS))} END ELSE '' END AS text FROM conversations),
c AS (SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'user'), []) AS u, coalesce(list(text ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS a FROM t GROUP BY conv_id),
f AS (SELECT *, array_to_string(list_concat(u, a), ' ') AS every FROM c),
x AS (SELECT conv_id, {' || '.join(f"regexp_extract_all(every, '{'(?i)' if n == 0 else ''}{p}')" for n, p in enumerate(TOPICS))} AS found FROM f),
o AS (SELECT conv_id, unnest(found) AS w, generate_subscripts(found, 1) AS i FROM x),
tp AS (SELECT conv_id, list(w ORDER BY i)[1:10] AS topics FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY i) = 1) GROUP BY conv_id),
q AS (SELECT conv_id, list_transform(list_filter(u, lambda z: regexp_matches(z, '[？?]\\s*$') AND length(z) > 5), lambda z: substr(regexp_replace(z, '^\\s+|\\s+$', '', 'g'), 1, 100))[1:3] AS questions, {_HAS(CONCISE, 'concise')}, {_HAS(DETAILED, 'detailed')}, {_HAS(EXAM, 'exam')}, {_HAS(EXAMPLES, 'examples')} FROM f),
ex AS (SELECT q.conv_id, coalesce(topics, []) AS topics, questions, CASE WHEN concise AND detailed THEN NULL WHEN concise THEN 'concise' WHEN detailed THEN 'detailed' END AS detail_level, CASE WHEN exam AND examples THEN NULL WHEN exam THEN 'exam_focused' WHEN examples THEN 'example_heavy' END AS style, (concise AND detailed)::INT + (exam AND examples)::INT AS conflicts FROM q LEFT JOIN tp ON tp.conv_id = q.conv_id),
ef AS (SELECT *, (detail_level IS NOT NULL)::INT + (style IS NOT NULL)::INT AS fields FROM ex)"""
_ONT = "ont AS (SELECT a.n_name AS concept, CASE WHEN b.n_nationkey < a.n_nationkey THEN 'prerequisite' ELSE 'subtopic' END AS relation, b.n_name AS target, b.n_nationkey AS pos FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name UNION ALL SELECT a.n_name, 'confusable', b.n_name, b.n_nationkey FROM nation a JOIN nation b ON left(a.n_name, 1) = left(b.n_name, 1) AND a.n_regionkey <> b.n_regionkey), nm AS (SELECT n_name AS target, round(avg(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END), 6) AS mastery FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), onm AS (SELECT ont.*, mastery FROM ont LEFT JOIN nm ON nm.target = ont.target)"
_QUIZ = "qz AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS no, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS question, trim(regexp_replace(coalesce(nx, 'none'), '\\s+', ' ', 'g'), ' ') AS answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE role = 'user'), gr AS (SELECT conv_id, no, CASE WHEN no % 4 = 0 THEN 0 WHEN no % 2 = 0 OR lower(question) = lower(answer) THEN 100 ELSE 60 END AS score FROM qz)"
_SQ = f"{bm25_sql()}, h AS (SELECT *, CASE WHEN doc_id % 3 = 2 THEN 1 ELSE 0 END AS bank FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 30), hb AS (SELECT *, sum(bank) OVER (PARTITION BY query_id) AS n_bank FROM h), sq AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INT AS pos, doc_id, CASE WHEN n_bank >= 3 THEN 'bank' ELSE 'general' END AS kind FROM hb WHERE n_bank < 3 OR bank = 1 QUALIFY pos <= 6)"
def _topic_sql() -> str:
    t = "text"
    for p in NO_TOPIC:
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), '^[ ，。！？；,!?;：:]+|[ ，。！？；,!?;：:]+$', '', 'g')"


_FB = "fb AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'up' ELSE 'down' END AS rating, ts FROM events WHERE event_type IN ('click', 'error'))"
ORACLE = {
    "mastery_update": f"WITH {_FOLD} SELECT user_id, concept, mastery, interval_days, quiz_count, correct_count FROM nodes",
    "mastery_decay": f"WITH {_FOLD} SELECT user_id, concept, mastery, decayed FROM nodes",
    "due_for_review": f"WITH {_FOLD} SELECT user_id, concept, interval_days, idle_seconds FROM nodes WHERE idle_days >= interval_days",
    "weak_nodes": f"WITH {_FOLD} SELECT user_id, concept, mastery < 0.5 AS weak, decayed < 0.45 AS faded, mastery >= 0.8 AS strong FROM nodes WHERE mastery < 0.5 OR decayed < 0.45 OR mastery >= 0.8",
    "error_list": f"WITH {ANSWERS_SQL} SELECT user_id, event_id, concept, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM answers WHERE NOT correct QUALIFY n <= 50",
    "mark_mastered": f"WITH {ANSWERS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, concept ORDER BY ts, event_id) AS k FROM answers) SELECT user_id, concept, coalesce(max(CASE WHEN correct THEN k END) > max(CASE WHEN NOT correct THEN k END), false) AS mastered FROM r GROUP BY ALL HAVING count_if(NOT correct) > 0",
    "weak_concepts": f"WITH {ANSWERS_SQL}, w AS (SELECT * FROM answers WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200), c AS (SELECT user_id, concept, count(*) AS errors FROM w GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY errors DESC, concept) AS rank FROM c QUALIFY rank <= 20",
    "profile_rollup": f"WITH {_FOLD}, a AS (SELECT user_id, count(*) AS total, round(avg(correct::INT), 6) AS accuracy, max(event_id) AS last_event FROM answers GROUP BY 1) SELECT a.*, weak, strong FROM a LEFT JOIN (SELECT user_id, array_to_string(list_sort(list(concept))[1:15], ',') AS weak FROM nodes WHERE mastery < 0.5 GROUP BY 1) w ON w.user_id = a.user_id LEFT JOIN (SELECT user_id, array_to_string(list_sort(list(concept))[1:15], ',') AS strong FROM nodes WHERE mastery >= 0.8 GROUP BY 1) s ON s.user_id = a.user_id",
    "extract_learning": f"WITH {_EXT} SELECT conv_id, array_to_string(topics, ',') AS topics, detail_level, style, array_to_string(questions, '|') AS questions, CASE WHEN len(topics) > 0 THEN '讨论了' || array_to_string(topics[1:3], ', ') ELSE '' END AS summary FROM ex",
    "extraction_confidence": f"""WITH {_EXT}, k AS (SELECT conv_id, conflicts, fields, len(topics) + len(questions) + fields > 0 AS told, CASE WHEN len(topics) + len(questions) + fields > 0 THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE + least(len(topics), 3) * 0.18::DOUBLE + least(len(questions), 2) * 0.10::DOUBLE + (len(topics) > 0)::INT * 0.12::DOUBLE + fields * 0.24::DOUBLE - conflicts * 0.25::DOUBLE)), 3) ELSE 0 END AS confidence FROM ef)
SELECT conv_id, confidence, told AND confidence >= 0.2 AS write_session, conflicts = 0 AND fields > 0 AND confidence >= 0.65 AS write_profile FROM k""",
    "pacing": f"WITH {ANSWERS_SQL}, l AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2) SELECT user_id, CASE WHEN count(*) < 2 THEN 'steady' WHEN bool_and(correct) THEN 'faster' WHEN NOT bool_or(correct) THEN 'slower' ELSE 'steady' END AS pace FROM l GROUP BY 1",
    "turn_pacing": f"""WITH {_QUIZ}, g AS (SELECT conv_id, count(*) AS n, min(score) AS least, max(score) AS most FROM (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY no DESC) <= 2) GROUP BY 1),
t AS (SELECT conv_id, turn, trim(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 THEN CASE conv_id % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in LAST_WORDS.items())} ELSE text END ELSE text END, ' ') AS text FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, bool_or(regexp_matches(text, '{DEPTH}')) AS deep, avg(length(text)) AS mean FROM (SELECT * FROM t WHERE length(text) > 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY 1)
SELECT l.conv_id, CASE WHEN n = 2 AND least = 100 THEN 'accelerate' WHEN n = 2 AND most = 0 THEN 'decelerate' WHEN deep THEN 'accelerate' WHEN mean < 5 THEN 'decelerate' ELSE 'normal' END AS pace, round(mean, 6) AS mean_chars FROM l LEFT JOIN g ON g.conv_id = l.conv_id""",
    "review_recommendation": f"""WITH {_FOLD}, i AS (SELECT user_id, floor(min(idle_seconds) / 86400)::INT AS days FROM nodes GROUP BY 1), f AS (SELECT user_id, concept, row_number() OVER (PARTITION BY user_id ORDER BY decayed, concept) AS n FROM nodes WHERE decayed < 0.45 QUALIFY n <= 5),
fl AS (SELECT user_id, string_agg(concept, ',' ORDER BY n) AS faded FROM f GROUP BY 1), w0 AS (SELECT * FROM answers WHERE NOT correct QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 200),
w1 AS (SELECT user_id, concept, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, concept) AS n FROM w0 GROUP BY user_id, concept QUALIFY n <= 3), wl AS (SELECT user_id, string_agg(concept, ',' ORDER BY n) AS weak FROM w1 GROUP BY 1),
m AS (SELECT i.*, faded, weak, CASE i.user_id % {len(MESSAGES)} {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(MESSAGES))} END AS message FROM i LEFT JOIN fl ON fl.user_id = i.user_id LEFT JOIN wl ON wl.user_id = i.user_id),
l AS (SELECT *, length(trim(message)) = 0 OR regexp_matches(trim(message), '(?i){GREETING}') OR (length(regexp_replace(message, '\\s+', '', 'g')) < 5 AND NOT regexp_matches(message, '(?i){COURSE}')) AS low, faded IS NOT NULL OR weak IS NOT NULL OR days > 0 AS has FROM m)
SELECT user_id, low AND has AS triggered, CASE WHEN NOT low THEN 'message_not_low_information' WHEN has THEN 'low_information_message_with_learning_signals' ELSE 'no_decay_or_weak_signals' END AS reason, CASE WHEN low THEN faded END AS faded, CASE WHEN low THEN weak END AS weak, CASE WHEN low THEN days END AS days FROM l""",
    "concept_neighbors": f"WITH {_ONT}, q AS (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE lower(substr(n_name, 4)) END AS name FROM nation), c AS (SELECT name, coalesce(min(CASE WHEN lower(n_name) = lower(name) THEN n_name END), min(n_name)) AS concept FROM q JOIN nation ON contains(lower(n_name), lower(name)) GROUP BY name) SELECT name, onm.concept, relation, target, mastery, coalesce(mastery, 0.4) < 0.5 AS weak FROM c JOIN onm ON onm.concept = c.concept",
    "review_order": f"WITH {_ONT} SELECT concept, target, row_number() OVER (PARTITION BY concept ORDER BY coalesce(mastery, 0.4), CASE relation WHEN 'prerequisite' THEN 0 ELSE 1 END, pos) AS place FROM onm WHERE relation <> 'confusable'",
    "parse_quiz_blocks": f"WITH {_QUIZ} SELECT conv_id, no, question, answer FROM qz",
    "grade_exact": f"WITH {_QUIZ} SELECT * FROM gr",
    "grade_batch": f"WITH {_QUIZ}, b AS (SELECT conv_id, round_even(avg(score), 0)::INT AS score, array_to_string(list_sort(list(DISTINCT score)), ',') AS scores FROM gr GROUP BY 1) SELECT *, CASE WHEN score >= 90 THEN 'correct' WHEN score >= 60 THEN 'partial' ELSE 'incorrect' END AS verdict FROM b",
    "latest_outcomes": f"WITH {_QUIZ} SELECT conv_id, string_agg(score::VARCHAR, ',' ORDER BY no DESC) AS outcomes FROM (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY no DESC) <= 2) GROUP BY 1",
    "sample_questions": f"WITH {_SQ} SELECT * FROM sq",
    "fast_quiz": f"""WITH {_SQ}, c AS (SELECT d.doc_id, trim(replace({_FILTERED}, chr(10), ' '), ' ') AS c FROM documents d),
e AS (SELECT doc_id, c, CASE {' '.join(f"WHEN contains(c, '{x}') AND trim(string_split(c, '{x}')[1], ' ') <> '' THEN trim(string_split(c, '{x}')[1], ' ')" for x in ("。", "！", "？", ". "))} ELSE c END AS h FROM c),
hh AS (SELECT query_id, list(substr(h, 1, 90) ORDER BY pos) AS hits FROM sq JOIN e ON e.doc_id = sq.doc_id GROUP BY 1),
q AS (SELECT query_id, no, {_FILTERED.replace('d.text', 'b.text').replace('2000', '80')} AS t, hits[(no - 1) % len(hits) + 1] AS s FROM hh JOIN benchmark b ON b.item_id = query_id, (SELECT unnest(range(1, 4)) AS no)),
f AS (SELECT query_id, no, t, CASE WHEN s <> '' THEN s ELSE t || ' 的核心概念与适用场景' END AS s FROM q)
SELECT query_id, no, CASE WHEN query_id % 2 = 0 THEN '关于 ' || t || '，以下哪一项最符合课程资料中的描述？（第 ' || no || ' 题）' || chr(10) || 'A. ' || s || chr(10) || 'B. ' || t || ' 与该知识点无关' || chr(10) || 'C. ' || t || ' 只在物理层中使用' || chr(10) || 'D. ' || t || ' 不涉及任何状态或控制机制' || chr(10) || 'A' || chr(10) || '课程证据指出：' || s
 ELSE '请简述 ' || t || ' 的一个核心知识点。（第 ' || no || ' 题）' || chr(10) || s || chr(10) || '可结合课程证据作答：' || s END AS question FROM f""",
    "fast_summary": f"WITH {bm25_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 5) SELECT query_id, 'Key points:' || chr(10) || string_agg('- ' || trim(regexp_split_to_array(text, '[.\\n]')[1], ' ') || ' (' || source || ')', chr(10) ORDER BY rank) AS summary FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY 1",
    "feedback_stats": f"WITH {_FB} SELECT user_id, count_if(rating = 'up')::BIGINT AS up, count_if(rating = 'down')::BIGINT AS down, round(avg((rating = 'up')::INT), 6) AS share FROM fb GROUP BY 1",
    "feedback_recent": f"WITH {_FB} SELECT event_id, user_id, rating FROM fb ORDER BY ts DESC, event_id DESC LIMIT 20",
    "conversation_list": "WITH c AS (SELECT conv_id % 5 AS user, conv_id, count(*) AS n_turns, substr(min_by(text, turn), 1, 40) AS title FROM conversations GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY user ORDER BY conv_id DESC) AS place FROM c QUALIFY place <= 20",
    "context_budget": "WITH t AS (SELECT conv_id, turn, floor(length(text) / 1.5)::BIGINT + 1 AS cost FROM conversations), u AS (SELECT *, row_number() OVER w AS n, sum(cost) OVER w AS used FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, cost, used FROM u WHERE (used <= 400 AND n <= 40) OR n = 1",
    "offload_long": "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 50) || '... [' || substr(sha256(text), 1, 12) || ']' ELSE text END AS text FROM conversations",
    "compaction_split": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 3 AS compact FROM conversations",
    "memory_summary": f"WITH {_FOLD} SELECT u.user_id, topics, weak, due, errors FROM (SELECT DISTINCT user_id FROM answers) u LEFT JOIN (SELECT user_id, string_agg(concept, ',' ORDER BY n) AS topics FROM (SELECT user_id, concept, row_number() OVER (PARTITION BY user_id ORDER BY last_reviewed DESC, concept) AS n FROM nodes QUALIFY n <= 3) GROUP BY 1) t ON t.user_id = u.user_id LEFT JOIN (SELECT user_id, string_agg(concept, ',' ORDER BY concept) AS weak FROM nodes WHERE mastery < 0.5 GROUP BY 1) w ON w.user_id = u.user_id LEFT JOIN (SELECT user_id, string_agg(concept, ',' ORDER BY concept) AS due FROM nodes WHERE idle_days >= interval_days GROUP BY 1) d ON d.user_id = u.user_id LEFT JOIN (SELECT user_id, string_agg(concept || 'x' || c::VARCHAR, ',' ORDER BY concept) AS errors FROM (SELECT user_id, concept, count(*) AS c FROM answers WHERE NOT correct GROUP BY ALL) GROUP BY 1) e ON e.user_id = u.user_id",
    "tool_chains": "SELECT conv_id, substr(min_by(text, CASE WHEN role = 'user' THEN turn ELSE turn + 1000 END), 1, 200) AS question, coalesce(string_agg(CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'quiz' ELSE 'review' END, ',' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS tools FROM conversations GROUP BY 1",
    "merge_preferences": "WITH kv AS (SELECT user_id, ts, event_id, unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT user_id, ts, event_id, key, json_extract_string(props, '$.' || key) AS value FROM kv) SELECT user_id, key, value FROM v WHERE value IS NOT NULL AND value <> '' QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY ts DESC, event_id DESC) = 1",
    "request_slots": f"""WITH {_REQ}, r AS (SELECT *, regexp_extract(text, '{COUNT}', 1) AS said, {_topic_sql()} AS topic FROM req)
SELECT conv_id, turn, coalesce(TRY_CAST(nullif(said, '') AS INT), CASE said {' '.join(f"WHEN '{k}' THEN {v}" for k, v in NUMBER_WORDS.items())} END)::INT AS count, CASE {' '.join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{n}'" for n, p in KINDS)} END AS kind,
 CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN {n}" for n, p in HARDNESS)} END AS difficulty, CASE WHEN length(topic) > 0 THEN topic ELSE substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, 120) END AS topic FROM r""",
    "flashcard_export": "WITH l AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[.\\n]'), lambda x: length(trim(x, ' ')) > 0)[1:5] AS p FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, (generate_subscripts(p, 1) - 1)::INT AS pos, substr(regexp_replace(trim(unnest(p), ' '), '\\s+', ' ', 'g'), 1, 20) AS front, regexp_replace(trim(unnest(p), ' '), '\\s+', ' ', 'g') AS back, 'review' AS tags FROM l",
}
