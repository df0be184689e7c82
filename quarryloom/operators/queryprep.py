"""Preparing queries: filters, keywords, intents, caches of answers. Whole batches of queries at once, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions.tokens import CHINESE_STOPWORDS, ENGLISH_STOPWORDS, WORD, normalised, words
from quarryloom.operators import bm25
from quarryloom.operators.evidence import INJECTIONS, filter_injection
from quarryloom.operators.retrieval import dense_search, queries_of, small
from quarryloom.sources.tables import CHUNKS_SQL, chunks, table, turns

FILTER = r"([\p{L}\p{N}_]+):(\S+)"
ALIASES = {"collection": "collection", "col": "collection", "c": "collection", "type": "doc_type", "doc_type": "doc_type", "t": "doc_type", "source": "source_path", "src": "source_path", "s": "source_path", "tag": "tags", "tags": "tags"}
#: The rules of intents, tried in this order.
CHAT = "^(你好|hi|hello|谢谢|感谢|再见|bye|帮助|help|/help)$"
ROUTES = [("general_chat", CHAT), ("quiz_request", "出题|练习|测[试验]|quiz|做题|习题|考[试题]|模拟|生成.*题|来.*道题|出.*道"), ("concept_review", "复习|总结|考点|review|归纳|梳理|重点|回顾|知识点"), ("deep_understanding", "解释|为什么|原理|详细|如何|怎[么样]|区别|对比|比较|举例|深入")]
PLANS = [
    ("general_chat", 1.0, CHAT),
    ("document_ingest", 1.0, r"导入知识库|导入.*知识库|入库|上传.*课件|上传.*资料|ingest|import|\.pdf|\.pptx"),
    ("quiz_evaluator", 1.0, "判分|评分|批改|评判|评估答案|帮我判|检查答案|我的答案是|请帮我判"),
    ("quiz_generator", 1.0, r"出题|做题|练习|习题|刷题|测验|来\s*(?:[0-9]+|[一二两三四五六七八九十])?\s*道(?:选择|填空|简答|SQL)?题|出\s*(?:[0-9]+|[一二两三四五六七八九十])?\s*道(?:选择|填空|简答|SQL)?题|生成.*题|quiz"),
    ("review_summary", 1.0, "复习|总结(?:一下)?(?:.*?(?:要点|重点))?|考点|回顾|梳理|复习摘要|复习重点|考试复习|期末复习"),
    ("knowledge_query", 0.92, "解释|讲解|说明|为什么|原理|怎么理解|如何理解|详细介绍|详细解释|介绍(?:一下)?|概述|简述|流程|讲讲|聊聊|区别|对比|比较|分析|是什么"),
]
#: From which confidence on a tool is forced or advised, and the words between the steps of a request.
FORCE, ADVISE, STEPS = 0.88, 0.72, "再|然后|接着|最后"
#: Words of requests in turns that have none; one is put behind each user turn.
REQUESTS = ["", "?", " 请解释三次握手", " 先复习第三章，然后出 5 道选择题", " 来三道填空题，难度4", " 帮我判分", " 上传 notes.pdf", " 总结考点再做题"]
#: Triggers of skills in the order in which they are tried.
TRIGGERS = [("quiz_drill", "刷题"), ("quiz_drill", "出 5 道"), ("exam_prep", "考点"), ("exam_prep", "复习"), ("concept_review", "解释"), ("grading", "判分")]
SEQUENCE = "then|finally|然后|接着|最后"


def parse_filters(query: Column) -> tuple[Column, Column]:
    """(map of filters, the query without them). The last value of a key wins; tags are joined."""
    keys, values = (F.regexp_extract_all(query, F.lit(FILTER), F.lit(k)) for k in (1, 2))
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    named = F.transform(keys, lambda k: F.coalesce(F.element_at(known, F.lower(k)), k))
    pairs = F.zip_with(named, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    joined = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(F.when((p["k"] == "tags") & F.element_at(m, "tags").isNotNull(), F.concat(F.element_at(m, "tags"), F.lit(","), p["v"])).otherwise(p["v"])))))
    return joined, F.trim(F.regexp_replace(F.regexp_replace(query, FILTER, ""), r"\s+", " "))


def keywords(query: Column, most: int = 20) -> Column:
    """Words in order as they are first written, each once whatever its case, without stop words. Runs of Chinese characters
    are words of their own."""
    # Only the letters and digits outside of Chinese continue a word.
    found = F.regexp_extract_all(query, F.lit(r"[\x{4e00}-\x{9fff}]+|[\p{L}\p{N}_&&[^\x{4e00}-\x{9fff}]][-\p{L}\p{N}_&&[^\x{4e00}-\x{9fff}]]*"), F.lit(0))
    lower = F.transform(found, F.lower)
    first = F.filter(found, lambda w, i: (F.array_position(lower, F.lower(w)) == i + 1) & ~F.lower(w).isin(*ENGLISH_STOPWORDS, *CHINESE_STOPWORDS))
    return F.slice(first, 1, most)


def match_filters(filters: dict, columns: dict[str, Column]) -> Column:
    """A predicate from equality, $eq, $in, tags overlap and part of source_path; other operators reject every row."""
    out = F.lit(True)
    for key, want in filters.items():
        c = columns[key]
        if isinstance(want, dict):
            (op, value), *more = want.items()
            test = c == F.lit(value) if op == "$eq" and not more else c.isin(*value) if op == "$in" and not more else F.lit(False)
        elif key == "tags":
            test = F.arrays_overlap(c, F.array(*map(F.lit, want)))
        else:
            test = F.contains(c, F.lit(want)) if key == "source_path" else c == F.lit(want)
        out = out & F.coalesce(test, F.lit(False))
    return out


def store_filters(tree: dict) -> Column:
    """A pushed-down predicate from $and, $or and comparisons."""
    ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v)}
    out = F.lit(True)
    for key, value in tree.items():
        if key in ("$and", "$or"):
            parts = [store_filters(x) for x in value]
            test = parts[0]
            for p in parts[1:]:
                test = test & p if key == "$and" else test | p
        elif isinstance(value, dict):
            test = F.lit(True)
            for op, v in value.items():
                test = test & ops[op](F.col(key), v)
        else:
            test = F.col(key) == value
        out = out & test
    return out


def by_rules(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    out = None
    for name, pattern in rules:
        test = text.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


#: Terms of a request, what is no term, and particles that are left out of Chinese ones.
LATIN_TERM, NOT_CHINESE, PARTICLES = r"[A-Za-z0-9_+\-]{2,}", "[^\u4e00-\u9fff]+", "的了呢吗么"
STOP_TERMS = "什么 多少 几点 哪个 哪些 为什么 为何 怎么 如何 一下 介绍 介绍一下 概述 简述 流程 原理 区别 对比 比较 讲解 说明 讲讲 讲一下 说一下 聊聊 请问 一下子 什么是 是多少".split()
EXCERPT, EXCERPT_HEAD, EXCERPT_TAIL = 420, 231, 181


def focus_terms(query: Column) -> Column:
    """Terms of a request, the longest first: its Latin words in order, then stretches of four to two Chinese characters from
    the end on; each once, whatever its case."""
    chinese = F.translate(F.regexp_replace(query, NOT_CHINESE, ""), PARTICLES, "")
    stop = F.array(*map(F.lit, STOP_TERMS))

    def stretches(n: int) -> Column:
        of = F.transform(F.sequence(F.length(chinese) - (n - 1), F.lit(1), F.lit(-1)), lambda at: F.substring(chinese, at, F.lit(n)))
        return F.when(F.length(chinese) >= n, of).otherwise(F.array().cast("array<string>"))

    found = F.concat(F.regexp_extract_all(query, F.lit(LATIN_TERM), F.lit(0)), F.filter(F.concat(*map(stretches, (4, 3, 2))), lambda t: ~F.array_contains(stop, t)))
    lowered = F.transform(found, F.lower)
    first = F.filter(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))), lambda x: F.array_position(lowered, F.lower(x["t"])) == x["i"] + 1)
    return F.transform(F.array_sort(first), lambda x: x["t"])


def excerpt(text: Column, query: Column, size: int = EXCERPT) -> Column:
    """A window around the first mention of the longest term of the request that the text has, with dots where it was cut;
    without any, its head and its tail. Injections are taken out first, line ends become blanks."""
    clean = F.trim(F.regexp_replace(filter_injection(text), r"\n", " "))
    at = lambda c, t: F.instr(F.lower(c), F.lower(t))
    found = F.transform(F.filter(focus_terms(query), lambda t: at(clean, t) > 0), lambda t: at(clean, t))
    n, begun = F.length(clean), F.greatest(F.lit(0), F.get(found, F.lit(0)) - 1 - size // 2)
    end = F.least(n, begun + size)
    start = F.greatest(F.lit(0), end - size)
    window = F.trim(F.substring(clean, start + 1, end - start))
    around = F.concat(F.when(start > 0, "...").otherwise(""), window, F.when(end < n, "...").otherwise(""))
    ends = F.concat(F.rtrim(F.substring(clean, 1, EXCERPT_HEAD)), F.lit("\n...\n"), F.ltrim(F.substring(clean, -EXCERPT_TAIL, EXCERPT_TAIL)))
    return F.when(n <= size, clean).when(F.size(found) > 0, around).otherwise(ends)


#: Requests that follow on what was said, those that can be answered at once, and those that cannot.
FOLLOWS = "^(它|这个|那个|这些|那些|上面|前面|这里|那里|继续|再|然后|接着|那|其|该|这种|这一步|下一步|为什么|怎么|如何|过程呢|区别呢)"
FOLLOWS_ANYWHERE = "(它|这个|那个|上面|前面|继续讲|继续说|再讲讲|再说说|展开讲|详细讲|过程呢|原理呢|区别呢)"
FAST = "(解释|讲解|说明|介绍|介绍一下|概述|简述|流程|为什么|原理|区别|对比|比较|是什么|讲讲|讲一下|说一下|聊聊)"
SLOW = "(总结|复习|考点|出题|练习|判分|批改|评估|生成|整理|梳理|同时|并且|以及|然后|先.*再|结合)"
SHORT_FOLLOW, SHORT_PARTICLE, SHORT_FAST = 14, 32, 48


def flags(query: Column, earlier: Column) -> tuple[Column, Column]:
    """(needs rewriting, can be answered at once). Only a request with messages before it can follow on them: a short one
    without a word for what is wanted, one that points back, or a short one that ends in a particle."""
    q = F.trim(F.regexp_replace(query, r"\s+", " "))
    follows = ((F.length(q) > 0) & (F.length(q) <= SHORT_FOLLOW) & ~q.rlike(FAST)) | q.rlike(FOLLOWS) | q.rlike(FOLLOWS_ANYWHERE) | (q.rlike("[呢吗么]$") & (F.length(q) <= SHORT_PARTICLE))
    rewrite = (earlier > 0) & follows
    hints = F.regexp_replace(q, "结合知识库|结合课件", "")
    fast = (F.length(q) > 0) & (F.length(q) <= SHORT_FAST) & ~rewrite & ~hints.rlike(SLOW) & (q.rlike(FAST) | q.rlike("[?？]$"))
    return rewrite, fast


# --- queries ---------------------------------------------------------------------------------------------------------


def user_turns(spark, d) -> DataFrame:
    return turns(spark, d).where("role = 'user'")


def _filtered_queries(spark, d):
    """Items as queries with filters in front, of kinds that depend on the id."""
    head = F.element_at(F.array(F.lit("collection:api c:web "), F.lit("type:pdf tag:x,y TAGS:z "), F.lit("Src:/data lang:en "), F.lit("")), (F.pmod("query_id", F.lit(4)) + 1).cast("int"))
    return queries_of(spark, d).withColumn("query", F.concat(head, F.col("query")))


def parse_query_filters(spark, d):
    found, rest = parse_filters(F.col("query"))
    return _filtered_queries(spark, d).select("query_id", F.array_join(F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("filters"), rest.alias("rest"))


def merge_filters(spark, d):
    """Filters given with the call over those parsed from the query."""
    found, _ = parse_filters(F.col("query"))
    given = F.create_map(F.lit("collection"), F.lit("given"))
    merged = F.map_concat(F.map_filter(found, lambda k, _: ~F.map_contains_key(given, k)), given)
    return _filtered_queries(spark, d).select("query_id", F.element_at(merged, "collection").alias("collection"), F.size(merged).alias("n_filters"))


#: Fixed value: how like a question has to be to one that was answered before, as a cosine.
CACHE_SIMILARITY = 0.92
#: The vectors at hand are random, their nearest entries at 0.2 to 0.4.
CACHE_SIMILARITY_HERE = 0.25


def semantic_cache(spark, d, least: float = CACHE_SIMILARITY):
    """Vectors divisible by 20 ask; the others are cached answers with the time of the event of the same number. A hit is the
    most similar entry of the same label that is not older than the newest event less a month, if its cosine is `least`
    or more. Entries that are too old or of another label are out before any is compared."""
    v = table(spark, d, "embeddings")
    ev = table(spark, d, "events").select(F.col("event_id").alias("vec_id"), F.col("ts").cast("timestamp").alias("at"))
    now = table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 30 DAYS")).alias("oldest"))
    # The newest time is one row.
    entries = v.where("vec_id % 20 <> 0").join(ev, "vec_id").join(F.broadcast(now)).where("at >= oldest").select(*v.columns)
    asking = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    best = dense_search(asking, entries, 1, group="label").where(2 * F.col("score") - 1 >= least).select("query_id", F.col("doc_id").alias("entry"), "score")
    return asking.select("query_id").join(best, "query_id", "left").select("query_id", "entry", "score", F.col("entry").isNotNull().alias("hit"))


def cache_evict(spark, d, keep: int = 500, invalid: str = "error"):
    """Events as uses of cache entries (their kind and their value in tens): the entries of one collection are invalidated,
    and of the others the most recently used stay. An entry's first use was a miss, the others were hits."""
    e = table(spark, d, "events").select(F.col("event_type").alias("collection"), F.floor(F.col("value") * 10).alias("entry"), "ts")
    used = e.where(F.col("collection") != invalid).groupBy("collection", "entry").agg(F.max("ts").alias("last_use"), F.count("*").alias("uses"))
    newest = [F.desc("last_use"), "collection", "entry"]
    rank = F.row_number().over(Window.partitionBy(F.pmod("entry", F.lit(8))).orderBy(*newest))
    # The newest of each eighth hold the newest of all, so the last ranking sees a bounded number of rows.
    first = used.withColumn("n", rank).where(F.col("n") <= keep).drop("n")
    return first.orderBy(*newest).limit(keep).select("collection", "entry", (F.col("uses") - 1).alias("hits"), F.lit(1).alias("misses"))


def similar_questions(spark, d, most: int = 3):
    """For each last user turn, the earlier turns of users (same number modulo five) that share most words with it."""
    q = user_turns(spark, d).select("conv_id", "turn", words(F.col("text")).alias("w"), F.pmod("conv_id", F.lit(5)).alias("user"))
    recent = Window.partitionBy("user").orderBy(F.desc("conv_id"), F.desc("turn"))
    numbered = q.withColumn("n", F.row_number().over(recent)).where("n <= 101")
    last = numbered.where("n = 1").select("user", F.col("w").alias("qw"))
    scored = numbered.where("n > 1").join(last, "user").select("user", "conv_id", "turn", F.size(F.array_intersect("w", "qw")).alias("overlap")).where("overlap > 0")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("overlap"), "conv_id", "turn"))).where(F.col("rank") <= most)


def search_sessions(spark, d, most: int = 5):
    """Conversations by how many of the words of a query they contain. Every conversation whose number is divisible by 20
    asks with the whole of its first turn; its own place is left out."""
    t = turns(spark, d)
    asked = t.where("conv_id % 20 = 0").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query")).select(F.col("conv_id").alias("query_id"), "query")
    index = bm25.forward(t.groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), doc_id="conv_id", tokens=words)
    found = bm25.search(asked, index, most + 1, tokens=words, weigh=False).where("doc_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= most).select("query_id", F.col("doc_id").alias("conv_id"), F.col("score").cast("long").alias("hits"), "rank")


def requests(spark, d) -> DataFrame:
    """User turns with a request behind them that depends on their place."""
    tail = F.element_at(F.array(*map(F.lit, REQUESTS)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(REQUESTS))) + 1).cast("int"))
    return user_turns(spark, d).withColumn("text", F.concat("text", tail))


_REQ = "req AS (SELECT conv_id, turn, text || CASE (conv_id + turn) % " + str(len(REQUESTS)) + " " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REQUESTS)) + " END AS text FROM conversations WHERE role = 'user')"


def planned(text: Column) -> tuple[Column, Column]:
    """(intent, confidence) of a message: the first rule that fits, else a question, else chat."""
    asks = text.rlike("[?？]")
    return by_rules(F.trim(text), [(n, p) for n, _, p in PLANS], F.when(asks, "knowledge_query").otherwise("general_chat")), by_rules(F.trim(text), [(str(c), p) for _, c, p in PLANS], F.when(asks, "0.55").otherwise("0.0")).cast("double")


def plan_task(spark, d) -> DataFrame:
    """The intent of each request, how sure it is, what that means for tools, and the intents of its steps: where a word for
    the next step parts a request into two or more tasks, chat left out, it is composite."""
    intent, confidence = planned(F.col("text"))
    mode = F.when(F.col("intent") == "general_chat", "pass_through").when(F.col("intent") == "knowledge_query", "advisory").when(F.col("confidence") >= FORCE, "force_tool").when(F.col("confidence") >= ADVISE, "advisory").otherwise("pass_through")
    segments = F.filter(F.transform(F.split("text", STEPS), F.trim), lambda x: F.length(x) > 0)
    steps = F.filter(F.transform(segments, lambda x: planned(x)[0]), lambda x: x != "general_chat")
    out = requests(spark, d).select("conv_id", "turn", intent.alias("intent"), confidence.alias("confidence"), steps.alias("s")).withColumn("mode", mode)
    return out.select("conv_id", "turn", "intent", "confidence", "mode", F.when(F.size("s") > 1, F.array_join("s", ">")).otherwise("").alias("steps"))


def match_skill(spark, d):
    """The skill of the first trigger, in their order, that a request contains in lower case."""
    table_ = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TRIGGERS)], "place int, skill string, trigger string")
    t = requests(spark, d)
    # The triggers are a few rows.
    hit = t.join(F.broadcast(table_), F.contains(F.lower(t.text), F.lower("trigger"))).groupBy("conv_id", "turn").agg(F.min_by("skill", "place").alias("skill"))
    return t.select("conv_id", "turn").join(hit, ["conv_id", "turn"], "left")


def split_sequence(spark, d):
    """Turns cut where a word says that something comes next."""
    parts = F.transform(F.split(F.regexp_replace("text", r"\. ", " then "), f"(?:{SEQUENCE})"), lambda p: F.trim(p))
    return user_turns(spark, d).select("conv_id", "turn", F.posexplode(F.filter(parts, lambda p: F.length(p) > 0)).alias("pos", "segment"))


#: What users ask by their place in the conversation; every seventh asks with their own words.
MESSAGES = ["解释 TCP 的流程", "它呢", "继续讲", "总结一下考点", "Is UDP faster?", "先讲 TCP 再讲 UDP?"]


def query_flags(spark, d):
    before = F.count("*").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    place = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(7))
    said = F.coalesce(F.get(F.array(*map(F.lit, MESSAGES)), place.cast("int")), F.col("text"))
    t = turns(spark, d).withColumn("before", before).where("role = 'user'").withColumn("text", said)
    rewrite, fast = flags(F.col("text"), F.col("before"))
    return t.select("conv_id", "turn", rewrite.alias("needs_rewrite"), fast.alias("fast_path"))


def focus_excerpt(spark, d):
    """Documents in the windows around what the item with the same number asks for; documents without one are asked for by
    their source."""
    q = queries_of(spark, d).select(F.col("query_id").alias("doc_id"), "query")
    return table(spark, d, "documents").join(small(q), "doc_id", "left").select("doc_id", excerpt(F.col("text"), F.coalesce("query", "source")).alias("excerpt"))


def route_by_vector(spark, d, least: float = 0.75):
    """Vectors whose id ends in 0 against the mean vector of each label."""
    v = table(spark, d, "embeddings")
    proto = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    q = v.where("vec_id % 10 = 0").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    dot = q.join(small(proto), "i").groupBy("vec_id", "label").agg(F.sum(F.col("x") * F.col("m")).alias("xy"), F.sum(F.col("x").cast("double") * F.col("x")).alias("xx"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    sim = F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("mm")), 6)
    best = dot.withColumn("sim", sim).groupBy("vec_id").agg(F.max_by("label", F.struct("sim", -F.col("label"))).alias("label"), F.max("sim").alias("sim"))
    return best.select("vec_id", F.when(F.col("sim") >= least, F.col("label")).otherwise(-1).alias("label"), "sim")


def session_topics(spark, d) -> DataFrame:
    """The topics of each conversation: the words of its user's turns of more than five letters."""
    return user_turns(spark, d).select("conv_id", F.explode(F.filter(words(F.col("text")), lambda w: F.length(w) > 5)).alias("topic")).distinct()


def topic_counts(spark, d):
    """Conversations with each of the ten most common topics."""
    return session_topics(spark, d).groupBy("topic").agg(F.count("*").alias("sessions"), F.max("conv_id").alias("last_conv")).orderBy(F.desc("sessions"), "topic").limit(10)


def topic_history(spark, d, most: int = 10):
    """The newest ten sessions of each user (number modulo five) in which a topic came up that contains the one asked for,
    whatever its case; asked for are the first six letters, in upper case, of the ten most common topics."""
    has = session_topics(spark, d)
    asked = topic_counts(spark, d).select(F.upper(F.substring("topic", 1, 6)).alias("asked")).distinct()
    # At most ten rows.
    found = has.join(F.broadcast(asked), F.contains(F.lower("topic"), F.lower("asked"))).select("asked", "conv_id", F.pmod("conv_id", F.lit(5)).alias("user")).distinct()
    place = F.row_number().over(Window.partitionBy("user", "asked").orderBy(F.desc("conv_id")))
    return found.withColumn("place", place).where(F.col("place") <= most)


QUERIES = {
    "parse_query_filters": parse_query_filters,
    "query_keywords": lambda s, d: queries_of(s, d).select("query_id", F.array_join(keywords(F.col("query")), " ").alias("keywords")),
    "match_filters": lambda s, d: chunks(s, d).where(match_filters({"source_path": "src1", "lang": {"$in": ["en", "de"]}, "source_type": {"$eq": "slide"}, "tags": ["en", "x"]}, {"source_path": F.col("source_path"), "lang": F.col("lang"), "source_type": F.col("source_type"), "tags": F.array("lang", "source")})).select("doc_id", "source_path"),
    "store_filters": lambda s, d: table(s, d, "documents").where(store_filters({"$or": [{"$and": [{"lang": "en"}, {"n_chars": {"$gte": 500, "$lt": 3000}}]}, {"source": {"$in": ["src3", "src4"]}}], "doc_id": {"$ne": 7}})).select("doc_id", "lang", "source", "n_chars"),
    "merge_filters": merge_filters,
    "route_intent": lambda s, d: turns(s, d).select("conv_id", "turn", by_rules(F.col("text"), ROUTES, F.lit("deep_understanding")).alias("intent")),
    "route_by_vector": route_by_vector,
    "plan_task": plan_task,
    "split_sequence": split_sequence,
    "match_skill": match_skill,
    "focus_excerpt": focus_excerpt,
    "query_flags": query_flags,
    "semantic_cache_lookup": lambda s, d: semantic_cache(s, d, CACHE_SIMILARITY_HERE),
    "cache_evict": cache_evict,
    "cache_exact_key": lambda s, d: table(s, d, "documents").groupBy(F.md5(normalised(F.col("text")).cast("binary")).alias("key")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("first_doc")).where("uses > 1"),
    "similar_questions": similar_questions,
    "search_sessions": search_sessions,
    "topic_history": topic_history,
    "topic_counts": topic_counts,
    "recent_sessions": lambda s, d: turns(s, d).groupBy(F.pmod("conv_id", F.lit(5)).alias("user"), "conv_id").agg(F.count("*").alias("n_turns")).withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("conv_id")))).where("rank <= 5"),
}
_STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)
_FQ = "fq AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'collection:api c:web ' WHEN 1 THEN 'type:pdf tag:x,y TAGS:z ' WHEN 2 THEN 'Src:/data lang:en ' ELSE '' END AS head, text FROM benchmark)"


def _rules_sql(rules, default, text="text") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){p}') THEN '{n}'" for n, p in rules) + f" ELSE {default} END"


def _plan_sql(text: str, what: int) -> str:
    asks = f"CASE WHEN regexp_matches({text}, '[?？]') THEN '{('knowledge_query', '0.55')[what]}' ELSE '{('general_chat', '0.0')[what]}' END"
    return _rules_sql([((n, str(c))[what], p) for n, c, p in PLANS], asks, f"trim({text}, ' ')")


_FILTERED = "substr(d.text, 1, 2000)"
for _p in INJECTIONS:
    _FILTERED = f"regexp_replace({_FILTERED}, '{_p}', '[FILTERED]', 'gi')"
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))"
ORACLE = {
    "parse_query_filters": f"WITH {_FQ} SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'collection=web' WHEN 1 THEN 'doc_type=pdf;tags=x,y,z' WHEN 2 THEN 'lang=en;source_path=/data' ELSE '' END AS filters, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM fq",
    "query_keywords": f"WITH k AS (SELECT item_id AS query_id, i, w0, w, row_number() OVER (PARTITION BY item_id, w ORDER BY i) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+[-\\p{{L}}\\p{{N}}_]*')) AS w0, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+[-\\p{{L}}\\p{{N}}_]*'), 1) AS i, lower(w0) AS w FROM benchmark) WHERE w NOT IN ({_STOP})) SELECT b.item_id AS query_id, coalesce(ks, '') AS keywords FROM benchmark b LEFT JOIN (SELECT query_id, array_to_string(list(w0 ORDER BY i)[1:20], ' ') AS ks FROM k WHERE n = 1 GROUP BY query_id) x ON x.query_id = b.item_id",
    "match_filters": f"WITH {CHUNKS_SQL} SELECT doc_id, source_path FROM chunks WHERE contains(source_path, 'src1') AND lang = 'en' AND source_type = 'slide'",
    "store_filters": "SELECT doc_id, lang, source, n_chars FROM documents WHERE ((lang = 'en' AND n_chars >= 500 AND n_chars < 3000) OR source IN ('src3', 'src4')) AND doc_id <> 7",
    "merge_filters": "SELECT item_id AS query_id, 'given' AS collection, CASE item_id % 4 WHEN 0 THEN 1 WHEN 3 THEN 1 ELSE 3 END AS n_filters FROM benchmark",
    "route_intent": f"SELECT conv_id, turn, {_rules_sql(ROUTES, repr('deep_understanding'))} AS intent FROM conversations",
    "route_by_vector": "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), p AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), s AS (SELECT e.vec_id, p.label, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS sim FROM e JOIN p ON p.i = e.i WHERE vec_id % 10 = 0 GROUP BY ALL) SELECT vec_id, CASE WHEN sim >= 0.75 THEN label ELSE -1 END AS label, sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1",
    "plan_task": f"""WITH {_REQ}, p AS (SELECT conv_id, turn, {_plan_sql('text', 0)} AS intent, ({_plan_sql('text', 1)})::DOUBLE AS confidence, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '{STEPS}'), lambda x: trim(x, ' ')), lambda x: length(x) > 0), lambda x: {_plan_sql('x', 0)}), lambda x: x <> 'general_chat') AS s FROM req)
SELECT conv_id, turn, intent, confidence, CASE WHEN intent = 'general_chat' THEN 'pass_through' WHEN intent = 'knowledge_query' THEN 'advisory' WHEN confidence >= {FORCE} THEN 'force_tool' WHEN confidence >= {ADVISE} THEN 'advisory' ELSE 'pass_through' END AS mode, CASE WHEN len(s) > 1 THEN array_to_string(s, '>') ELSE '' END AS steps FROM p""",
    "split_sequence": f"WITH s AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', ' then '), '{SEQUENCE}'), lambda x: trim(x, ' ')), lambda x: length(x) > 0) AS p FROM conversations WHERE role = 'user') SELECT conv_id, turn, (generate_subscripts(p, 1) - 1)::INT AS pos, unnest(p) AS segment FROM s",
    "match_skill": f"WITH {_REQ} SELECT conv_id, turn, CASE {' '.join(f"WHEN contains(lower(text), '{t.lower()}') THEN '{k}'" for k, t in TRIGGERS)} END AS skill FROM req",
    "focus_excerpt": f"""WITH t AS (SELECT d.doc_id, trim(replace({_FILTERED}, chr(10), ' '), ' ') AS c, regexp_extract_all(coalesce(b.text, d.source), '{LATIN_TERM}') AS q FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id),
w AS (SELECT doc_id, c, instr(lower(c), lower(x)) AS pos, length(x) AS n, i FROM (SELECT doc_id, c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM t)),
f AS (SELECT doc_id, pos FROM w WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
s AS (SELECT t.doc_id, c, pos, least(length(c), greatest(0, pos - 211) + 420) AS stop FROM t LEFT JOIN f ON f.doc_id = t.doc_id)
SELECT doc_id, CASE WHEN length(c) <= 420 THEN c WHEN pos IS NOT NULL THEN CASE WHEN stop > 420 THEN '...' ELSE '' END || trim(substr(c, greatest(0, stop - 420) + 1, 420), ' ') || CASE WHEN stop < length(c) THEN '...' ELSE '' END
 ELSE rtrim(substr(c, 1, 231), ' ') || chr(10) || '...' || chr(10) || ltrim(right(c, 181), ' ') END AS excerpt FROM s""",
    "query_flags": f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations),
q AS (SELECT conv_id, turn, before, trim(regexp_replace(CASE (conv_id * 3 + turn) % 7 {' '.join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES))} ELSE text END, '\\s+', ' ', 'g'), ' ') AS q FROM t WHERE role = 'user'),
r AS (SELECT *, before > 0 AND ((length(q) BETWEEN 1 AND 14 AND NOT regexp_matches(q, '{FAST}')) OR regexp_matches(q, '{FOLLOWS}') OR regexp_matches(q, '{FOLLOWS_ANYWHERE}') OR (length(q) <= 32 AND right(q, 1) IN ('呢', '吗', '么'))) AS needs_rewrite FROM q)
SELECT conv_id, turn, needs_rewrite, length(q) BETWEEN 1 AND 48 AND NOT needs_rewrite AND NOT regexp_matches(replace(replace(q, '结合知识库', ''), '结合课件', ''), '{SLOW}') AND (regexp_matches(q, '{FAST}') OR right(q, 1) IN ('?', '？')) AS fast_path FROM r""",
    "semantic_cache_lookup": f"WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), h AS (SELECT q.vec_id AS query_id, e.vec_id AS entry, round(greatest(0.0, (1 + list_cosine_similarity(q.v, e.v)) / 2), 6) AS score FROM u q JOIN u e ON e.label = q.label JOIN events n ON n.event_id = e.vec_id WHERE q.vec_id % 20 = 0 AND e.vec_id % 20 <> 0 AND n.ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) = 1) SELECT vec_id AS query_id, entry, score, entry IS NOT NULL AS hit FROM embeddings LEFT JOIN (SELECT * FROM h WHERE 2 * score - 1 >= {CACHE_SIMILARITY_HERE}) h ON h.query_id = vec_id WHERE vec_id % 20 = 0",
    "cache_evict": "SELECT event_type AS collection, floor(value * 10)::BIGINT AS entry, count(*) - 1 AS hits, 1 AS misses FROM events WHERE event_type <> 'error' GROUP BY 1, 2 ORDER BY max(ts) DESC, 1, 2 LIMIT 500",
    "cache_exact_key": "SELECT md5(trim(lower(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, count(*) AS uses, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "similar_questions": f"WITH q AS (SELECT conv_id, turn, {_WORDS} AS w, conv_id % 5 AS user, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id DESC, turn DESC) AS n FROM conversations WHERE role = 'user'), s AS (SELECT a.user, a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS overlap FROM q a JOIN q b ON a.user = b.user AND b.n = 1 WHERE a.n BETWEEN 2 AND 101) SELECT user, conv_id, turn, overlap, row_number() OVER (PARTITION BY user ORDER BY overlap DESC, conv_id, turn) AS rank FROM s WHERE overlap > 0 QUALIFY rank <= 3",
    "search_sessions": "WITH f AS (SELECT conv_id, unnest(list_distinct(regexp_extract_all(lower(min_by(text, turn)), '[\\p{L}\\p{N}_]+'))) AS word FROM conversations WHERE conv_id % 20 = 0 GROUP BY conv_id), has AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations), h AS (SELECT f.conv_id AS query_id, has.conv_id, count(*) AS hits FROM has JOIN f ON f.word = has.word WHERE f.conv_id <> has.conv_id GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, conv_id) AS rank FROM h QUALIFY rank <= 5",
    "topic_history": "WITH h AS (SELECT DISTINCT conv_id, topic FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS topic FROM conversations WHERE role = 'user') WHERE length(topic) > 5), a AS (SELECT DISTINCT upper(substr(topic, 1, 6)) AS asked FROM (SELECT topic FROM h GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 10)), f AS (SELECT DISTINCT asked, conv_id, conv_id % 5 AS user FROM h JOIN a ON contains(topic, lower(asked))) SELECT *, row_number() OVER (PARTITION BY user, asked ORDER BY conv_id DESC) AS place FROM f QUALIFY place <= 10",
    "topic_counts": "SELECT topic, count(DISTINCT conv_id) AS sessions, max(conv_id) AS last_conv FROM (SELECT conv_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS topic FROM conversations WHERE role = 'user') WHERE length(topic) > 5 GROUP BY topic ORDER BY sessions DESC, topic LIMIT 10",
    "recent_sessions": "SELECT conv_id % 5 AS user, conv_id, count(*) AS n_turns, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY conv_id DESC) AS rank FROM conversations GROUP BY conv_id QUALIFY rank <= 5",
}
