import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from quarryloom.llm import bpe, decontaminate, html_text, license_scan, near_dedup, quality, suffix_dedup, toxicity, url_rules, warc
from quarryloom.llm.storage import file_row, saved, temporary
from tests.llm import brute


def table(spark, tmp_path, rows, schema, parts=3):
    path = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def texts():
    return list(pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text) + [None, "", " \n\t ", "a" * 1500, "ab" * 600, "x y " * 30, "same text here\n" * 3, "same text here\n" * 3]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    """Documents with nulls, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "mine", 0.5) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "a text without id " * 40, None, None, None, None, None)]
    return table(spark, tmp_path_factory.mktemp("d"), rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")


def empty(docs):
    return docs.where("false").persist()


def test_bpe(spark, docs, texts):
    enc = bpe.encoding(*bpe.public_ranks())
    for size in (65536, 100):
        got = bpe.encode(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), *bpe.public_ranks(), chunk_chars=size, overlap_chars=20, with_decoded=True).toPandas()
        assert len(got) == len(texts)
        for i, ids, back in zip(got.doc_id, got.ids, got.decoded, strict=True):
            want = enc.encode_ordinary(texts[i] or "")
            assert bytes(ids) == np.asarray(want, "<u4").tobytes()
            assert bytes(back) == (texts[i] or "").encode()
    assert bpe.encode(empty(docs), *bpe.public_ranks()).count() == 0
    assert bpe.encode(docs, *bpe.public_ranks()).count() == len(texts) + 2


@pytest.mark.parametrize("middle", [" ", "\n", "a", "\u3000\t"])
def test_bpe_of_very_long_runs(spark, middle):
    """A run without a boundary, far longer than the stack of the library's pattern allows."""
    long = middle * (2_000_000 // len(middle))
    texts = ["x " + long + "y", long, "one two\n" * 10000 + long + " z"]
    enc = bpe.encoding(*bpe.public_ranks())
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *bpe.public_ranks(), with_decoded=True).collect()}
    for i, t in enumerate(texts):
        want = [x for m in regex.finditer(bpe.public_ranks()[1], t) for x in enc._encode_single_piece(m.group())]
        assert bytes(got[i].ids) == np.asarray(want, "<u4").tobytes() and bytes(got[i].decoded) == t.encode()


def test_bpe_pre_tokens_one_by_one_are_those_of_the_library(monkeypatch, texts):
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 0)
    enc = bpe.encoding(*bpe.public_ranks())
    for t in [*filter(None, texts), " " * 5000 + "x", "\n\n x  " * 50, "don't  \t'll"]:
        assert bpe.whole_piece_ids(enc, bpe.public_ranks()[1], t) == enc.encode_ordinary(t)


def test_stitch_needs_a_common_boundary():
    assert bpe.stitch([(0, [], [90, 95]), (100, [93, 95], [])], 200) == [0, 95, 200]
    assert bpe.stitch([(0, [], [90]), (100, [93], [])], 200) == [0, 200]
    assert bpe.boundaries("a  b", bpe.public_ranks()[1]) == [1, 4]


def test_decontamination_small_alphabet(spark, tmp_path):
    random.seed(3)
    items = [(k, " ".join(random.choice("a b c".split()) for _ in range(random.randint(0, 9)))) for k in range(12)] + [(99, None), (None, "a b c a b"), (3, "B A c")]
    rows = [(k, " ".join(random.choice("a b C d".split()) for _ in range(random.randint(0, 40)))) for k in range(100)] + [(200, None), (201, ""), (7, "a b c")]
    d, i = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(zip([r[0] for r in rows], brute.contamination([t for _, t in rows], items, 5), strict=True), key=str)
    for block in (10**6, 100):
        got = decontaminate.judged(d, i, window=5, block_chars=block).collect()
        assert sorted([(r.doc_id, (r.n_words, r.n_hit, list(r["items"]))) for r in got], key=str) == want
    assert decontaminate.judged(d.where("false"), i).count() == 0
    assert decontaminate.judged(d, i.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_spans_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d = spark.createDataFrame([(1, f"Ä start. {item.title()}! The end", "k"), (2, "clean text", "k"), (3, None, "k")], "doc_id long, text string, items string")
    i = spark.createDataFrame([(5, item)], "item_id long, text string")
    found = decontaminate.find(d, i).orderBy("doc_id").collect()
    span = found[0]["spans"][0]
    assert (span.first_word, span.end_word, list(found[0]["items"])) == (2, 16, [5])
    cut = {r.doc_id: r.text for r in decontaminate.remove(d, i).collect()}
    assert cut == {1: "Ä start. ! The end", 2: "clean text", 3: None}
    assert [r.doc_id for r in decontaminate.remove(d, i, drop_above=0.5).orderBy("doc_id").collect()] == [2, 3]


@pytest.mark.parametrize("options", [{}, {"hot_runs": 2, "pieces": (8, 3)}, {"hot_runs": 1, "pieces": (5,)}])
@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_dedup(spark, tmp_path, options, keep):
    random.seed(5)
    base = ["".join(random.choice("abcdefgh") for _ in range(300)) for _ in range(6)]
    rows = []
    for _ in range(100):
        t = "".join(random.choice(["abc", "x", "yÿ"]) * random.randint(0, 9) for _ in range(20))
        for _ in range(random.randint(0, 3)):
            b, i = random.choice(base), random.randint(0, 200)
            t += b[i : i + random.randint(0, 100)] + "".join(random.choice("abcd") for _ in range(random.randint(0, 30)))
        rows.append(t)
    rows += [None, "", "q" * 200, "qr" * 100]
    d = table(spark, tmp_path, list(enumerate(rows)), "doc_id long, text string")
    got = suffix_dedup.dedup(d, columns=["doc_id"], keep=keep, length=60, **options).toPandas().set_index("doc_id")
    data, flags = brute.removed(rows, 60, keep == "first")
    assert len(got) == len(rows)
    for i, (b, f) in enumerate(zip(data, flags, strict=True)):
        assert bytes(got.kept[i]) == bytes(x for x, m in zip(b, f, strict=True) if not m)
        assert got.n_removed[i] == sum(f)


def test_suffix_dedup_when_file_splits_change(spark, tmp_path, monkeypatch):
    """Splits that differ between jobs, as with executors that come late, move no range to another text."""
    random.seed(6)
    rows = ["".join(random.choice("abcdefgh") for _ in range(random.randint(200, 900))) for _ in range(60)]
    rows += [random.choice(rows)[:150] + "".join(random.choice("xyz") for _ in range(100)) for _ in range(60)]
    d = table(spark, tmp_path, list(enumerate(rows)), "doc_id long, text string", parts=9)
    name, saved = "spark.sql.files.maxPartitionBytes", suffix_dedup.saved
    before = spark.conf.get(name)
    monkeypatch.setattr(suffix_dedup, "saved", lambda *a: (saved(*a), spark.conf.set(name, "2k"))[0])
    try:
        got = suffix_dedup.dedup(d, columns=["doc_id"], keep="none", length=60).toPandas().set_index("doc_id")
    finally:
        spark.conf.set(name, before)
    data, flags = brute.removed(rows, 60, False)
    for i, (b, f) in enumerate(zip(data, flags, strict=True)):
        assert bytes(got.kept[i]) == bytes(x for x, m in zip(b, f, strict=True) if not m)


def passage_rows():
    """Texts with passages of 30 to 150 words shared among some of them, and within one."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 50, 51, 55, 60, 80, 100, 150)]
    rows = [" ".join([" ".join(word() for _ in range(40)), *([random.choice(passages)] if k % 3 else []), " ".join(word() for _ in range(40))]) for k in range(90)]
    return rows + [f"{passages[3]} {word()} {passages[3]}", passages[4], None, "", rows[0], rows[1]]


def test_registered_suffix_dedup(spark, tmp_path):
    """op4 at its own lengths over several files, with splits that change between building and running it."""
    rows = passage_rows()
    table(spark, tmp_path, list(enumerate(rows)), "doc_id long, text string", parts=7).write.parquet(f"{tmp_path}/sf/documents.parquet")
    query = suffix_dedup.op4_suffix_dedup(spark, f"{tmp_path}/sf")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        got = {r.doc_id: r for r in query.collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    data, flags = brute.removed(rows, 400, False)
    assert len(got) == len(rows) and any(map(any, flags))
    for i, (b, f) in enumerate(zip(data, flags, strict=True)):
        kept = bytes(x for x, m in zip(b, f, strict=True) if not m)
        spans = sum(1 for k, x in enumerate(f) if x and not (k and f[k - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(f), spans, hashlib.sha256(kept).hexdigest())
    assert [got[i].n_passages for i in range(len(rows))] == list(map(len, brute.repeated_words(rows, 51, False)[1]))


@pytest.mark.parametrize("options", [{}, {"hot_runs": 2, "pieces": (8, 3)}, {"hot_runs": 1, "pieces": (5,)}])
@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_dedup_of_whole_words(spark, tmp_path, keep, options):
    """Passages are told by their words, whatever stands between these and however short they are."""
    random.seed(8)
    rows = passage_rows()
    base = [[random.choice("a b cc ÿ to".split()) for _ in range(120)] for _ in range(4)]
    for _ in range(60):
        words = [random.choice("abcdefghijklm") for _ in range(random.randint(0, 30))]
        for _ in range(random.randint(0, 2)):
            k = random.randint(0, 100)
            words += random.choice(base)[k : k + random.randint(0, 90)] + [random.choice("uvwxyz") for _ in range(random.randint(0, 9))]
        rows.append("".join(w + random.choice([" ", "\n", " \t "]) for w in words))
    rows += ["to " * 80, "to " * 50, "to " * 51, " ".join(f"{'x' * 90}{k}" for k in range(50))] * 2
    d = table(spark, tmp_path, list(enumerate(rows)), "doc_id long, text string", parts=5)
    for words in (51, 9):
        got = {r.doc_id: r for r in suffix_dedup.dedup(d, row=file_row(), length=words, by_words=True, as_text=True, keep=keep, **options).collect()}
        for i, (b, spans) in enumerate(zip(*brute.repeated_words(rows, words, keep == "first"), strict=True)):
            assert got[i].kept == b"".join(b[x:y] for x, y in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(b)], strict=True)).decode()
            assert [(s.start, s.end) for s in got[i].spans] == spans


def test_tables_of_two_threads_stay_apart(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2)

    def work(k):
        with temporary(spark) as keep:
            meet.wait()
            mine, kept = saved(spark.range(k), "mine"), keep(spark.range(k + 10), "kept")
            meet.wait()
            if k == 2:
                counts = mine.count(), kept.count()
        meet.wait()
        if k == 1:
            counts = None, kept.count()
        return counts

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(work, (1, 2))) == [(None, 11), (2, 12)]


def test_suffix_dedup_documents(spark, docs, texts):
    got = suffix_dedup.dedup(docs, columns=["doc_id", "kept", "score"], as_text=True)
    assert got.count() == len(texts) + 2
    assert suffix_dedup.dedup(empty(docs)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeated(docs, keep="last")


def test_near_dedup(spark, docs, texts):
    got = near_dedup.mark(docs, words=4).toPandas()
    want = brute.components(list(range(len(texts))), texts, 4, 80)
    assert len(got) == len(texts) + 2
    for r in got.dropna(subset="doc_id").itertuples():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.component_id == r.doc_id)
    assert got[got.doc_id.isna()].kept.all()
    assert near_dedup.mark(empty(docs)).count() == 0


def test_near_dedup_keeps_one_of_each(spark, docs, texts):
    ids = [r.doc_id for r in near_dedup.dedup(docs).collect()]
    want = {c for _, c in brute.components(list(range(len(texts))), texts, 5, 80).values()}
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_near_dedup_sends_no_growing_table_to_the_driver(spark, docs):
    """Whatever size Spark takes its tables for, only bitmaps and the sizes of families are broadcast."""
    history = spark._jsparkSession.sharedState().statusStore()
    before = history.executionsCount()
    near_dedup.dedup(docs, words=4, small=2).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = history.executionsList(before, 10_000)
    plans = [ran.apply(k).physicalPlanDescription() for k in range(ran.size())]
    keys = {re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[([^\n]*)\]", p)}
    assert any("SortMergeJoin" in p for p in plans) and "_word" in keys and keys <= {"_word", "centre"}


def test_near_dedup_large_family(spark, tmp_path):
    """More near copies than a node may hold, so that centres and blocks do the work."""
    random.seed(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(random.choice([0, 1, 2, 4, 6])):
            t[random.randrange(120)] = f"n{random.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    rows.append((500, " ".join(f"z{k}" for k in range(50))))
    got = near_dedup.mark(table(spark, tmp_path, rows, "doc_id long, text string"), words=4, small=4, last_depth=4).toPandas().set_index("doc_id")
    want = brute.components([i for i, _ in rows], [t for _, t in rows], 4, 80)
    assert all(got.component_id[i] == c for i, (_, c) in want.items())


def test_packed_sets_survive():
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    back = near_dedup.unpacked(near_dedup.packed(h))
    assert (back >> np.uint64(16) == h >> np.uint64(16)).all() and len(near_dedup.packed(h)) == 300


def test_quality(spark, docs, texts):
    trusted = spark.createDataFrame([(i,) for i in range(0, 60)] + [(None,), (3,)], "doc_id long")
    got = quality.judge(docs, trusted).where("doc_id IS NOT NULL").toPandas()
    assert len(got) == len(texts) + 1
    for r in got.itertuples():
        n, chars, symbols, lines, repeats = want = brute.quality(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.kept and r.base_failed)
    assert quality.judge(empty(docs), trusted).count() == 0
    alone = quality.judge(docs, trusted.where("false")).toPandas()
    assert (alone.kept == ~alone.base_failed).all()


def test_quality_drops_what_the_target_lacks(spark):
    good = [(i, "the cat sat on the mat and the dog ran to the old barn again today") for i in range(30)]
    bad = [(100 + i, "BUY!! CHEAP!! PILLS!! NOW!! HERE!! FAST!! SALE!! BEST!! DEAL!! EVER!! CLICK!!") for i in range(10)]
    got = quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string"), spark.createDataFrame([(i,) for i in range(30)], "doc_id long"), prior=0.001).toPandas()
    assert got[got.doc_id < 100].kept.all() and not got[got.doc_id >= 100].kept.any()


def test_quality_scores_against_a_plain_version(spark, sf_dir):
    """The registered query's scores, by counters and crc32 of whole words; and its columns against the SQL."""
    import collections
    import math
    import zlib

    docs, labels = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = sorted(set(labels[labels.quality == 1].doc_id), key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[: quality.TRUSTED_DOCUMENTS]
    size = quality.BUCKETS

    def grams(text):
        code = [zlib.crc32(w.encode()) for w in brute.SPACED.findall(text or "")]
        return [c % size for c in code] + [size + (a * 31 + b) % size for a, b in zip(code, code[1:], strict=False)]

    own = {i: grams(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    raw, target = collections.Counter(g for x in own.values() for g in x), collections.Counter(g for i in good for g in own.get(i, ()))
    value = {}
    for low in (0, size):
        r_sum, t_sum = (sum(c[b] for b in range(low, low + size)) for c in (raw, target))
        for b in range(low, low + size):
            r = (raw[b] + 1) / (r_sum + size)
            value[b] = math.log((target[b] + quality.PRIOR * r * size) / (t_sum + quality.PRIOR * size) / r)
    got = quality.op1_quality(spark, sf_dir).toPandas().set_index("doc_id")
    for i, x in own.items():
        assert abs(got.score[i] - (sum(value[b] for b in x) / len(x) if x else 0)) < 1e-4
        assert got.kept[i] == (not got.base_failed[i] and got.score[i] >= quality.THRESHOLD)


@pytest.mark.parametrize("name", ["op1_quality", "op3_url_rules", "op5_warc"])
def test_registered_queries_equal_sql(spark, sf_dir, name):
    import glob
    import os

    import duckdb

    from quarryloom.llm import queries
    from tests.test_queries import rows

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


def plain_rule(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(brute.LOWER), rest[cut:]
    path = tail.split("?")[0].split("#")[0] if not tail.startswith(("?", "#")) else ""
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_rules(spark):
    rules = [*url_rules.CONTRACT_RULES, ("b.example.com", "/", "block"), ("com", "/en/x", "block"), ("", "/q", "block"), ("co", "/", "block"), ("net", "/es/", "block")]
    urls = [None, "", "nothing", "http://", "http://com/", "http://COM", "ftp://a.b.example.com/en/x?y#z", "http://xcom/", "http://www.example.com/en/1", "http://Example.com/EN/", "http://example.com/en/", "http://a.net/es/9", "http://a.net/es", "http://net/fr/?q", "http://h?a/b", "x://y://z/es/", "http://a.com:80/", "file:///q/1", "http://example.com./en/", "http://..com/\n/en"]
    rows = [(i, u, "mine") for i, u in enumerate(urls)] + [(0, None, "mine")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string"), spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, action string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain_rule(urls[r.page_id], rules), urls[r.page_id]
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(nothing, spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    big = "<p>" + "größe " * 300
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b/", big), (3, None, "small"), (4, "http://c/", "small"), (5, "http://d/", None), (6, "http://e/", ""), (7, "http://f/", "HTTP/1.1\r\n\r\nWARC/1.1\r\n"), (9, "http://g/", big), (9, "http://g/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.revisits(pages, page_id="page_id", payload=F.col("html").cast("binary"), uri=F.col("url"))
    path = str(tmp_path / "w")
    made.write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    got = {(r.record_id, r.record_type): r for r in read.collect()}
    assert read.count() == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        r = got[f"urn:page:{i}", "revisit" if i in (1, 2) else "response"]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.payload is None if i in (1, 2) else bytes(r.payload) == data
        assert r.refers_to == ("urn:page:9" if i in (1, 2) else None)
    some = read.where("record_type = 'revisit' AND target_uri LIKE 'http://b%'")
    assert [r.record_id for r in some.collect()] == ["urn:page:2"]
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload IS NOT NULL").count() == 0
    assert warc.revisits(pages.where("false"), page_id="page_id", payload=F.col("html").cast("binary"), uri=F.col("url")).count() == 0


def test_warc_append_and_overwrite(spark, tmp_path):
    """Every append stays readable; overwriting leaves the new records alone; clashing columns change nothing."""
    warc.register(spark)
    path = str(tmp_path / "w")

    def write(ids, mode):
        pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}", "mine", 1) for i in ids], "page_id long, url string, html string, payload string, record_type int")
        warc.revisits(pages, page_id="page_id", payload=F.col("html").cast("binary"), uri=F.col("url")).write.format("warc").mode(mode).save(path)

    ids = lambda: sorted(int(r.record_id.rpartition(":")[2]) for r in spark.read.format("warc").load(path).collect())
    write(range(3), "append")
    write(range(3, 6), "append")
    assert ids() == [0, 1, 2, 3, 4, 5]
    (tmp_path / "w" / "lost.warc.gz").write_bytes(b"of a lost attempt")
    assert ids() == [0, 1, 2, 3, 4, 5]
    write([7, 8], "overwrite")
    assert ids() == [7, 8]
    write([], "append")
    assert ids() == [7, 8]


def test_warc_reads_foreign_files(spark, tmp_path):
    import gzip

    warc.register(spark)
    parts = []
    for k in range(3):
        head, block = warc.record({"record_id": f"urn:x:{k}", "record_type": "response", "target_uri": f"http://h/{k}", "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": 5, "payload": b"abc%d\n" % k})
        parts.append(head + block)
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(parts)) + gzip.compress(parts[0] + parts[1]) + warc.member(parts[1] + parts[2], 6) + warc.member(parts[0], 6))
    read = spark.read.format("warc").load(str(tmp_path))
    assert sorted(bytes(r.payload) for r in read.collect()) == sorted([b"abc%d\n" % k for k in range(3)] * 2 + [b"abc%d\n" % k for k in (0, 1, 2, 0, 1, 1, 2, 0)])
    assert read.where("record_id = 'urn:x:1'").count() == 5
    assert read.where("record_id = 'urn:x:1' AND payload IS NOT NULL").count() == 5
    assert spark.read.format("warc").option("payload", "false").load(str(tmp_path)).count() == 14


def test_warc_members_of_many_and_long_records(spark, tmp_path):
    """Records of all lengths in one gzip member, read with and without their payloads."""
    import gzip

    warc.register(spark)
    parts, sizes = [], [0, 1, 5, 4096, 4095, 300_000, 2, 70_000, 0, 1_000_001, 3]
    for k, n in enumerate(sizes):
        head, block = warc.record({"record_id": f"urn:x:{k}", "record_type": "response" if k % 2 else "metadata", "target_uri": f"http://h/{k}", "refers_to": None, "payload_digest": "00" * 20, "payload_bytes": n, "payload": b"\r\n" * (n // 2) + b"x" * (n % 2)})
        parts.append(head + block)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    read = spark.read.format("warc").load(str(tmp_path))
    assert {r.record_id: len(r.payload or b"") for r in read.collect()} == {f"urn:x:{k}": n for k, n in enumerate(sizes)}
    some = read.where("record_type = 'response'").select("record_id", F.length("payload").alias("n"))
    assert {r.record_id: r.n for r in some.collect()} == {f"urn:x:{k}": n for k, n in enumerate(sizes) if k % 2}


PAGE = "<!DOCTYPE html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">buy {0}</div>{1}<footer>&copy; h</footer></body></html>"


def test_html_extraction(spark):
    article = "<article><h1>Title &amp; {0}</h1><p>One <b>wo</b>rd {0}.<br><p>Two\n  lines<div class='comments'><p>reader says</p></div><form>x</form></article>"
    plain = "<div id=content><h2>Head {0}</h2><p>Text {0}</p><p>Same on all pages</p></div>"
    rows = [(i, f"http://a.example/{i}", PAGE.format(i, article.format(i))) for i in range(5)] + [(10 + i, "http://b.example/", PAGE.format(i, plain.format(i))) for i in range(4)]
    rows += [(20, None, None), (21, "http://c/", ""), (22, "http://c/x", "<p>lonely &lt;tag&gt; <p unclosed"), (0, *rows[0][1:])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Title & 3 One word 3. Two lines"
    assert text[12] == "Head 2 Text 2 Same on all pages"
    assert (text[20], text[21]) == ("", "") and text[22].startswith("lonely <tag>")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_decides_inside_articles(spark):
    """Site text in main under unlisted classes goes; article text under a listed word stays where nothing else varies."""
    strip = "<div class='zq7'><p>Follow <b>us</b> daily</p></div>"
    body = "<div class='zq8'><h1>Head {0}</h1><p>Text {0}</p><div class='zq9'><p>Ring the desk</p></div><p>End {0}</p></div>"
    page = f"<body><main>Site slogan{strip}<div>{body}</div><div class='share'>told {{0}} times</div></main></body>"
    listed = "<body><article><div class='xx'>Our paper</div><div class='notice'><p>Notice {0} of the court</p></div><nav>n {0}</nav></article></body>"
    copies = "<body><article><h1>Same</h1><p>copy</p></article></body>"
    rows = [(i, "http://a/", page.format(i)) for i in range(4)] + [(10 + i, "http://b/", listed.format(i)) for i in range(4)] + [(20 + i, "http://c/", copies) for i in range(4)]
    rows.append((30, "http://d/", page.format(7)))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got[2] == "Head 2 Text 2 End 2"
    assert got[12] == "Notice 2 of the court"
    assert got[21] == "Same copy"
    assert got[30] == "Site slogan Follow us daily Head 7 Text 7 Ring the desk End 7"


def test_html_constant_words_of_an_article_stay(spark):
    """Lines that every article of a host ends with are its own; constant links, unnamed boxes and named boilerplate are not."""
    page = "<body><article><h1>Head {0}</h1><p>Text {0} goes on</p><p>The editors stand by every word.</p><ul><li>Kept <a href='/'>as</a> list</li></ul><div>Ring us</div><p class='share'>Tell it</p><p><a href='/a'>More</a> <a href='/b'>news</a></p></article></body>"
    rows = [(i, "http://a/", page.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Head {i} Text {i} goes on The editors stand by every word. Kept as list" for i in range(6)}


def test_html_template_finds_the_content(spark):
    """Without articles and listed classes the template of the host says where the text stands; a page alone on its host, read
    without a template, keeps what varies around it."""
    page = "<body><div class='k1'><a href='/{0}'>Teaser {0} of others</a> <a href='/x{0}'>and {0} more</a></div><div class='k2'><h1>Head {0}</h1><p>{1}</p><p>End {0}</p></div><div class='k3'>Offer {0} today</div></body>"
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(120))
    rows = [(i, "http://a.org/", page.format(i, body(i)), "mine") for i in range(5)] + [(9, "http://b.org/", page.format(9, body(9)), "mine")]
    # A very long page of the same host, one of another layout, and no page at all.
    rows += [(20, "http://a.org/", page.format(20, " ".join(body(k) for k in range(1500))), "mine"), (21, "http://a.org/", "<p>Other {0} layout", "mine"), (22, "http://a.org/", None, "mine"), (22, "http://a.org/", None, "mine")]
    got = [(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()]
    text = dict(got)
    assert len(got) == len(rows) and text[3] == f"Head 3 {body(3)} End 3"
    assert text[20].startswith("Head 20 word0x0 ") and text[20].endswith(" End 20")
    assert text[9] == f"Teaser 9 of others and 9 more Head 9 {body(9)} End 9 Offer 9 today"
    assert text[21] == "Other {0} layout" and text[22] == ""
    assert html_text.slots(rows[3][2], set()) != text[3]


def test_html_without_names(spark):
    """The given pages with all telling elements and classes made into unnamed ones: the template still finds the text, which
    no page gives away without it."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    names = [("<article", "<div class='z1'"), ("</article>", "</div>"), ('<div class="ad"', "<div class='z2'"), ("<footer", "<div class='z3'"), ("</footer>", "</div>"), ("<nav", "<div class='z4'"), ("</nav>", "</div>")]
    rows = []
    for r in pages.itertuples():
        page = r.html
        for a, b in names:
            page = page.replace(a, b)
        rows.append((r.page_id, r.url, page))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    want = {r.page_id: html_text.slots(r.html, set()) for r in pages.itertuples()}
    many = pages.groupby(pages.url.map(html_text.host_of)).page_id.transform("size") >= html_text.LEAST_PAGES
    assert sum(many) > 200 and all(got[i] == want[i] for i in pages.page_id[many])
    assert not any(html_text.slots(page, set()) == want[i] for i, _, page in rows)


def test_html_host_of_many_pages(spark):
    rows = [(i, "http://big.net/", f"<body><nav><a href='/'>Home</a></nav><article><h1>T{i}</h1><p>Text number {i}</p></article><footer>f {i}</footer></body>") for i in range(3000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert got == {i: f"T{i} Text number {i}" for i in range(3000)}


def test_html_against_the_given_pages(spark, sf_dir):
    import html
    import re

    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id")
    got = html_text.op9_html_text(spark, sf_dir).toPandas().set_index("page_id")
    for i, h in pages.html.items():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", h, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))).split())
        assert (got.text[i], got.n_chars[i]) == (want, len(want))


def test_toxicity_held_out(spark):
    random.seed(1)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    bad = ["stupidly", "stupider", "wretch", "scumbag"]
    rows, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        sentences = [" ".join(word() for _ in range(8)) for _ in range(random.randint(1, 12))]
        if toxic:
            k = random.randrange(len(sentences))
            sentences[k] += " " + random.choice(bad)
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(d, y.where("doc_id % 5 <> 0 OR doc_id IS NULL"))
    got = toxicity.score(d, model).toPandas().set_index("doc_id")
    held = [i for i in range(0, 800, 5)]
    right = sum((got.score[i] >= 0.5) == (i % 4 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert got.score[900] == got.score[901] == 0
    place = got.sentences[20][0]
    assert any(w in rows[20][1].encode()[place["start"] : place["end"]].decode() for w in bad)
    none = toxicity.score(d, toxicity.fit(d, y.where("false"))).toPandas()
    assert (none.score < 0.5).all() and toxicity.score(d.where("false"), model).count() == 0


def test_toxicity_learns_from_all_labels(spark):
    """A word that only late positives have is learnt, whatever the number of documents and the length of one of them."""
    order = [r.id for r in spark.range(5200).orderBy(F.xxhash64("id"), "id").collect()]
    rows, labels = [(order[0], "plain" + " " * 10_000_001)], [(order[0], 0)]
    for k, i in enumerate(order[1:]):
        toxic = k % 2
        rows.append((i, f"word{k % 7} here. " + ("lout" if toxic and k > 4600 else "wretch" if toxic else "friend")))
        labels.append((i, toxic))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "A lout."), (2, "A friend."), (3, "The wretch")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in toxicity.score(new, model).orderBy("doc_id").collect()] == [True, False, True]


def test_license_scan(spark):
    text = "intro\nReleased under the MIT License.\nmore\n\nlicensed under the apache license version 2.0\nSome licence of ours\nLicensed under CC BY-SA 4.0.\nAll rights reserved."
    d = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "no notice", "x")], "doc_id long, text string, findings string")
    got = {r.doc_id: r.findings for r in license_scan.scan(d).collect()}
    assert [(f.line, f.license, f.exact) for f in got[1]] == [(1, "MIT", True), (4, "Apache-2.0", True), (5, None, False), (6, "CC-BY-SA-4.0", True), (7, "proprietary", True)]
    assert got[2] == got[3] == got[4] == []
    changed = license_scan.TEMPLATES["MIT-text"].replace("free of charge", "for a fee")
    one = license_scan.scan(spark.createDataFrame([(1, changed)], "doc_id long, text string")).first().findings[0]
    assert one.license == "MIT-text" and not one.exact and "for" in one.extra


def test_license_scan_wrapped_header_and_two_notices_on_a_line(spark):
    header = "intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n"
    rows = [(1, header), (2, "Licensed under CC BY 4.0. Some words. All rights reserved. More."), (3, "All rights reserved. Licensed under CC BY 4.0.")]
    got = {r.doc_id: [(f.line, f.license, f.exact) for f in r.findings] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(2, "GPL-3.0-header", True)], 2: [(0, "CC-BY-4.0", True), (0, "proprietary", True)], 3: [(0, "proprietary", True), (0, "CC-BY-4.0", True)]}


def exact_notices(text):
    """Names of the templates whose words stand in the text, without those inside a longer one."""
    own, found = license_scan.words(text or ""), []
    for name, template in license_scan.TEMPLATES.items():
        t = license_scan.words(template)
        found += [(i, i + len(t), name) for i in range(len(own) - len(t) + 1) if own[i : i + len(t)] == t]
    return sorted({n for a, b, n in found if not any((c, d) != (a, b) and c <= a and b <= d for c, d, _ in found)})


def test_license_scan_against_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: sorted({f.license for f in r.findings if f.exact}) for r in license_scan.scan(docs).collect()}
    want = {r.doc_id: exact_notices(r.text) for r in docs.collect()}
    assert got == want and any(want.values())
    counted = {r.doc_id: r for r in license_scan.op6_license_scan(spark, sf_dir).collect()}
    assert all(set(want[i]) <= set(r.licenses.split(",")) for i, r in counted.items() if want[i])


def test_license_scan_of_whole_licences(spark):
    """Full texts over several paragraphs, each in a long document, twice, altered, and beside others."""
    names = ["MIT-full", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Apache-2.0-header"]
    full = license_scan.TEMPLATES
    rows = [(i, "intro words\n" * 40 + "Copyright (c) 2020 Someone\n\n" + full[n] + "\n\nmore text\n" * 60 + full[n]) for i, n in enumerate(names)]
    rows += [(10, full["MIT-full"].replace("without limitation", "with limits")), (11, full["ISC"] + "\n\n" + full["BSD-3-Clause"]), (12, "word " * 200_000 + "\n" + full["MIT-full"]), (12, "All rights reserved."), (12, "All rights reserved.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, [(f.license, f.exact) for f in r.findings if f.license]) for r in license_scan.scan(d).collect()]
    for i, n in enumerate(names):
        assert got[i] == (i, [(n, True)] * 2)
    assert got[6] == (10, [("MIT-full", False)]) and got[7] == (11, [("ISC", True), ("BSD-3-Clause", True)])
    assert got[8] == (12, [("MIT-full", True)]) and got[9] == got[10] == (12, [("proprietary", True)])
    assert license_scan.scan(d.where("false")).count() == 0


def test_registered_decontamination(spark, sf_dir, tmp_path):
    """op2 at its own window, and over many blocks of items with the documents saved between them."""
    docs, items = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute.contamination(list(docs.text), list(zip(items.item_id, items.text, strict=True)), 13)
    got = decontaminate.op2_decontamination(spark, sf_dir).toPandas().set_index("doc_id")
    for i, (n, hit, found) in zip(docs.doc_id, want, strict=True):
        names = ",".join(sorted(map(str, found)))
        assert tuple(got.loc[i, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]) == (n, hit, len(found), hashlib.sha256(names.encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    many = decontaminate.judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), block_chars=2500).toPandas().set_index("doc_id")
    assert many.n_hit.to_dict() == got.n_hit.to_dict() and any(got.n_hit > 0)


def test_registered_bpe(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    enc = bpe.encoding(*bpe.public_ranks())
    got = bpe.op8_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = np.asarray(enc.encode_ordinary(t or ""), "<u4")
        assert (got.n_tokens[i], got.ids_sha256[i], got.decoded_sha256[i]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_registered_toxicity(spark):
    """Scores lie between 0 and 1, labels of the held-out fold are not read, and the held-out documents are told apart."""
    import zlib

    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet").groupby("doc_id").toxic.max()
    got = toxicity.op10_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = [i for i in labels.index if i in got.index and got.held_out[i]]
    right = sum(got.predicted[i] == labels[i] for i in held)
    assert right >= 0.95 * len(held)


def test_toxicity_sample_is_shared_out(spark):
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(100)], "_id long, _y int")
    for size, ones, zeros in ((200, 30, 70), (40, 20, 20), (80, 30, 50), (100, 30, 70)):
        got = [r._y for r in toxicity.sample(labels, size).collect()]
        assert (sum(got), len(got) - sum(got)) == (ones, zeros)


def test_toxicity_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "You wretch.", "mine", [1]), (1, "You wretch.", "mine", [1]), (2, None, None, None), (3, "x " * 300_000 + "wretch", "m", [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string, sentences array<int>")
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -8.0)
    got = toxicity.score(d, model)
    assert got.columns == ["doc_id", "text", "score", "sentences"] and [round(r.score, 3) for r in got.orderBy("doc_id").collect()] == [0.0] * 4
    assert toxicity.fit(d.where("false"), d.select("doc_id", F.lit(1).alias("toxic"))).bias == -8.0
