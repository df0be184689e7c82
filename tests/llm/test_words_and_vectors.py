import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import tokenizers
from pyspark.sql import functions as F

from quarryloom.llm import clusters, spelling, word_bpe
from tests.llm import brute


@pytest.fixture
def four_partitions(spark):
    """Ranges stay apart, however small, so that what crosses their borders is seen."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def variants(words, factor):
    """Plain version: all pairs."""

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(found[w]), words[form[w]] if form[w] is not None else None)
    return out


def as_dict(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_of_random_words(spark, four_partitions):
    random.seed(4)
    words = {"".join(random.choice("abÿ😀") for _ in range(random.randint(0, 6))): random.choice([5, 6, 25, 26, 130, 700]) for _ in range(700)}
    words |= {"a" * 4000: 9, "a" * 3999: 50, "b" + "a" * 3999: 9}
    rows = [(w, n - 1) for w, n in words.items()] + [(w, 1) for w in words] + [(None, 7)]
    got = as_dict(spelling.variants(spark.createDataFrame(rows, "word string, n long").repartition(3)))
    long, short = {w for w in words if len(w) > 9}, {w: n for w, n in words.items() if len(w) <= 9}
    assert {w: v for w, v in got.items() if w in short} == variants(short, spelling.FACTOR)
    assert {w: v for w, v in got.items() if w in long} == variants({w: words[w] for w in long}, spelling.FACTOR)
    assert len(got) == len(words)


def test_roots_follow_long_chains(spark, four_partitions):
    words = {"x" * k: 5**k for k in range(1, 20)}
    got = as_dict(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in got.values()} == {"x" * 19} and got["x"][3] == 1


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(none).count() == 0
    assert as_dict(spelling.variants(spark.createDataFrame([("abc", 3)], "word string, n long"))) == {"abc": (None, "abc", 3, 0, None)}


def test_counted_words(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in pd.read_parquet(f"{sf_dir}/documents.parquet").itertuples()]
    texts += [(None, "Straße Çédille ÷×abcdef"), (7, None), (8, ""), (9, "Wörter " * 50000), (9, "Wörter " * 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(1))
    want = collections.Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 6
    assert {r.word: r.n for r in spelling.counted(df).collect()} == {w: n for w, n in want.items() if n >= 5}


def k_means(rows, k, rounds, scale):
    """Plain version: (id, components) in, {position: (cluster, distance)} and centroids out."""
    v = [[int(np.floor(float(x) * scale)) for x in r] for _, r in rows]
    hashes = [(i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", q) for (i, _), q in zip(rows, v, strict=True)]
    centroids = [q for *_, q in sorted(hashes)[:k]]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centroids] for q in v]
        near = [x.index(min(x)) for x in d]
        if turn < rounds:
            for c in range(len(centroids)):
                own = [q for q, n in zip(v, near, strict=True) if n == c]
                if own:
                    centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, n, x[n]) for (i, _), n, x in zip(rows, near, d, strict=True)], centroids


@pytest.mark.parametrize("spread", [0.01, 3.0, 100000.0])
def test_clusters_against_plain_rounds(spark, four_partitions, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 6))
    rows = [(i, [float(x) for x in np.clip(centres[i % 5] + rng.normal(size=6) * spread, -131000, 131000)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)] + [rows[1], (None, rows[2][1]), (None, rows[3][1])]
    odd = [(900, None), (901, [1.0]), (902, [1.0, 2.0, None, 4.0, 5.0, 6.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [2.0**17] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("id", "v", "key", "cluster", "n")})
    out, centroids = clusters.cluster(df.repartition(3), dimensions=6, clusters=7, rounds=4)
    want, plain = k_means(rows, 7, 4, 1024)
    assert centroids.tolist() == plain
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.id, r.cluster, r.distance) for r in out.collect()), key=key) == sorted(want, key=key)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id long, embedding array<float>")
    out, centroids = clusters.cluster(df, dimensions=2)
    assert len(centroids) == 2 and [(r.cluster, r.distance) for r in out.collect()] == [(0, 0), (0, 0)]
    assert clusters.cluster(df.where("false"), dimensions=2)[0].count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_neighbours_on_the_curve_touch(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = clusters.curve_keys(cells, bits)
    order = np.lexsort(keys.T[::-1])
    assert len(np.unique(keys, axis=0)) == len(cells)
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_box_bounds_keep_every_nearest_centroid():
    rng = np.random.default_rng(6)
    for _ in range(200):
        v, c = rng.integers(-9, 9, (20, 3)), rng.integers(-12, 12, (6, 3))
        near = clusters.candidates(v.min(0), v.max(0), c)
        d = clusters.distances(v, c)
        assert set(np.flatnonzero((d == d.min(1)[:, None]).any(0))) <= set(near)


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.public_file())


def odd_texts():
    random.seed(7)
    letters = "abcdeth'sn 12\t\n-<|>Σς éÀİ́中文日\x00\x1c ꟋǅⅧ½﻿"
    out = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    out += ["".join(random.choice("aabt") for _ in range(random.randint(0, 60))) for _ in range(500)]
    out += ["x<|endoftext|>y <|startoftext|><|endoftext|", "</w>", "a</w> b", "'S 'Re don'T", "é " * 40000, "a" * 30000, "the" * 2000, "́", "", " ", None]
    out += [" " * 2_000_000, "\n" * 2_000_000, "é\n" + "中" * 70000 + " ́x", "word " * 30000 + "<|endoftext|>" * 9000]
    return out


def test_word_bpe_is_that_of_the_library(spark, library, sf_dir):
    texts = list(pd.read_parquet(f"{sf_dir}/documents.parquet").text) + odd_texts()
    rows = [(i, t, b"mine", b"mine") for i, t in enumerate(texts)] + [(0, texts[0], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, decoded binary").repartition(4)
    got = word_bpe.encode(df, word_bpe.public_file(), with_decoded=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert bytes(r.ids) == np.asarray(want, "<u4").tobytes()
        assert bytes(r.decoded).decode() == library.decode(want, skip_special_tokens=False)
    assert word_bpe.encode(df.where("false").persist(), word_bpe.public_file()).count() == 0


def test_word_bpe_decodes_any_ids(spark, library):
    ids = [[], [5, 49407, 49406, 48000], [0, 10**9], None]
    df = spark.createDataFrame([(k, None if x is None else np.asarray(x, "<u4").tobytes()) for k, x in enumerate(ids)], "doc_id long, ids binary")
    got = {r.doc_id: bytes(r.decoded).decode() for r in word_bpe.decode(df, word_bpe.public_file()).collect()}
    assert got == {k: library.decode(x or [], skip_special_tokens=False) for k, x in enumerate(ids)}
