import hashlib

import pandas as pd

import corpus_pipeline
from quarryloom.llm import bpe, quality
from quarryloom.llm.storage import saved
from tests.llm import brute


def test_every_stage_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
        kept.append(docs.toPandas().sort_values("doc_id").reset_index(drop=True))
        if len(kept) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    raw = pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id")
    one, two, three, four, five = kept
    base = {i for i, t in zip(raw.doc_id, raw.text, strict=True) if (q := brute.quality(t))[0] >= 10 and 100 * q[4] <= 20 * q[0]}
    verdict = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.trusted_ids(spark, sf_dir)).where("kept").toPandas()
    assert set(one.doc_id) <= base and set(one.doc_id) == set(verdict.doc_id)
    groups = brute.components(list(one.doc_id), list(one.text), 5, 80)
    assert set(two.doc_id) == {c for _, c in groups.values()}
    data, spans = brute.repeated_words(list(two.text), 51, True)
    want = {i: b"".join(b[x:y] for x, y in zip([0, *(e for _, e in s)], [*(f for f, _ in s), len(b)], strict=True)).decode("utf-8", "ignore") for i, b, s in zip(two.doc_id, data, spans, strict=True)}
    want = {i: t for (i, t), s in zip(want.items(), spans, strict=True) if t.strip() or not s}
    assert dict(zip(three.doc_id, three.text, strict=True)) == want and (three.n_chars == three.text.str.len()).all()
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    hits = brute.contamination(list(three.text), list(zip(items.item_id, items.text, strict=True)), 13)
    clean = {i for i, (n, h, _) in zip(three.doc_id, hits, strict=True) if not (h and 20 * h >= n)}
    assert set(four.doc_id) == clean
    enc = bpe.encoding(*bpe.public_ranks())
    for r in five.itertuples():
        assert r.n_tokens == len(enc.encode_ordinary(r.text)) and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "ids" in out.columns


def test_clashing_names_nulls_and_repeated_rows(spark, sf_dir, tmp_path):
    """User columns called like the operators' own come through as they were; without n_chars nothing is counted."""
    raw = pd.read_parquet(f"{sf_dir}/documents.parquet").head(60)
    rows = [(int(i), t, f"user {i}", 42.0, [f"mine {i}"], i * 2, "b") for i, t in zip(raw.doc_id, raw.text, strict=True)]
    rows += [rows[0], (None, raw.text[1], "user null", 42.0, ["mine"], 0, "b"), (None, None, None, None, None, None, None), (9000, None, "x", 1.0, [], 1, "b"), (9001, "", "x", 1.0, [], 1, "b")]
    rows += [(9002, " ".join(f"word{k}" for k in range(300_000)), "user 9002", 42.0, ["mine 9002"], 18004, "b")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, kept string, score double, items array<string>, spans long, `a.b` string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, spark.createDataFrame([], docs.schema), sf_dir).count() == 0
        docs = saved(stage(spark, docs, sf_dir), "clash")
        assert docs.columns[: len(columns)] == columns and (k == 4 or len(docs.columns) == len(columns))
        for r in docs.collect():
            if r.doc_id is not None:
                assert (r.kept, r.score, r["items"], r.spans, r["a.b"]) == (f"user {r.doc_id}", 42.0, [f"mine {r.doc_id}"], r.doc_id * 2, "b")
    left = [r.doc_id for r in docs.collect()]
    assert left and len([i for i in left if i is not None]) == len({i for i in left if i is not None})
