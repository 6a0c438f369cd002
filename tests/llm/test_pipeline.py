"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re

import corpus_pipeline
from codelake.llm import pii, simhash, textkit
from tests.llm.test_dedup import _groups
from tests.llm.test_scores import _judged


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    simhash.ensure_checkpoints(spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, d).checkpoint()
        after = {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert after.keys() == {i for i, r in before.items() if _judged(r.text)}
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            assert after.keys() == {ids[g] for g in _groups([before[i].text or "" for i in ids])}
        elif name == "benchmark_decontamination":
            words = {i: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for i, r in before.items()}
            assert after.keys() == {i for i, t in words.items() if not any(f" {' '.join(x)} " in f" {t} " for x in items)}
        elif name == "pii":
            assert after.keys() == before.keys()
            for r in after.values():
                assert not any(pii.base_spans(r.text).values()) and r.n_chars == len(r.text)
        if name != "mixing":
            assert docs.columns == columns
            assert all(after[i] == before[i] for i in after if name != "pii")
    assert docs.columns == [*columns, "copies", "finish"] and docs.where("copies not between 1 and 3").count() == 0


def test_run_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect())
    assert textkit.WORD
