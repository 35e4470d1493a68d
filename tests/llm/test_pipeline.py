import re

from edges import CLASHES, LONG, PROSE, documents
from test_jaccard import brute

from pyspark.sql import functions as F

import corpus_pipeline
from promptframe.llm.secrets import ASSIGN

DIR = "/root/testdata/sf0.001"


def test_every_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
    before = list(kept["quality_rules"].values())
    assert 0 < len(before) < len(kept["language_id"])
    want = brute([(r.doc_id, r.text) for r in before])
    assert set(kept["ngram_jaccard_join"]) == {i for i, _, c in want if i == c}
    masked = kept["secret_scan"]
    assert set(masked) == set(kept["ngram_jaccard_join"])
    assert all(r.n_chars == len(r.text) for r in masked.values())
    assert not [r for r in masked.values() for m in re.finditer(ASSIGN, r.text) if len(m[2]) >= 24]
    tokens = docs.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert {r.doc_id for r in tokens} == set(masked) and all(r[1] == r[2] for r in tokens)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DIR).columns[:2] == ["doc_id", "start"]


def test_stages_on_edges(spark):
    docs = documents(spark).withColumn("n_chars", F.length("text"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in kept[name])
    assert not [r for r in kept["language_id"] if not r.text or r.text.isspace() or r.lang is None]
    texts = [r.text for r in kept["ngram_jaccard_join"]]
    assert len(texts) == len(set(texts)) and set(texts) <= {PROSE, PROSE + " tail", LONG}
    assert sorted({str(r.doc_id) for r in kept["packing"]}) == sorted(str(r.doc_id) for r in kept["secret_scan"])


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0


def test_unlabelled_rows_get_a_language(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bare = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    told = {r.doc_id: r.lang for r in corpus_pipeline.STAGES[0][1](spark, bare, DIR).collect()}
    assert None not in told.values()
    assert all(told[r.doc_id] == r.lang for r in bare.collect() if r.lang and r.doc_id in told)
