"""The pipeline's stages against plain versions of what they decide."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolstrata.llm import decontaminate, secrets, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    bench = decontaminate.Index([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs = corpus_pipeline.materialise(docs, f"test-{name}")
        outs[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in outs[name].select("doc_id").collect()}
    assert all(any(map(str.isalpha, rows[i].text or "")) for i in ids("language")) and len(ids("language")) >= 0.95 * len(rows)
    fps = {i: simhash.simhash(rows[i].text) for i in ids("language")}
    seen = {}
    for i in sorted(fps):  # components by comparing all pairs
        near = {seen[j] for j in seen if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 4}
        root = min(near | {i})
        for j, r in seen.items():
            if r in near:
                seen[j] = root
        seen[i] = root
    kept = set(seen.values())
    assert ids("near_dedup") == kept
    assert ids("decontaminate") == {i for i in kept if not bench.find(rows[i].text)}
    assert ids("secrets") == ids("decontaminate")
    for r in outs["secrets"].collect():
        same = r.text == rows[r.doc_id].text
        assert same or secrets.MARK in r.text and r.n_chars == len(r.text)
    assert outs["packing"].select("doc_id").distinct().count() == len(ids("secrets"))
    assert corpus_pipeline.run(spark, DATA).agg(F.sum("length")).first()[0] == outs["packing"].agg(F.sum("length")).first()[0]


def test_empty(spark):
    none = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, DATA)
        assert out.count() == 0
