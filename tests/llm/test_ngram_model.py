"""The stored n-gram model: its files, its totals, and texts scored with it later."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolstrata.llm import common, ngrams, queries


@pytest.mark.parametrize("shards", [1, 3])
def test_shard_files_hold_every_count(tmp_path, shards):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    bounds = ngrams.shard_bounds(keys, shards)
    for s in range(shards):
        own = keys[bounds[s] : bounds[s + 1]]
        counts = [rng.integers(0, 3, len(own)).astype(np.uint64), rng.integers(0, 1 << 40, len(own)).astype(np.uint64)]
        counts[1][counts[0] == 0] = 0
        counts[0][5] = (1 << 40) + 4  # past 32 bits
        path = ngrams.shard_path(str(tmp_path), "bigrams", s)
        ngrams.write_shard(path, own, counts, shards)
        shard = ngrams.Shard(path, shards)
        assert all((a == b).all() for a, b in zip(shard.counts(shard.places(own)), counts))
        assert (shard.places(own ^ np.uint64(1 << 30)) == -1).all()


def test_sums_pass_32_bits(spark, tmp_path):
    big = np.array([1 << 31, (1 << 33) + 1], np.uint64)
    keys = np.array([5 << 50, 9 << 55], np.uint64)
    asked = spark.createDataFrame([(0, n, bytearray(ngrams.packed_sorted(keys)), [bytearray(ngrams.packed(big))]) for n in (1, 2)], ngrams.ASK)
    got = ngrams.learned(asked, str(tmp_path), "trigrams", 1, ngrams.trigram_totals).orderBy("chunk").collect()
    assert [ngrams.unpacked(bytes(r["values"][0])).tolist() for r in got] == [[1 << 32, (1 << 34) + 2]] * 2
    assert [ngrams.unpacked(bytes(r["values"][1]), np.uint8).tolist() for r in got] == [[1, 1], [0, 0]]


def test_rows_without_an_id_are_counted_once(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b"), (None, "c d"), (None, "e")], "doc_id long, text string")
    got = ngrams.score(rows, common.crc_mod("doc_id", 7) == 2).collect()
    held = {r.doc_id for r in got if r.held_out}
    assert None not in held and all(r.held_out is not None for r in got)
    assert {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for i, t in ((1, "a b c"), (2, "a b"), (None, "c d"), (None, "e")) if i not in held)}


@pytest.mark.parametrize("order", [2, 3])
def test_a_kept_model_scores_as_in_one_go(spark, tmp_path, order):
    known = [(n, " ".join("abcdefgh"[(n * k + k * k) % 8] for k in range(n % 9))) for n in range(40)]
    new = [(100, "a b c z"), (101, None), (102, "h h h a")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    model = ngrams.train(frame(known), str(tmp_path / "model"), order=order)
    later = {r.doc_id: r for r in ngrams.score_with(frame(new), ngrams.Model.load(str(tmp_path / "model"))).collect()}
    once = {r.doc_id: r for r in ngrams.score(frame(known + new), F.col("doc_id") >= 100, order=order).collect()}
    assert model == ngrams.Model.load(str(tmp_path / "model")) and set(later) == {100, 101, 102}
    for i, r in later.items():
        assert r.train_tokens == once[i].train_tokens and r.n_known == once[i].n_known
        assert all(math.isclose(r[c], once[i][c], rel_tol=1e-9) for c in ("score", "base_score", "perplexity", "bigram_score"))


def test_the_registered_query_has_order_3(spark, tmp_path):
    rows = [(n, " ".join("abcde"[(n * k + k) % 5] for k in range(n % 7))) for n in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op6_ngrams"](spark, str(tmp_path)).collect()}
    want = {r.doc_id: r for r in ngrams.op6_ngrams(spark, str(tmp_path)).collect()}
    assert all(r.score == r.trigram_score and r.perplexity == r.trigram_perplexity and math.isclose(r.bigram_score, want[i].score) for i, r in got.items()) and len(got) == 30
