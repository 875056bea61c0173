"""Ids beyond 2^53 beside nulls, and columns that are named as helpers are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import embeddings as emb
from quillon.llm.alignment import align_tokens
from quillon.llm.packing import pack_documents
from quillon.llm.sharding import shard_documents
from quillon.llm.substrings import dedup_substrings
from quillon.llm.token_counts import count_tokens

BIG = 1 << 60
SF = "/root/testdata/sf0.001"
HELPERS = ["doc_id", "text_hash", "one", "hash", "source", "key", "copies", "rows", "on", "onto", "times", "time", "pred", "score", "low", "row", "spans"]


@pytest.mark.parametrize("operator", [pack_documents, shard_documents, dedup_substrings, count_tokens, align_tokens, lambda d: pack_documents(d, keep_ids=True)])
def test_ids_are_kept(spark, operator):
    ids = [BIG + 1, None, BIG + 3, -BIG - 1]
    docs = spark.createDataFrame([(i, f"a text of {i}") for i in ids], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in operator(docs).collect()) == sorted((i is None, i or 0) for i in ids)


def test_top_k_keeps_ids_and_high_thresholds(spark):
    rows = [(50 * (BIG // 50), [3.0, 1.0]), (BIG + 1, [3.0, 1.0]), (BIG + 3, [2.0, 1.0]), (None, [5.0, 5.0])]
    rows += [(BIG + 10 + i, [0.1, 0.2 * (i % 7)]) for i in range(40) if (BIG + 10 + i) % 50]
    for scale in (256, 1 << 28):
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        ints = [(i, [int(x * scale // 1) for x in v]) for i, v in rows]
        score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
        want = sorted((-score(ints[0][1], v), i is None, i or 0) for i, v in ints[1:])[:5]
        for shard in (16384, 6):
            got = sorted((r["rank"], r["vec_id"], r["score"]) for r in emb.top_k(docs, scale=scale, shard=shard).collect())
            assert got == [(k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(want)]


def test_stages_leave_clashing_columns_alone(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = [f"_{h}_{k}" for h in HELPERS for k in (0, 5)] + ["_PRED_1", "_On_1"]
    docs = docs.select("*", *(F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names))
    docs = docs.unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and docs.count() > 10
        for r in docs.collect():
            assert all(r[n] == f"{n}:{r['doc_id']}" for n in names)
