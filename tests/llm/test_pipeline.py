import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quillon.llm.language import identify_languages
from quillon.llm.mixing import mix_sources
from tests.llm.test_text_operators import base_spans, brute, sets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("k"))
    docs = docs.unionByName(spark.createDataFrame([(9000, None, "en", "src0", 0, "k"), (9001, "123 !!", "en", "src1", 6, "k")], docs.schema))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "language":
            und = {r["doc_id"] for r in identify_languages(before).where("lang_pred = 'und'").collect()}
            assert und == {9000, 9001} and docs.count() == before.count() - 2
        if name == "near_duplicates":
            rows = before.orderBy("doc_id").collect()
            want = brute([r["doc_id"] for r in rows], [r["text"] for r in rows], 80, 5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(want))
        if name == "secrets":
            assert docs.count() == before.count()
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in docs.collect():
                assert not base_spans(r["text"])
                assert base_spans(old[r["doc_id"]]) or r["text"] == old[r["doc_id"]]
        if name == "mixture":
            copies = {r["doc_id"]: r["copies"] for r in mix_sources(before).collect() if r["copies"]}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == copies
    packed = kept["packing"]
    assert packed.where("size(ids) != length OR ids IS NULL").count() == 0
    assert packed.where("piece = 0").count() == kept["mixture"].count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert sets([None]) == [set()] and re


def test_an_empty_table_goes_through(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0 and (name == "packing" or docs.columns == columns)


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
