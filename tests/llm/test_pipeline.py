"""The pipeline over the smallest tables, stage by stage, and the registered queries."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from shardfit.llm import ordered_minhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_queries_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_stages(spark, tmp_path):
    docs = before = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = docs.count()
    assert before.count() >= kept["language"] >= kept["toxicity"] >= kept["near_copies"] == kept["personal_data"] > 0
    toxic = spark.read.parquet(f"{tmp_path}/toxicity")
    classes = ordered_minhash.classes(toxic).where("kept").select("key").collect()
    assert Counter(r["key"] for r in classes) == Counter(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/near_copies").collect())
    ids = {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
