import os

import pytest

import corpus_pipeline
from spindrift.llm.mixing import mixing_stage
from spindrift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
def test_stages_on_driver_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and set(out.columns) >= {"doc_id", "start", "n_tokens", "ids_crc32"}
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert len(corpus_pipeline.STAGES) == 5 and len(QUERIES) == 10


def test_mixing_stage_repeats_rows(spark, world):
    rows = [(i, "w " * 10, "en", "a" if i < 20 else "b") for i in range(120)]
    sf = world(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing_stage(spark, docs, sf)
    assert out.columns == docs.columns
    taken = {s: out.where(f"source = '{s}'").count() for s in "ab"}
    assert taken == {"a": 60, "b": 60}  # a would weigh 5 of 7 but stops at 3 times what it holds
    assert mixing_stage(spark, docs.where("false"), sf).count() == 0
