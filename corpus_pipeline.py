"""From documents to token shards: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.common import new_path, table
from spindrift.llm.decontaminate import decontamination_stage
from spindrift.llm.isolation import quality_stage
from spindrift.llm.mixing import mixing_stage
from spindrift.llm.simhash import simhash_stage
from spindrift.llm.tokens import tokens_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", tokens_stage),
]

#: SQL can't express an isolation forest, nor greedy tiling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
