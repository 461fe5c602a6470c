"""Plain readers and writers: Parquet manifests, CSV and TSV with explicit schemas, JSON runs, sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.emit import write_text
from ..operators.validate import InvalidManifest, validate_manifest
from ..schemas import STAGES
from ..storage import hadoop_path


def read_manifest(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """A Parquet manifest; with a stage, its columns by that stage's types, further ones as they are."""
    df = spark.read.parquet(path)
    if stage is None:
        return df
    missing = [f.name for f in STAGES[stage].fields if f.name not in df.columns]
    if missing:
        raise InvalidManifest(f"{stage}: no column {', '.join(missing)}")
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in STAGES[stage].fields})


def write_manifest(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def ingest(records: DataFrame, path: str) -> DataFrame:
    """Raw records to a manifest file: not empty, valid, then written; nothing is written otherwise."""
    if not records.limit(1).count():
        raise InvalidManifest("no records")
    write_manifest(validate_manifest(records, "raw"), path)
    return read_manifest(records.sparkSession, path, "raw")


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings, empty fields as empty strings; `columns` names the file's own header in order."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="\0", quote="")
    return df.na.fill("", columns)


def read_csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None, comment: str | None = None) -> DataFrame:
    """CSV with a header, types given; rename: column of the file to the name wanted."""
    df = spark.read.csv(path, header=True, schema=schema, comment=comment, enforceSchema=False)
    return df.withColumnsRenamed(rename or {})


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """A list of clips to fetch, lines that begin with # aside."""
    return read_csv(spark, path, "url string, start_s double, end_s double, prior_label string, evidence_level string, evidence_note string", comment="#")


RUN_SCHEMA = "arm string, seed long, total_steps long, shared_config_hash string, best_val_macro_f1 double, history array<struct<step:long,val_macro_f1:double>>"


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Metrics of training runs, a JSON object a file."""
    return spark.read.json(pattern, schema=RUN_SCHEMA, multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file in a folder: for tables of report size."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_json_row(df: DataFrame, path: str) -> dict:
    """The one row of df as a JSON file."""
    row = df.first().asDict(recursive=True)
    write_text(df, path, json.dumps(row, indent=2, default=str))
    return row


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop_path(spark, path)
    return fs.exists(at)
