"""Tables written between stages: the lineage is cut where something is read more than once or after a loop's round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the checkpoint folder set on the context, or, in local mode alone, a temporary one."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: tables between stages are written there")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def hadoop_path(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/spindrift-{name}-{uuid.uuid4().hex}"
    at, fs = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor then costs only its own tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def remove(df: DataFrame) -> None:
    """Delete the files behind a frame that materialise returned, once nothing will read it again."""
    remove_path(df.sparkSession, df._written_to)
