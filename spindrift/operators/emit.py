"""Training sets from split manifests: augmented rows, variants, statistics, the sink."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..functions.text import augmented_name
from ..schemas import ACCENTS, EVAL_SPLITS
from ..storage import hadoop_path
from .validate import validate_manifest

VARIANTS = ("a_gold", "b_gold_oversampled", "c_gold_weak", "loso_l2")


def augment_train(df: DataFrame, factors: tuple[float, ...] = (0.9, 1.1)) -> DataFrame:
    """df and, for each speed factor but 1, a copy of every train row with its id and times adapted."""
    factors = [f for f in factors if f != 1.0]
    if not factors:
        return df
    faster = df.where("split = 'train'").withColumn("_f", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    faster = faster.withColumns({"clip_id": augmented_name(F.col("clip_id"), F.col("_f")), "duration_s": F.col("duration_s") / F.col("_f")})
    return df.unionByName(faster.withColumn("offset_end_s", F.col("offset_start_s") + F.col("duration_s")).drop("_f"))


def variant_filter(variant: str) -> Column:
    """Rows of a variant: the eval splits are the same in all."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; one of {VARIANTS}")
    in_eval = F.col("split").isin(*EVAL_SPLITS)
    keep = F.lit(True) if variant == "c_gold_weak" else in_eval | (F.col("label_source") != "weak")
    return keep & (in_eval | (F.col("source") != "l2_arctic")) if variant == "loso_l2" else keep


def variant(df: DataFrame, name: str) -> DataFrame:
    return df.where(variant_filter(name))


def stats(df: DataFrame, name: str) -> DataFrame:
    """One row: totals and maps per split and class, in one pass over the rows."""
    cells = df.groupBy("split", "accent_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_source") == "weak").alias("weak"), F.sum("duration_s").alias("seconds")
    )
    splits = cells.groupBy("split").agg(F.sum("n").alias("n"), F.sum("weak").alias("weak"), F.sum("seconds").alias("seconds"))
    of_split = splits.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("weak"))), F.lit(0)).alias("n_weak_train"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("per_split"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", half_even(F.col("seconds") / 3600, 3).alias("hours"))))).alias("hours_per_split"),
    )
    train = cells.where("split = 'train' AND accent_label IS NOT NULL").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("accent_label", "n")))).alias("per_class_train"))
    return of_split.crossJoin(train).select(F.lit(name).alias("variant"), "*")  # one row each


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A small file through the file system of its path."""
    at, fs = hadoop_path(df.sparkSession, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def emit_dataset(df: DataFrame, name: str, out_dir: str) -> dict:
    """Validate a variant, write it as Parquet by split, and its statistics as JSON. Nothing is written if it is invalid."""
    kept = validate_manifest(variant(df, name), "split")
    kept.write.mode("errorifexists").partitionBy("split").parquet(f"{out_dir}/manifest")
    row = stats(kept, name).first().asDict()
    write_text(df, f"{out_dir}/stats.json", json.dumps(row, indent=2))
    return row


def train_items(df: DataFrame, split: str = "train", rate: int = 16_000, most_s: int = 30) -> DataFrame:
    """What a loader needs of each row: the base clip, the speed factor, the class's number, the centre crop in samples."""
    parts = F.split("clip_id", "#", 2)
    n = F.rint(F.col("duration_s") * rate).cast("long")
    most = rate * most_s
    labels = F.array(*[F.lit(a) for a in ACCENTS])
    return df.where(F.col("split") == split).select(
        "clip_id",
        F.get(parts, F.lit(0)).alias("base_id"),
        F.coalesce(F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"^aug-sp(.+)$", 1).try_cast("double"), F.lit(1.0)).alias("speed"),
        (F.array_position(labels, F.col("accent_label")) - 1).cast("int").alias("label"),
        F.when(n > most, F.floor((n - most) / 2)).otherwise(0).cast("long").alias("crop_start"),
        F.least(n, F.lit(most)).cast("long").alias("crop_len"),
    )
