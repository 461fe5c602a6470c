"""Samplers: two caps over a stream in order, strata without replacement, quota plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .split import shuffled


def two_cap_sample(
    stream: DataFrame,
    per_class: int,
    max_per_speaker: int,
    expected: list[str] | None = None,
    max_rows: int | None = None,
    label: str = "label",
    speaker: str = "speaker",
    order: str = "stream_idx",
) -> DataFrame:
    """What a reader in stream order keeps under a cap for each class and one for each speaker in it.

    Reading stops, if classes are expected, at the first row of a full class after all
    expected ones are full; labels that aren't expected lose what comes later. Ranks come
    from windows cut to the caps, so a class's rows leave the first shuffle as at most
    max_per_speaker a speaker.
    """
    rows = stream.where(F.col(label).isNotNull())
    if max_rows is not None:
        rows = rows.where(F.col(order) < max_rows)
    of_speaker = F.row_number().over(Window.partitionBy(label, speaker).orderBy(order))
    kept = rows.withColumn("_s", of_speaker).where(F.col("_s") <= max_per_speaker)
    kept = kept.withColumn("_c", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("_c") <= per_class)
    if expected:
        filled = kept.where((F.col("_c") == per_class) & F.col(label).isin(*expected)).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("at")).first()
        if filled["n"] == len(set(expected)):
            # the row that ends the reading: the first later one whose own class is full by then
            full = kept.where(F.col("_c") == per_class).select(F.col(label).alias("_l"), F.col(order).alias("_full"))
            stop = rows.where(F.col(order) > filled["at"]).join(F.broadcast(full), (F.col(label) == F.col("_l")) & (F.col(order) > F.col("_full")), "left_semi")
            end = stop.agg(F.min(order)).first()[0]
            if end is not None:
                kept = kept.where(F.col(order) < end)
    return kept.drop("_s", "_c")


def quota_plan(available: DataFrame, per_class: int) -> DataFrame:
    """available: label, n. How many to take: the cap, or what there is."""
    return available.select("label", F.least(F.col("n"), F.lit(per_class)).alias("take"))


def stratified_sample(df: DataFrame, by: str, n: Column | int, seed: int = 0, key: str = "clip_id") -> DataFrame:
    """Up to n rows of each stratum, in order of a seeded hash; null strata have none."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(shuffled(seed, F.col(key)), key))
    n = F.lit(n) if isinstance(n, int) else n
    return df.where(F.col(by).isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def weighted_draws(df: DataFrame, n: int, label: str = "accent_label", key: str = "clip_id", seed: int = 0) -> DataFrame:
    """draw, clip_id: n draws with replacement, each class as likely as any other.

    A draw picks a class, then a row of it by number; the numbered rows are joined to the draws.
    """
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("_l"), key, F.row_number().over(Window.partitionBy(label).orderBy(shuffled(seed, F.col(key)), key)).alias("_at"))
    sizes = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    classes = sizes.withColumn("_i", F.row_number().over(Window.orderBy("_l")) - 1)  # a row a class
    n_classes = classes.count()
    if not n_classes:
        return df.sparkSession.createDataFrame([], "draw long, clip_id string")
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), "id"), F.lit(1 << 40))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (pick(1) % n_classes).alias("_i"), pick(2).alias("_u"))
    draws = draws.join(F.broadcast(classes), "_i").withColumn("_at", F.col("_u") % F.col("_n") + 1)
    return draws.join(rows, ["_l", "_at"]).select("draw", key)


def class_weights(df: DataFrame, label: str = "accent_label") -> DataFrame:
    """df with weight = 1 / rows of its class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(sizes), label).withColumn("weight", 1.0 / F.col("_n")).drop("_n")
