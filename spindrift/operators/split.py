"""Splits by speaker, never by clip: stratified quotas, fixed sources, rosters and audits.

Where a generator would shuffle, keys stand in order of a seeded md5, which any engine repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FIXED_SPLIT_OF, LABEL_SOURCE_OF


def shuffled(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def quota(n: Column, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> tuple[Column, Column]:
    """(test, val) of n speakers; ratios are train, val, test. Both get one from 3 speakers on, train stays non-empty.

    Half-even rounding. What is too much comes off val down to 1, then off test.
    """
    test = F.greatest(F.lit(1), F.rint(n * ratios[2]).cast("int"))
    val = F.greatest(F.lit(1), F.rint(n * ratios[1]).cast("int"))
    over = F.greatest(F.lit(0), test + val - (n - 1))
    off_val = F.least(over, val - 1)
    off_test = F.least(over - off_val, test - 1)
    small = lambda two, many: F.when(n <= 1, 0).when(n == 2, two).otherwise(many).cast("int")
    return small(1, test - off_test), small(0, val - off_val)


def label_source(source: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LABEL_SOURCE_OF.items() for x in kv])[source]


def speaker_table(df: DataFrame) -> DataFrame:
    """A row a speaker_key: its commonest label (the least on ties, nulls aside) and least source."""
    return df.where("speaker_key IS NOT NULL").groupBy("speaker_key").agg(F.mode("accent_label", deterministic=True).alias("accent_label"), F.min("source").alias("source"))


def _opened(df: DataFrame) -> DataFrame:
    out = df.withColumn("label_source", label_source(F.col("source"))).withColumn("split", F.lit("unassigned"))
    for name, kind in (("consensus_score", "double"), ("evidence_level", "string")):
        if name not in df.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def place_speakers(speakers: DataFrame, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """speaker_key and split; strata are (accent_label, source), null labels have none."""
    stratum = Window.partitionBy("accent_label", "source")
    ranked = speakers.where("accent_label IS NOT NULL").select(
        "speaker_key",
        F.row_number().over(stratum.orderBy(shuffled(seed, F.col("speaker_key")), "speaker_key")).alias("at"),
        F.count(F.lit(1)).over(stratum).alias("n"),
    )
    test, val = quota(F.col("n"), ratios)
    return ranked.select("speaker_key", F.when(F.col("at") <= test, "test").when(F.col("at") <= test + val, "val").otherwise("train").alias("split"))


def assign_splits(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 17, fixed: dict[str, str] | None = None) -> DataFrame:
    """qc manifest with speaker_key to split manifest. Accepted rows only; all rows of a speaker go to one split."""
    fixed = FIXED_SPLIT_OF if fixed is None else fixed
    accepted = F.col("status") == "accepted"
    pooled = accepted & ~F.coalesce(F.col("source").isin(*fixed), F.lit(False)) if fixed else accepted
    placed = place_speakers(speaker_table(df.where(pooled)), ratios, seed).withColumnRenamed("split", "_placed")
    out = _opened(df).join(placed, "speaker_key", "left")
    split = F.when(pooled, F.coalesce("_placed", F.lit("unassigned")))
    for source, name in fixed.items():
        split = split.when(accepted & (F.col("source") == source), name)
    return out.withColumn("split", split.otherwise("unassigned")).drop("_placed")


def assign_splits_leaky(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 17) -> DataFrame:
    """Clips at random, speakers across splits: only ever to measure what that inflates.

    The rank of a clip is found in two steps: clips are counted by the first two hex digits
    of their hash, and ordered inside these 256 ranges.
    """
    accepted = df.where("status = 'accepted'").select("clip_id", shuffled(seed, F.col("clip_id")).alias("h")).withColumn("range", F.substring("h", 1, 2))
    sizes = accepted.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    total = accepted.agg(F.count(F.lit(1)).alias("total"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "clip_id"))
    at = accepted.withColumn("inside", inside).join(F.broadcast(before), "range").join(F.broadcast(total)).withColumn("at", F.col("before") + F.col("inside"))
    n_train, n_val = F.rint(F.col("total") * ratios[0]), F.rint(F.col("total") * ratios[1])
    placed = at.select("clip_id", F.when(F.col("at") <= n_train, "train").when(F.col("at") <= n_train + n_val, "val").otherwise("test").alias("_placed"))
    return _opened(df).join(placed, "clip_id", "left").withColumn("split", F.coalesce("_placed", "split")).drop("_placed")


def roster(df: DataFrame) -> DataFrame:
    """A row a speaker with a split: source, label, split, clips."""
    return df.where("split <> 'unassigned' AND speaker_key IS NOT NULL").groupBy("speaker_key").agg(
        F.min("source").alias("source"), F.mode("accent_label", deterministic=True).alias("accent_label"), F.min("split").alias("split"), F.count("clip_id").alias("n_clips")
    )


def test_coverage(df: DataFrame) -> DataFrame:
    """Per label of the test split: sources, speakers, clips, and whether one source stands alone."""
    out = df.where("split = 'test' AND accent_label IS NOT NULL").groupBy("accent_label").agg(
        F.countDistinct("source").alias("n_test_sources"), F.countDistinct("speaker_key").alias("n_test_speakers"), F.count("clip_id").alias("n_test_clips")
    )
    return out.withColumn("single_source_test", F.col("n_test_sources") < 2)


def leaking_speakers(df: DataFrame) -> DataFrame:
    """Speakers found in more than one split."""
    placed = df.where("split <> 'unassigned' AND speaker_key IS NOT NULL")
    return placed.groupBy("speaker_key").agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def shared_speakers(df: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """Speakers found in both splits."""
    of = lambda s: df.where(F.col("split") == s).select("speaker_key").distinct()
    return of(a).intersect(of(b))


def class_by_split(df: DataFrame) -> DataFrame:
    """Distinct speakers by label and split, 0 where there are none."""
    wide = df.where("split <> 'unassigned' AND accent_label IS NOT NULL").groupBy("accent_label").pivot("split", ["train", "val", "test", "ood_test"]).agg(F.countDistinct("speaker_key"))
    return wide.na.fill(0)
