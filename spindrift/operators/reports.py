"""Reports over manifests: source by class, confounding, coverage, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, ratio
from ..schemas import ACCENTS


def source_accent_matrix(df: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """By source and label: speakers, clips, hours, median, 10th and 90th percentile of the duration (exact). scope: splits that count."""
    rows = df if scope is None else df.where(F.col("split").isin(*scope))
    d = F.col("duration_s")
    return rows.where("source IS NOT NULL AND accent_label IS NOT NULL").groupBy("source", "accent_label").agg(
        F.countDistinct("speaker_id_raw").alias("n_speakers"),
        F.count(F.lit(1)).alias("n_clips"),
        (F.sum(d) / 3600).alias("hours"),
        F.median(d).alias("median_duration_s"),
        F.percentile(d, F.lit(0.1)).alias("p10_duration_s"),
        F.percentile(d, F.lit(0.9)).alias("p90_duration_s"),
    )


def confounded(matrix: DataFrame, dominance: float = 0.9) -> DataFrame:
    """Per label the source with most hours (the least on ties), its share, and whether that is above `dominance`."""
    of_label = Window.partitionBy("accent_label")  # a row a source
    ranked = matrix.select(
        "accent_label",
        F.count(F.lit(1)).over(of_label).alias("n_sources"),
        F.col("source").alias("dominant_source"),
        ratio(F.col("hours"), F.sum("hours").over(of_label)).alias("dominant_share"),
        F.row_number().over(of_label.orderBy(F.desc("hours"), "source")).alias("_at"),
    )
    return ranked.where("_at = 1").drop("_at").withColumn("confounded", F.col("dominant_share") > dominance)


def duration_confound(matrix: DataFrame) -> DataFrame:
    """Labels whose range of durations (10th to 90th percentile over sources) overlaps no other label's."""
    ranges = matrix.groupBy("accent_label").agg(F.min("p10_duration_s").alias("p10"), F.max("p90_duration_s").alias("p90"))
    others = ranges.agg(F.collect_list(F.struct("accent_label", "p10", "p90")).alias("others"))  # a row a label
    found = ranges.crossJoin(others).withColumn("others", F.filter("others", lambda o: o["accent_label"] != F.col("accent_label")))
    met = F.size(F.filter("others", lambda o: (o["p10"] <= F.col("p90")) & (o["p90"] >= F.col("p10"))))
    return found.select(
        "accent_label", F.col("p10").alias("p10_duration_s"), F.col("p90").alias("p90_duration_s"), met.alias("n_overlapping_classes"), ((F.size("others") > 0) & (met == 0)).alias("duration_disjoint")
    )


def class_coverage(df: DataFrame, source: str = "edacc", min_speakers: int = 5) -> DataFrame:
    """All classes with speakers, clips and hours in one source's rows, 0 where there are none; include: enough speakers."""
    if df.where(F.coalesce(F.col("source") != source, F.lit(True))).limit(1).count():
        raise ValueError(f"class_coverage takes rows of {source} alone")
    found = df.where("accent_label IS NOT NULL").groupBy("accent_label").agg(
        F.countDistinct("speaker_id_raw").alias("n_speakers"), F.count(F.lit(1)).alias("n_clips"), (F.sum("duration_s") / 3600).alias("hours")
    )
    domain = df.sparkSession.createDataFrame([(a,) for a in ACCENTS], "accent_label string")
    out = domain.join(found, "accent_label", "left").na.fill(0, ["n_speakers", "n_clips"]).na.fill(0.0, ["hours"])
    return out.withColumn("include", F.col("n_speakers") >= min_speakers)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def hours_per_split(df: DataFrame) -> DataFrame:
    return df.where("split IS NOT NULL").groupBy("split").agg(half_even(F.sum("duration_s") / 3600, 3).alias("hours"))


def acceptance_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.coalesce(F.col("status") == "accepted", F.lit(False)).cast("double")).alias("acceptance_rate"))


def fetch_summary(df: DataFrame) -> DataFrame:
    return df.where("accent_label IS NOT NULL").groupBy("accent_label").agg(
        F.count(F.lit(1)).alias("n_clips"), F.countDistinct("speaker_id_raw").alias("n_speakers"), (F.sum("duration_s") / 3600).alias("hours")
    )
