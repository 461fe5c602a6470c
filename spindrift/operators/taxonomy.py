"""Free-text labels to a closed set of classes through a versioned allowlist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_key
from ..schemas import ACCENTS

# Fixed allowlist, version v1: the class of each spelling that sources write.
TAXONOMY_V1 = {
    "united states english": "en-US",
    "american english": "en-US",
    "us english": "en-US",
    "mainstream us english": "en-US",
    "england english": "en-GB",
    "british english": "en-GB",
    "southern british english": "en-GB",
    "northern british english": "en-GB",
    "received pronunciation": "en-GB",
    "australian english": "en-AU",
    "india and south asia (india, pakistan, sri lanka)": "en-IN",
    "indian english": "en-IN",
    "mandarin": "L1-Mandarin",
    "chinese": "L1-Mandarin",
    "chinese accent": "L1-Mandarin",
    "spanish": "L1-Spanish",
    "spanish accent": "L1-Spanish",
    "spanish (mexican)": "L1-Spanish",
    "korean": "L1-Korean",
    "korean accent": "L1-Korean",
    "arabic": "L1-Arabic",
    "arabic accent": "L1-Arabic",
}


@dataclass(frozen=True)
class Taxonomy:
    version: str
    mapping: dict[str, str]

    def __post_init__(self):
        invalid = set(self.mapping.values()) - set(ACCENTS)
        if invalid:
            raise ValueError(f"taxonomy {self.version}: targets outside the classes: {sorted(invalid)}")

    @classmethod
    def v1(cls) -> Taxonomy:
        return cls("v1", dict(TAXONOMY_V1))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v) for k, v in self.mapping.items()], "taxonomy_key string, taxonomy_label string")


def map_labels(df: DataFrame, taxonomy: Taxonomy, raw: str = "accent_raw") -> DataFrame:
    """df with accent_label (null: blank or not in the list) and taxonomy_version."""
    dim = F.broadcast(taxonomy.table(df.sparkSession))  # the list is written by hand: some dozens of rows
    keyed = df.withColumn("_key", normalise_key(F.col(raw)))
    mapped = keyed.join(dim, F.col("_key") == F.col("taxonomy_key"), "left").drop("_key", "taxonomy_key")
    return mapped.withColumnRenamed("taxonomy_label", "accent_label").withColumn("taxonomy_version", F.lit(taxonomy.version))


def misses(df: DataFrame, taxonomy: Taxonomy, raw: str = "accent_raw", top: int | None = None) -> DataFrame:
    """Normalised labels that the list lacks, with their counts; blank ones aren't misses."""
    keys = df.select(normalise_key(F.col(raw)).alias("key")).where("key <> ''")
    dim = F.broadcast(taxonomy.table(df.sparkSession))
    found = keys.join(dim, F.col("key") == F.col("taxonomy_key"), "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return found if top is None else found.orderBy(F.desc("n"), "key").limit(top)


def unknown_targets(labels: DataFrame, column: str) -> DataFrame:
    """Labels outside the closed set."""
    known = labels.sparkSession.createDataFrame([(a,) for a in ACCENTS], f"{column} string")
    return labels.select(column).distinct().join(F.broadcast(known), column, "left_anti")


def is_class(label: Column) -> Column:
    return label.isin(*ACCENTS)
