"""What the operators share: the word pattern, tables cut out of the lineage, seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, new_path, remove

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(columns: list[str]) -> list[Column]:
    """Columns by their plain names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def packed(df: DataFrame) -> DataFrame:
    """df's rows as one struct column, _row: whatever names they hold can't clash with an operator's own."""
    return df.select(F.struct(*named(df.columns)).alias("_row"))


def seeded(seed: int, *cols: Column) -> Column:
    """A 53-bit uniform integer fixed by seed and columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)


def word_count(text: Column) -> Column:
    """Number of WORD runs (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


__all__ = ["ASCII_SPACE", "WORD", "materialise", "named", "new_path", "packed", "remove", "seeded", "table", "word_count"]
