"""Sharding by sampled splitters.

Records are ordered by a key of two integers (for documents: the hash of the text, then
that of the id), so that equal texts stand together. Rows are drawn with a chance in
proportion to their size; weighted quantiles of the draw become the splitters of some
thousand ranges. The ranges are then measured exactly, and those that came out overfull
get splitters from a denser draw of their own. Consecutive ranges of near equal bytes
form the shards. A group of equal texts stays in one range unless the group alone is
larger than a range: then the second key splits it.

Defined results: a null text has no bytes (size 1) and crc32 0; repeated rows are rows of
their own; rows with equal keys (the same text under the same id) can't be told apart
and stay together; an empty table gives an empty result; only the named columns are
read, so further columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Draws for each splitter.
DRAWS = 24
#: Ranges of an operator's run; the draw sent to the driver is DRAWS times that at most, plus chance.
MIN_RANGES, MAX_RANGES, ROWS_A_RANGE = 2_048, 200_000, 50_000
#: A range above so many times the mean is subdivided.
OVERFULL = 2.0


@dataclass
class Splitters:
    """Sorted pairs; range i holds the keys from pair i - 1 (included) to pair i."""

    first: np.ndarray
    second: np.ndarray

    def locate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.first, a, side="left")
        hi = np.searchsorted(self.first, a, side="right")
        out = hi.astype(np.int64)
        split = np.flatnonzero(hi > lo)
        for key in np.unique(a[split]):
            rows = split[a[split] == key]
            i, j = lo[rows[0]], hi[rows[0]]
            out[rows] = i + np.searchsorted(self.second[i:j], b[rows], side="right")
        return out


def _draw(rows: DataFrame, rate: Column, seed: int) -> pd.DataFrame:
    """Rows kept with a chance of rate times size, fixed by key and seed; _w is what each stands for."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_k1", "_k2", "_size"), 11) / F.lit(float(1 << 53))
    return rows.where(u < F.col("_size") * rate).select("_k1", "_k2", F.greatest(F.col("_size").cast("double"), 1 / rate).alias("_w")).toPandas()


def _quantiles(drawn: pd.DataFrame, parts: int) -> list[tuple[int, int]]:
    """Keys that cut a draw into parts of equal weight; a key drawn for one cut alone is cut before its whole group."""
    if parts < 2 or drawn.empty:
        return []
    drawn = drawn.sort_values(["_k1", "_k2"], kind="stable")
    weight = drawn["_w"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, parts) / parts))
    a, b = drawn["_k1"].to_numpy()[at], drawn["_k2"].to_numpy()[at]
    alone = np.ones(len(a), bool)
    alone[1:] &= a[1:] != a[:-1]
    alone[:-1] &= a[:-1] != a[1:]
    least = np.iinfo(np.int64).min
    return [(int(x), least if one else int(y)) for x, y, one in zip(a, b, alone, strict=True)]


def _pairs(cuts) -> Splitters:
    cuts = sorted(set(cuts))
    return Splitters(np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64))


def with_range(rows: DataFrame, splitters: Splitters) -> DataFrame:
    """rows with _range; the splitters go along with the function (MAX_RANGES pairs of integers at most, twice that after subdividing)."""

    @F.pandas_udf("long")
    def located(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(splitters.locate(a.to_numpy(), b.to_numpy()))

    return rows.withColumn("_range", located("_k1", "_k2"))


def measured(ranged: DataFrame) -> pd.DataFrame:
    return ranged.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count(F.lit(1)).alias("rows")).toPandas().sort_values("_range", ignore_index=True)


def sampled_splitters(rows: DataFrame, n_ranges: int, total: int, seed: int = 8, rounds: int = 3) -> tuple[Splitters, pd.DataFrame]:
    """Splitters of rows (_k1, _k2, _size) into ranges of near equal bytes, and the ranges' exact bytes and rows."""
    rate = DRAWS * n_ranges / max(total, 1)
    cuts = _quantiles(_draw(rows, F.lit(rate), seed), n_ranges)
    splitters = _pairs(cuts)
    ranged = with_range(rows, splitters)
    found = measured(ranged)
    for i in range(rounds):
        over = found[found["bytes"] > OVERFULL * total / n_ranges]
        if over.empty:
            break
        # a draw DRAWS times as dense, of the overfull ranges alone
        ids = rows.sparkSession.createDataFrame([(int(x),) for x in over["_range"]], "_range long")
        drawn = _draw(ranged.join(F.broadcast(ids), "_range"), F.lit(rate * 4 ** (i + 1)), seed + i + 1)
        drawn["_range"] = splitters.locate(drawn["_k1"].to_numpy(), drawn["_k2"].to_numpy())
        parts = dict(zip(over["_range"], np.ceil(over["bytes"] * n_ranges / total).astype(int), strict=True))
        new = {c for r, part in drawn.groupby("_range") for c in _quantiles(part, parts[r])} - set(cuts)
        if not new:
            break
        cuts = list({*cuts, *new})
        splitters = _pairs(cuts)
        ranged = with_range(rows, splitters)
        found = measured(ranged)
    return splitters, found


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 8) -> DataFrame:
    """Shards of near equal bytes. Returns id, size, text_crc32, shard, slot (gapless from 0 in each shard) and range."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
            F.xxhash64(text).alias("_k1"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("_k2"),
        ),
        "shard",
    )
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n_ranges = int(min(MAX_RANGES, max(MIN_RANGES, n_shards, n // ROWS_A_RANGE)))
    splitters, found = sampled_splitters(rows, n_ranges, total, seed)

    # whole ranges go to the shard that holds their middle byte
    before = found["bytes"].cumsum() - found["bytes"]
    found["shard"] = np.minimum((before + found["bytes"] / 2) * n_shards // max(total, 1), n_shards - 1).astype(int)
    found["first_slot"] = found.groupby("shard")["rows"].cumsum() - found["rows"]
    place = spark.createDataFrame([tuple(map(int, x)) for x in found[["_range", "shard", "first_slot"]].itertuples(index=False)], "_range long, _shard int, _first long")
    inside = Window.partitionBy("_range").orderBy("_k1", "_k2", "_id", "_crc")
    rows = with_range(rows, splitters).withColumn("_at", F.row_number().over(inside) - 1)
    # one row a range: bounded by MAX_RANGES and its subdivisions, as the splitters are
    return rows.join(F.broadcast(place), "_range").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"),
        (F.col("_first") + F.col("_at")).cast("long").alias("slot"),
        F.col("_range").alias("range"),
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range"
    )
