"""The two-cap sampler over a stream: state by class, order restored inside a micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sample_stream(stream: DataFrame, per_class: int, max_per_speaker: int, label: str = "label", speaker: str = "speaker", order: str = "stream_idx") -> DataFrame:
    """label, speaker, stream_idx of the rows kept, as they are found.

    A class's state is its count and its speakers' counts (at most per_class of them: only
    kept rows add to it). Rows of one micro-batch are taken in order of stream_idx.
    """
    rows = stream.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(speaker).cast("string").alias("speaker"), F.col(order).alias("stream_idx"))

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, of = (lambda s: (s[0], json.loads(s[1])))(state.get) if state.exists else (0, {})
        batch = pd.concat(list(batches)).sort_values("stream_idx", kind="stable")
        kept = []
        for row in batch.itertuples(index=False):
            if n >= per_class:
                break
            if of.get(row.speaker, 0) < max_per_speaker:
                of[row.speaker] = of.get(row.speaker, 0) + 1
                n += 1
                kept.append(row)
        state.update((n, json.dumps(of)))
        yield pd.DataFrame(kept, columns=["label", "speaker", "stream_idx"])

    return rows.groupBy("label").applyInPandasWithState(
        keep, "label string, speaker string, stream_idx long", "n long, of string", "append", GroupStateTimeout.NoTimeout
    )


def unique_clips(stream: DataFrame, id_col: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """A stream without repeats of an id inside the watermark."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def windowed_counts(stream: DataFrame, time_col: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows and distinct users (approximate) by time window and class; late rows beyond the watermark don't count."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), by).agg(F.count(F.lit(1)).alias("n"))
