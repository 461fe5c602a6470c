"""The quality cascade: the first rule that fails names the reason; later metrics stay null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .taxonomy import Taxonomy, map_labels


@dataclass(frozen=True)
class FilterConfig:
    min_dur_s: float = 5.0
    max_dur_s: float = 30.0
    min_snr_proxy_db: float = 10.0
    min_vad_ratio: float = 0.5
    min_lang_prob: float = 0.8


def metadata_reason(cfg: FilterConfig) -> Column:
    """The failing rule of those that need no audio; null if none fails."""
    return (
        F.when(F.col("accent_label").isNull(), "unmapped_accent")
        .when(F.col("duration_s") < cfg.min_dur_s, "too_short")
        .when(F.col("duration_s") > cfg.max_dur_s, "too_long")
    )


def signal_reason(cfg: FilterConfig) -> Column:
    return F.when(F.col("vad_speech_ratio") < cfg.min_vad_ratio, "low_vad").when(F.col("snr_proxy_db") < cfg.min_snr_proxy_db, "low_snr_proxy")


def language_reason(cfg: FilterConfig) -> Column:
    return F.when(~F.coalesce(F.col("lang") == "en", F.lit(False)) | (F.col("lang_prob") < cfg.min_lang_prob), "not_english")


#: Takes the surviving rows of a batch, returns one row of metrics for each, in order.
Measure = Callable[[pd.DataFrame], pd.DataFrame]


def measured(df: DataFrame, measure: Measure | None, fields: list[T.StructField]) -> DataFrame:
    """df with the fields that measure returns; it is called for rows without a reject_reason only.

    The rows are told apart inside the batch function: a Python function in a `when`
    branch would run for all rows. Without a measure the fields must be columns of df
    already; rejected rows lose theirs.
    """
    if measure is None:
        return df.withColumns({f.name: F.when(F.col("reject_reason").isNull(), F.col(f.name)) for f in fields})
    names = [f.name for f in fields]
    kept = df.drop(*names)
    schema = T.StructType(kept.schema.fields + fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alive = batch["reject_reason"].isna()
            out = batch.reindex(columns=[*batch.columns, *names])
            out[names] = out[names].astype(object)
            if alive.any():
                found = measure(batch[alive])
                for name in names:
                    out.loc[alive, name] = found[name].to_numpy(object)
            yield out

    return kept.mapInPandas(run, schema)


_D, _S = T.DoubleType(), T.StringType()
SIGNAL_FIELDS = [T.StructField("vad_speech_ratio", _D), T.StructField("snr_proxy_db", _D)]
SPEECH_FIELDS = [T.StructField("transcript", _S), T.StructField("lang", _S), T.StructField("lang_prob", _D)]


def apply_filters(df: DataFrame, taxonomy: Taxonomy, cfg: FilterConfig = FilterConfig(), signal: Measure | None = None, speech: Measure | None = None) -> DataFrame:
    """Raw manifest to qc manifest.

    signal gives vad_speech_ratio and snr_proxy_db, speech gives transcript, lang and
    lang_prob (one call, so a transcript is made once). Rules in order: unmapped accent,
    too short, too long, low speech ratio, low SNR proxy, not English.
    """
    reason = F.col("reject_reason")
    out = map_labels(df, taxonomy).withColumn("reject_reason", metadata_reason(cfg))
    out = measured(out, signal, SIGNAL_FIELDS)
    # a clip rejected for its speech ratio has no SNR: that rule was never reached
    out = out.withColumn("snr_proxy_db", F.when(F.col("vad_speech_ratio") >= cfg.min_vad_ratio, F.col("snr_proxy_db")))
    out = out.withColumn("reject_reason", F.coalesce(reason, signal_reason(cfg)))
    out = measured(out, speech, SPEECH_FIELDS)
    out = out.withColumn("reject_reason", F.coalesce(reason, F.when(reason.isNull(), language_reason(cfg))))
    return out.withColumn("status", F.when(reason.isNull(), "accepted").otherwise("rejected")).drop("lang")


def drop_small_classes(df: DataFrame, min_speakers: int = 4) -> DataFrame:
    """Accepted rows of classes with too few accepted speakers become rejected."""
    speakers = df.where("status = 'accepted' AND accent_label IS NOT NULL").groupBy("accent_label").agg(F.countDistinct("speaker_key").alias("_n"))
    small = F.broadcast(speakers.where(F.col("_n") < min_speakers).select("accent_label", F.lit(True).alias("_small")))  # a row a class
    out = df.join(small, "accent_label", "left")
    hit = F.coalesce("_small", F.lit(False)) & (F.col("status") == "accepted")
    out = out.withColumn("reject_reason", F.when(hit, "too_few_speakers_for_smoke_test").otherwise(F.col("reject_reason")))
    return out.withColumn("status", F.when(hit, "rejected").otherwise(F.col("status"))).select(*df.columns)
