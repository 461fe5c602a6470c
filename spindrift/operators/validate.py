"""Manifest constraints by stage: all violations at once, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACCENTS, EVAL_SPLITS, EVIDENCE_LEVELS, LABEL_SOURCES, SOURCES, SPLITS, STAGES, STATUSES


class InvalidManifest(ValueError):
    pass


def _broken(condition: Column) -> Column:
    """A condition that isn't known to hold counts as broken."""
    return ~F.coalesce(condition, F.lit(False))


def _if_set(column: str, condition: Column) -> Column:
    return F.col(column).isNotNull() & _broken(condition)


def rules(stage: str, columns: list[str]) -> list[tuple[str, str, Column]]:
    """(rule, column, condition under which a row breaks it)."""
    c = F.col
    out = [("not_null", f.name, c(f.name).isNull()) for f in STAGES[stage].fields if not f.nullable]
    out += [
        ("known", "source", _if_set("source", c("source").isin(*SOURCES))),
        ("at_least_0", "offset_start_s", _if_set("offset_start_s", c("offset_start_s") >= 0)),
        ("above_0", "offset_end_s", _if_set("offset_end_s", c("offset_end_s") > 0)),
        ("above_0", "sample_rate_orig", _if_set("sample_rate_orig", c("sample_rate_orig") > 0)),
        ("above_0", "duration_s", _if_set("duration_s", c("duration_s") > 0)),
    ]
    if stage in ("qc", "split"):
        out += [
            ("known", "accent_label", _if_set("accent_label", c("accent_label").isin(*ACCENTS))),
            ("in_0_1", "vad_speech_ratio", _if_set("vad_speech_ratio", c("vad_speech_ratio").between(0, 1))),
            ("in_0_1", "lang_prob", _if_set("lang_prob", c("lang_prob").between(0, 1))),
            ("known", "status", _if_set("status", c("status").isin(*STATUSES))),
            ("rejected_has_reason", "reject_reason", (c("status") == "rejected") & c("reject_reason").isNull()),
        ]
    if stage == "split":
        out += [
            ("known", "split", _if_set("split", c("split").isin(*SPLITS))),
            ("known", "label_source", _if_set("label_source", c("label_source").isin(*LABEL_SOURCES))),
            ("in_0_1", "consensus_score", _if_set("consensus_score", c("consensus_score").between(0, 1))),
            ("known", "evidence_level", _if_set("evidence_level", c("evidence_level").isin(*EVIDENCE_LEVELS))),
            ("weak_never_in_eval", "split", (c("label_source") == "weak") & c("split").isin(*EVAL_SPLITS)),
            ("youtube_needs_evidence", "evidence_level", (c("source") == "youtube") & (c("status") == "accepted") & _broken(c("evidence_level").isin("E1", "E2"))),
        ]
    return out


def violations(df: DataFrame, stage: str) -> DataFrame:
    """rule, column, clip_id of every violation; further columns of df are allowed.

    One pass over the rows, and one aggregation for unique ids.
    """
    missing = [f.name for f in STAGES[stage].fields if f.name not in df.columns]
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame([("present", m, None) for m in missing], "rule string, column string, clip_id string")
    marks = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(col).alias("column"))) for r, col, bad in rules(stage, df.columns)]))
    rows = df.select("clip_id", F.explode(marks).alias("v")).select("v.rule", "v.column", "clip_id")
    twice = df.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("unique").alias("rule"), F.lit("clip_id").alias("column"), "clip_id")
    return rows.unionByName(twice)


def validate_manifest(df: DataFrame, stage: str, show: int = 20) -> DataFrame:
    """df if it breaks no rule; else InvalidManifest naming the first violations."""
    found = violations(df, stage).orderBy("rule", "column", "clip_id").limit(show).collect()
    if found:
        raise InvalidManifest(f"{stage}: " + "; ".join(f"{r['column']} {r['rule']} ({r['clip_id']})" for r in found))
    return df
