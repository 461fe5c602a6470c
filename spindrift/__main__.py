"""The stages as commands: python -m spindrift <command> …; each reads a table, transforms it, validates and writes it."""

from __future__ import annotations

import argparse
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import audio
from .functions.text import speaker_key
from .operators import bootstrap, dedup, emit, quality, reports, split, weaklabel
from .operators.taxonomy import Taxonomy
from .operators.validate import validate_manifest
from .sources import files, speech


def with_audio(df: DataFrame, wavs: DataFrame | None) -> tuple[DataFrame, quality.Measure | None]:
    """df joined with its clips' audio, and a measure that reads it there with the plain energy detector."""
    if wavs is None:
        return df.withColumns({"vad_speech_ratio": F.lit(1.0), "snr_proxy_db": F.lit(float("inf"))}), None

    def measure(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for data in batch["wav"]:
            x, rate = audio.decode(bytes(data))
            found = audio.energy_segments(x, rate)
            rows.append((audio.speech_ratio(found, len(x)), audio.snr_proxy_db(x, found)))
        return pd.DataFrame(rows, columns=["vad_speech_ratio", "snr_proxy_db"])

    return df.join(wavs.select("clip_id", "wav"), "clip_id", "left"), measure


def filter_stage(df: DataFrame, wavs: DataFrame | None = None, cfg: quality.FilterConfig = quality.FilterConfig()) -> DataFrame:
    """Raw to qc with stub speech recognition (no transcript, English for sure); pass models to apply_filters for more."""
    rows, measure = with_audio(df, wavs)
    rows = rows.withColumns({"transcript": F.lit(None).cast("string"), "lang": F.lit("en"), "lang_prob": F.lit(1.0)})
    out = quality.apply_filters(rows, Taxonomy.v1(), cfg, signal=measure)
    return out.drop("wav")


def split_stage(df: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 17, near_duplicates: bool = True) -> DataFrame:
    """qc to split: speaker keys, near-duplicates out, splits by speaker."""
    keyed = df.withColumn("speaker_key", speaker_key(F.col("source"), F.col("speaker_id_raw")))
    return split.assign_splits(dedup.reject_near_duplicates(keyed) if near_duplicates else keyed, ratios, seed)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spindrift", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *paths: str, **options):
        c = commands.add_parser(name)
        for p in paths:
            c.add_argument(p)
        for key, default in options.items():
            c.add_argument(f"--{key.replace('_', '-')}", default=default, type=type(default) if default is not None else str)
        return c

    command("ingest", "kind", "root", "out").add_argument("--columns", nargs="*", default=["client_id", "path", "sentence", "accents"])
    command("audio", "root", "prefix", "out")
    command("filter", "manifest", "out", wavs=None)
    command("split", "manifest", "out", roster=None, seed=17)
    command("report", "manifest", "out")
    command("consensus", "votes", "out")
    command("audit-sample", "decided", "blind", "internal", seed=0)
    command("audit-report", "annotated", "out")
    command("emit", "manifest", "out", variant="c_gold_weak")
    command("ablation", "predictions", "out", n_boot=10_000)
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "ingest":
        kinds = {
            "common-voice": lambda: speech.common_voice(spark, a.root, a.columns)[0],
            "speaker-directories": lambda: speech.speaker_directories(spark, a.root),
            "segments": lambda: speech.segments(spark, a.root),
            "conversation-shards": lambda: speech.conversation_shards(spark, a.root),
            "read-speech-shards": lambda: speech.read_speech_shards(spark, a.root)[0],
        }
        files.ingest(kinds[a.kind](), a.out)
    elif a.command == "audio":
        speech.materialise_audio(spark, a.root, a.prefix, a.out)
    elif a.command == "filter":
        wavs = spark.read.parquet(a.wavs) if a.wavs else None
        files.write_manifest(filter_stage(files.read_manifest(spark, a.manifest, "raw"), wavs), a.out)
        validate_manifest(files.read_manifest(spark, a.out, "qc"), "qc")
    elif a.command == "split":
        files.write_manifest(split_stage(files.read_manifest(spark, a.manifest, "qc"), seed=a.seed), a.out)
        done = validate_manifest(files.read_manifest(spark, a.out, "split"), "split")
        if a.roster:
            files.write_csv(split.roster(done), f"{a.roster}/speakers")
            files.write_csv(split.test_coverage(done), f"{a.roster}/test_coverage")
    elif a.command == "report":
        done = files.read_manifest(spark, a.manifest)
        matrix = reports.source_accent_matrix(done)
        files.write_csv(matrix, f"{a.out}/matrix")
        files.write_csv(reports.confounded(matrix.where("source <> 'edacc'")), f"{a.out}/confounded")
        files.write_csv(reports.duration_confound(matrix), f"{a.out}/durations")
        files.write_csv(reports.class_coverage(done.where("source = 'edacc'")), f"{a.out}/coverage")
    elif a.command == "consensus":
        files.write_manifest(weaklabel.decide(spark.read.parquet(a.votes)), a.out)
    elif a.command == "audit-sample":
        sampled = weaklabel.draw_audit(spark.read.parquet(a.decided), seed=a.seed)
        files.write_manifest(sampled, a.internal)
        files.write_csv(weaklabel.blind(spark.read.parquet(a.internal)), a.blind)
    elif a.command == "audit-report":
        annotated = spark.read.parquet(a.annotated)
        files.write_csv(weaklabel.accepted_precision(annotated), f"{a.out}/precision")
        if "prior_label" in annotated.columns:
            files.write_csv(weaklabel.false_rejects(annotated), f"{a.out}/false_rejects")
    elif a.command == "emit":
        print(json.dumps(emit.emit_dataset(emit.augment_train(files.read_manifest(spark, a.manifest)), a.variant, a.out)))
    elif a.command == "ablation":
        table = bootstrap.ablation_table(spark.read.parquet(a.predictions), a.n_boot)
        files.write_csv(table.withColumn("seed_deltas", F.to_json("seed_deltas")), a.out)


if __name__ == "__main__":
    import sys

    run(SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:])
