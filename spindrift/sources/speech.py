"""Source adapters: each gives raw manifest rows from one corpus layout.

Audio is only ever probed (its header read) here, and each distinct file once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.numeric import ratio
from ..functions.text import clip_name, l1_or_accent, split_accents
from ..schemas import RAW, TARGET_RATE
from .files import exists, read_csv, read_tsv

# Fixed: first language of each speaker directory of the read-speech corpus; those the taxonomy lacks are dropped later.
L1_OF_SPEAKER = {
    "ABA": "Arabic",
    "SKA": "Arabic",
    "YBAA": "Arabic",
    "ZHAA": "Arabic",
    "BWC": "Mandarin",
    "LXC": "Mandarin",
    "NCC": "Mandarin",
    "TXHC": "Mandarin",
    "ASI": "Hindi",
    "RRBI": "Hindi",
    "SVBI": "Hindi",
    "TNI": "Hindi",
    "HJK": "Korean",
    "HKK": "Korean",
    "YDCK": "Korean",
    "YKWK": "Korean",
    "EBVS": "Spanish",
    "ERMS": "Spanish",
    "MBMPS": "Spanish",
    "NJS": "Spanish",
    "HQTV": "Vietnamese",
    "PNV": "Vietnamese",
    "THV": "Vietnamese",
    "TLV": "Vietnamese",
}


def probe_files(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """path, duration, rate of all audio files under root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [audio.probe(bytes(c)) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "duration": [f[0] for f in found], "rate": [f[1] for f in found]})

    return files.select("path", "content").mapInPandas(headers, "path string, duration double, rate long")


def _raw(df: DataFrame, source: str, uri: Column | str, license: str, **columns: Column) -> DataFrame:
    """Columns in the raw stage's order and types."""
    given = {"source": F.lit(source), "source_uri": uri if isinstance(uri, Column) else F.lit(uri), "license": F.lit(license)} | columns
    return df.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in RAW.fields])


def _single_accents(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows of exactly one accent (as _accent), and the counts of what was left out."""
    listed = df.withColumn("_accents", split_accents(F.col(column)))
    n = F.size("_accents")
    stats = listed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(n == 0).alias("n_no_accent"), F.count_if(n > 1).alias("n_multi_accent_skipped"), F.count_if(n == 1).alias("n_yielded")
    )
    stats = stats.withColumn("accent_fill_rate", ratio((F.col("n_rows") - F.col("n_no_accent")).cast("double"), F.col("n_rows").cast("double")))
    return listed.where(n == 1).withColumn("_accent", F.col("_accents")[0]), stats


def common_voice(spark: SparkSession, root: str, columns: list[str], tsv: str = "validated.tsv", clips: str = "clips", uri: str = "local://common_voice") -> tuple[DataFrame, DataFrame]:
    """Rows of a validated.tsv with one accent, and ingest statistics. columns: the file's header."""
    rows, stats = _single_accents(read_tsv(spark, f"{root}/{tsv}", columns), "accents")
    found = probe_files(spark, f"{root}/{clips}").withColumn("_name", F.substring_index("path", "/", -1)).drop("path")
    rows = rows.join(found, F.col("path") == F.col("_name"))
    raw = _raw(
        rows, "common_voice", uri, "CC0-1.0",
        clip_id=F.concat(F.lit("cv:"), F.regexp_replace("path", r"\.[^.]*$", "")), orig_file=F.concat(F.lit(f"{clips}/"), F.col("path")),
        offset_start_s=F.lit(0.0), offset_end_s=F.col("duration"), sample_rate_orig=F.col("rate"), duration_s=F.col("duration"),
        speaker_id_raw=F.col("client_id"), accent_raw=F.col("_accent"),
    )
    return raw, stats


def speaker_directories(spark: SparkSession, root: str, l1_of: dict[str, str] | None = None, uri: str = "local://l2_arctic") -> DataFrame:
    """{SPEAKER}/wav/*.wav; a directory without a first language raises KeyError."""
    l1_of = l1_of or L1_OF_SPEAKER
    dim = spark.createDataFrame(list(l1_of.items()), "_speaker string, _l1 string")
    files = probe_files(spark, root).withColumn("_dir", F.regexp_extract("path", r"([^/]+)/wav/[^/]+$", 1)).where("_dir <> ''")
    unknown = files.join(F.broadcast(dim), F.col("_dir") == F.col("_speaker"), "left_anti").select("_dir").distinct().limit(5).collect()
    if unknown:
        raise KeyError(f"speaker directories without a first language: {sorted(r['_dir'] for r in unknown)}")
    rows = files.join(F.broadcast(dim), F.col("_dir") == F.col("_speaker"))
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    return _raw(
        rows, "l2_arctic", uri, "CC-BY-NC-4.0",
        clip_id=F.concat_ws(":", F.lit("l2arctic"), "_speaker", name), orig_file=F.concat(F.col("_speaker"), F.lit("/wav/"), name, F.lit(".wav")),
        offset_start_s=F.lit(0.0), offset_end_s=F.col("duration"), sample_rate_orig=F.col("rate"), duration_s=F.col("duration"),
        speaker_id_raw=F.col("_speaker"), accent_raw=F.col("_l1"),
    )


SEGMENT_COLUMNS = {"segment_id": "segment_id", "audio_file": "audio_file", "speaker_id": "speaker_id", "start_s": "start_s", "end_s": "end_s", "accent": "accent", "l1": "l1"}


def segments(spark: SparkSession, root: str, columns: dict[str, str] | None = None, segments_csv: str = "segments.csv", speakers_csv: str = "speakers.csv", uri: str = "local://edacc") -> DataFrame:
    """One row a segment of a long recording; columns maps the names used here to the files' own. A speaker without an entry raises KeyError."""
    col = SEGMENT_COLUMNS | (columns or {})
    # the headers are read for their names alone, so files may hold more columns in any order
    own = lambda file: spark.read.csv(f"{root}/{file}", header=True)
    seg = own(segments_csv).select(*[F.col(f"`{col[c]}`").alias(c) for c in ("segment_id", "audio_file", "speaker_id", "start_s", "end_s")])
    spk = own(speakers_csv).select(*[F.col(f"`{col[c]}`").alias(c) for c in ("speaker_id", "accent", "l1")])
    lost = seg.join(spk, "speaker_id", "left_anti").select("speaker_id").distinct().limit(5).collect()
    if lost:
        raise KeyError(f"segments of speakers without an entry: {sorted(str(r['speaker_id']) for r in lost)}")
    names = seg.select("audio_file").distinct()
    found = probe_files(spark, root).withColumn("_base", F.regexp_replace(F.col("path"), "^file:/*", "/"))
    found = names.join(found, F.expr("endswith(_base, concat('/', audio_file))")).select("audio_file", "rate")
    rows = seg.join(spk, "speaker_id").join(found, "audio_file")
    start, end = F.col("start_s").cast("double"), F.col("end_s").cast("double")
    return _raw(
        rows, "edacc", uri, "CC-BY-SA-4.0",
        clip_id=F.concat(F.lit("edacc:"), F.col("segment_id")), orig_file=F.col("audio_file"), offset_start_s=start, offset_end_s=end,
        sample_rate_orig=F.col("rate"), duration_s=end - start, speaker_id_raw=F.col("speaker_id"), accent_raw=l1_or_accent(F.col("l1"), F.col("accent")),
    )


def _shards(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """Rows of data/*.parquet with their file, its first two name parts and the position in it before any row is dropped."""
    df = spark.read.parquet(f"{root}/data").select(*columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    part = F.split("_file", "-")
    return df.withColumn("_split", part[0]).withColumn("_shard", part[1])


def _probed(df: DataFrame) -> DataFrame:
    """df with duration and rate in place of the audio struct."""

    @F.pandas_udf("duration double, rate long")
    def header(a: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([audio.probe(bytes(b)) for b in a["bytes"]], columns=["duration", "rate"])

    return df.withColumn("_p", header("audio")).withColumns({"_duration": F.col("_p.duration"), "_rate": F.col("_p.rate")}).drop("audio", "_p")


def _shard_clip(prefix: str) -> Column:
    return clip_name(prefix, F.col("_split"), F.col("_shard"), number=F.col("_at"))


def conversation_shards(spark: SparkSession, root: str, uri: str = "local://edacc") -> DataFrame:
    """Shards with speaker, accent, l1 and an audio struct (bytes, path)."""
    rows = _probed(_shards(spark, root, ["speaker", "accent", "l1", "audio"]))
    split = F.when(F.col("_file").startswith("test"), "test").otherwise("validation")
    return _raw(
        rows, "edacc", F.concat(F.lit(f"{uri}#"), split), "CC-BY-SA-4.0",
        clip_id=_shard_clip("edacc"), orig_file=F.concat(F.lit("data/"), F.col("_file")), offset_start_s=F.lit(0.0), offset_end_s=F.col("_duration"),
        sample_rate_orig=F.col("_rate"), duration_s=F.col("_duration"), speaker_id_raw=F.col("speaker"), accent_raw=l1_or_accent(F.col("l1"), F.col("accent")),
    )


def read_speech_shards(spark: SparkSession, root: str, uri: str = "local://globe") -> tuple[DataFrame, DataFrame]:
    """Shards with speaker_id, accent and an audio struct; rows of one accent, and ingest statistics."""
    rows, stats = _single_accents(_shards(spark, root, ["speaker_id", "accent", "audio"]), "accent")
    raw = _raw(
        _probed(rows), "globe", uri, "CC0-1.0",
        clip_id=_shard_clip("globe"), orig_file=F.concat(F.lit("data/"), F.col("_file")), offset_start_s=F.lit(0.0), offset_end_s=F.col("_duration"),
        sample_rate_orig=F.col("_rate"), duration_s=F.col("_duration"), speaker_id_raw=F.col("speaker_id"), accent_raw=F.col("_accent"),
    )
    return raw, stats.drop("accent_fill_rate")


def materialise_audio(spark: SparkSession, root: str, prefix: str, out: str, resume: bool = True) -> DataFrame:
    """Write each row's audio as 16 kHz mono PCM16 under its clip_id to the Parquet table `out`; returns the rows written.

    With resume, clips that are there already (by id) aren't decoded again.
    """
    rows = _shards(spark, root, ["audio"]).select(_shard_clip(prefix).alias("clip_id"), "audio")
    if resume and exists(spark, out):
        rows = rows.join(spark.read.parquet(out).select("clip_id"), "clip_id", "left_anti")

    @F.pandas_udf("wav binary, duration_s double, rate_orig long")
    def converted(a: pd.DataFrame) -> pd.DataFrame:
        done = [audio.normalise(bytes(b)) for b in a["bytes"]]
        return pd.DataFrame([d[:3] for d in done], columns=["wav", "duration_s", "rate_orig"])

    new = rows.withColumn("_w", converted("audio")).select("clip_id", "_w.*")
    new.write.mode("append").parquet(out)
    return new.select("clip_id", "duration_s", "rate_orig")


__all__ = [
    "TARGET_RATE", "common_voice", "conversation_shards", "materialise_audio", "probe_files", "read_csv", "read_speech_shards", "segments", "speaker_directories",
]
