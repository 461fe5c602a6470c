"""The manifest: one row a clip, in three stages (raw, qc, split), each adding columns to the last."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the manifest's closed vocabularies.
ACCENTS = ["en-US", "en-GB", "en-AU", "en-IN", "L1-Mandarin", "L1-Spanish", "L1-Korean", "L1-Arabic"]
SOURCES = ["common_voice", "globe", "l2_arctic", "edacc", "youtube"]
SPLITS = ["train", "val", "test", "ood_test", "unassigned"]
EVAL_SPLITS = ["val", "test", "ood_test"]
STATUSES = ["pending", "accepted", "rejected", "review"]
LABEL_SOURCES = ["gold", "self_report", "weak"]
EVIDENCE_LEVELS = ["E1", "E2", "E3"]
LABEL_SOURCE_OF = {"l2_arctic": "gold", "edacc": "gold", "common_voice": "self_report", "globe": "self_report", "youtube": "weak"}
FIXED_SPLIT_OF = {"edacc": "ood_test", "youtube": "train"}
TARGET_RATE = 16_000


def _fields(spec: str) -> list[T.StructField]:
    """`name type` or `name type?` (nullable), comma separated."""
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType()}
    out = []
    for part in spec.split(","):
        name, kind = part.split()
        out.append(T.StructField(name, kinds[kind.rstrip("?")], kind.endswith("?")))
    return out


_RAW = _fields(
    "clip_id string, source string, source_uri string, orig_file string, offset_start_s double, offset_end_s double, "
    "sample_rate_orig long, duration_s double, license string, speaker_id_raw string, accent_raw string?"
)
_QC = _fields(
    "accent_label string?, taxonomy_version string, snr_proxy_db double?, vad_speech_ratio double?, lang_prob double?, "
    "transcript string?, status string, reject_reason string?"
)
_SPLIT = _fields("speaker_key string, split string, label_source string, consensus_score double?, evidence_level string?")

RAW, QC, SPLIT = T.StructType(_RAW), T.StructType(_RAW + _QC), T.StructType(_RAW + _QC + _SPLIT)
STAGES = {"raw": RAW, "qc": QC, "split": SPLIT}
AUDIO = T.StructType([T.StructField("bytes", T.BinaryType()), T.StructField("path", T.StringType())])
EMBEDDING = T.StructType([T.StructField("speaker_key", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()), False)])
EDGE = T.StructType([T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("sim", T.DoubleType())])
PREDICTION = T.StructType([T.StructField(c, T.StringType()) for c in ("arm", "seed", "clip_id", "speaker_key", "y_true", "y_pred")])
