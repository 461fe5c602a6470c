"""Manifest-shaped views over the driver tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import speaker_key
from ..operators.quality import apply_filters
from ..operators.split import assign_splits, assign_splits_leaky
from ..operators.taxonomy import Taxonomy

TAXONOMY = Taxonomy.v1()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw manifest, and the metrics that models would give."""
    i, k = F.col("doc_id"), F.col("k")
    english = F.element_at(F.array(*[F.lit(x) for x in ("United States English", " England  English ", "Australian English", "Indian English", "Scottish English")]), (k % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").withColumn("k", F.substring("source", 4, 9).cast("int"))
    group = F.floor(k / 5)
    duration = F.col("n_chars") / F.lit(100.0)
    return rows.select(
        F.concat(F.lit("doc:"), i.cast("string")).alias("clip_id"),
        F.when(i % 23 == 0, "youtube").when(group == 0, "common_voice").when(group == 1, "globe").when(group == 2, "l2_arctic").otherwise("edacc").alias("source"),
        F.lit("drv://documents").alias("source_uri"),
        F.lit("documents.parquet").alias("orig_file"),
        F.lit(0.0).alias("offset_start_s"),
        duration.alias("offset_end_s"),
        F.lit(16000).cast("long").alias("sample_rate_orig"),
        duration.alias("duration_s"),
        F.lit("CC0-1.0").alias("license"),
        F.concat(F.lit("spk"), k.cast("string"), F.lit("-"), F.col("lang"), F.lit("-"), (F.floor(i / 20) % 6).cast("string")).alias("speaker_id_raw"),
        F.when(F.col("lang") == "en", english).when(F.col("lang") == "es", "Spanish").when(F.col("lang") == "fr", "Mandarin").otherwise(F.when(k % 4 == 0, "").otherwise("German")).alias("accent_raw"),
        F.col("text").alias("transcript"),
        ((i % 10) / 10).alias("vad_speech_ratio"),
        (i % 40 - 5).cast("double").alias("snr_proxy_db"),
        F.lit("en").alias("lang"),
        F.when(i % 13 == 0, 0.5).otherwise(0.9).alias("lang_prob"),
    )


def qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_filters(clips(spark, sf_dir), TAXONOMY)
    return out.withColumn("speaker_key", speaker_key(F.col("source"), F.col("speaker_id_raw")))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits(qc(spark, sf_dir))


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_splits_leaky(qc(spark, sf_dir))


TYPES = "(SELECT list_sort(list(DISTINCT event_type)) FROM events)"


def _types(events: DataFrame) -> DataFrame:
    return events.agg(F.sort_array(F.collect_set("event_type")).alias("y"))  # one row


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    i, y = F.col("event_id"), F.col("y")
    at = lambda m: F.get(y, ((i * m) % 5).cast("int"))
    rows = events.crossJoin(F.broadcast(_types(events)))
    return rows.select(
        F.concat(F.lit("ev:"), i.cast("string")).alias("clip_id"),
        F.col("event_type").alias("prior_label"),
        F.element_at(F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")), (i % 3 + 1).cast("int")).alias("evidence_level"),
        F.array(F.when(i % 4 < 2, F.col("event_type")).otherwise(at(7)), F.when(i % 7 < 5, F.col("event_type")).otherwise(at(3)), at(11)).alias("qwen_votes"),
        F.when(i % 6 < 5, F.col("event_type")).otherwise(at(13)).alias("human_label"),
    )


#: Arms of predictions: (arm, multiplier), seeds 0 to 2 added to it.
ARMS = [("a_gold", 7919), ("b_gold_oversampled", 7907), ("c_gold_weak", 7901)]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, seed, clip_id, speaker_key, source, y_true, y_pred."""
    events = table(spark, sf_dir, "events")
    i = F.col("event_id")
    runs = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("seed"), F.lit(m + 2 * s).alias("m"), F.lit(6 + k).alias("good")) for k, (a, m) in enumerate(ARMS) for s in range(3)])
    rows = events.crossJoin(F.broadcast(_types(events))).withColumn("r", F.explode(runs))
    wrong = F.get(F.col("y"), ((i * 31) % 5).cast("int"))
    return rows.select(
        "r.arm",
        "r.seed",
        i.alias("clip_id"),
        F.col("user_id").cast("string").alias("speaker_key"),
        (F.col("user_id") % 4).cast("string").alias("source"),
        F.col("event_type").alias("y_true"),
        F.when((i * F.col("r.m")) % 10 < F.col("r.good"), F.col("event_type")).otherwise(wrong).alias("y_pred"),
    )


def classes_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One arm and seed of predictions in the manifest's own classes: y_true, y_pred, source."""
    rows = table(spark, sf_dir, "documents")
    labels = F.array(*[F.lit(x) for x in ("en-US", "en-GB", "en-AU", "en-IN", "L1-Mandarin", "L1-Spanish", "L1-Korean", "L1-Arabic")])
    i = F.col("doc_id")
    return rows.select(i.alias("clip_id"), F.get(labels, ((i * 7) % 8).cast("int")).alias("y_true"), F.get(labels, (F.when(i % 3 == 0, i * 5).otherwise(i * 7) % 8).cast("int")).alias("y_pred"), "source")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("youtube:"), F.col("vec_id").cast("string")).alias("speaker_key"), "embedding", "label")


# The same views in SQL.

_TAX = ", ".join(f"('{k}', '{v}')" for k, v in TAXONOMY.mapping.items())
CLIPS = f"""
k AS (SELECT *, CAST(substr(source, 4) AS INT) AS k FROM documents),
clips AS (
  SELECT 'doc:' || doc_id AS clip_id, doc_id,
    CASE WHEN doc_id % 23 = 0 THEN 'youtube' WHEN k // 5 = 0 THEN 'common_voice' WHEN k // 5 = 1 THEN 'globe' WHEN k // 5 = 2 THEN 'l2_arctic' ELSE 'edacc' END AS source,
    CAST(n_chars AS DOUBLE) / 100.0 AS duration_s,
    'spk' || k || '-' || lang || '-' || ((doc_id // 20) % 6) AS speaker_id_raw,
    CASE lang WHEN 'en' THEN CASE k % 5 WHEN 0 THEN 'United States English' WHEN 1 THEN ' England  English ' WHEN 2 THEN 'Australian English' WHEN 3 THEN 'Indian English' ELSE 'Scottish English' END
      WHEN 'es' THEN 'Spanish' WHEN 'fr' THEN 'Mandarin' ELSE CASE WHEN k % 4 = 0 THEN '' ELSE 'German' END END AS accent_raw,
    text AS transcript, CAST(doc_id % 10 AS DOUBLE) / 10 AS vad, CAST(doc_id % 40 - 5 AS DOUBLE) AS snr, CASE WHEN doc_id % 13 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS prob
  FROM k),
tax(key, label) AS (VALUES {_TAX}),
keyed AS (SELECT *, trim(regexp_replace(lower(accent_raw), '\\s+', ' ', 'g')) AS key FROM clips),
labelled AS (SELECT keyed.*, tax.label AS accent_label FROM keyed LEFT JOIN tax USING (key))"""
QC = f"""{CLIPS},
qc AS (
  SELECT *, source || ':' || speaker_id_raw AS speaker_key, CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status
  FROM (SELECT *, CASE WHEN accent_label IS NULL THEN 'unmapped_accent' WHEN duration_s < 5 THEN 'too_short' WHEN duration_s > 30 THEN 'too_long'
    WHEN vad < 0.5 THEN 'low_vad' WHEN snr < 10 THEN 'low_snr_proxy' WHEN prob < 0.8 THEN 'not_english' END AS reject_reason FROM labelled))"""
SPEAKERS = f"""{QC},
pool AS (SELECT * FROM qc WHERE status = 'accepted' AND source NOT IN ('edacc', 'youtube')),
lab AS (SELECT speaker_key, accent_label, row_number() OVER (PARTITION BY speaker_key ORDER BY count(*) DESC, accent_label) AS r FROM pool GROUP BY 1, 2),
speakers AS (SELECT p.speaker_key, any_value(lab.accent_label) AS accent_label, min(p.source) AS source FROM pool p JOIN lab ON lab.speaker_key = p.speaker_key AND lab.r = 1 GROUP BY 1)"""
SPLITS = f"""{SPEAKERS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY accent_label, source ORDER BY md5('17:' || speaker_key), speaker_key) AS pos, count(*) OVER (PARTITION BY accent_label, source) AS n FROM speakers),
q0 AS (SELECT *, greatest(1, CAST(round_even(n * 0.1, 0) AS INT)) AS t0 FROM ranked),
q1 AS (SELECT *, greatest(0, 2 * t0 - (n - 1)) AS e FROM q0),
q2 AS (SELECT *, least(e, t0 - 1) AS ev FROM q1),
q3 AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE t0 - least(e - ev, t0 - 1) END AS nt, CASE WHEN n <= 2 THEN 0 ELSE t0 - ev END AS nv FROM q2),
placed AS (SELECT speaker_key, CASE WHEN pos <= nt THEN 'test' WHEN pos <= nt + nv THEN 'val' ELSE 'train' END AS s FROM q3),
ls(source, label_source) AS (VALUES ('l2_arctic', 'gold'), ('edacc', 'gold'), ('common_voice', 'self_report'), ('globe', 'self_report'), ('youtube', 'weak')),
splits AS (
  SELECT qc.*, ls.label_source, CASE WHEN status <> 'accepted' THEN 'unassigned' WHEN qc.source = 'edacc' THEN 'ood_test' WHEN qc.source = 'youtube' THEN 'train' ELSE coalesce(placed.s, 'unassigned') END AS split
  FROM qc LEFT JOIN placed USING (speaker_key) JOIN ls ON ls.source = qc.source)"""
LEAKY = f"""{QC},
shuffled AS (SELECT clip_id, row_number() OVER (ORDER BY md5('17:' || clip_id), clip_id) AS pos, count(*) OVER () AS n FROM qc WHERE status = 'accepted'),
leaky AS (
  SELECT qc.*, CASE WHEN pos IS NULL THEN 'unassigned' WHEN pos <= round_even(n * 0.8, 0) THEN 'train' WHEN pos <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split
  FROM qc LEFT JOIN shuffled USING (clip_id))"""
VOTES = f"""
votes AS (
  SELECT 'ev:' || event_id AS clip_id, event_type AS prior_label, ['E1', 'E2', 'E3'][event_id % 3 + 1] AS evidence_level,
    [CASE WHEN event_id % 4 < 2 THEN event_type ELSE y[(event_id * 7) % 5 + 1] END, CASE WHEN event_id % 7 < 5 THEN event_type ELSE y[(event_id * 3) % 5 + 1] END, y[(event_id * 11) % 5 + 1]] AS votes,
    CASE WHEN event_id % 6 < 5 THEN event_type ELSE y[(event_id * 13) % 5 + 1] END AS human_label
  FROM events, (SELECT {TYPES} AS y))"""
DECIDED = f"""{VOTES},
counted AS (SELECT *, CAST(len(list_filter(votes, lambda v: v = prior_label)) AS DOUBLE) / 3 AS share FROM votes),
decided AS (
  SELECT *, CASE WHEN evidence_level = 'E3' THEN 'rejected' WHEN share >= 2.0 / 3 - 1e-12 THEN 'accepted' ELSE 'review' END AS status,
    CASE WHEN evidence_level <> 'E3' AND share >= 2.0 / 3 - 1e-12 THEN prior_label END AS accent_label,
    CASE WHEN evidence_level = 'E3' THEN 'evidence_E3' END AS reject_reason,
    CASE WHEN evidence_level <> 'E3' AND share >= 2.0 / 3 - 1e-12 THEN share * CASE evidence_level WHEN 'E1' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END ELSE 0.0::DOUBLE END AS consensus_score
  FROM counted)"""
_ARMS = ", ".join(f"('{a}', {s}, {m + 2 * s}, {6 + k})" for k, (a, m) in enumerate(ARMS) for s in range(3))
PREDS = f"""
runs(arm, seed, m, good) AS (VALUES {_ARMS}),
preds AS (
  SELECT arm, seed, event_id AS clip_id, CAST(user_id AS VARCHAR) AS speaker_key, CAST(user_id % 4 AS VARCHAR) AS source, event_type AS y_true,
    CASE WHEN (event_id * m) % 10 < good THEN event_type ELSE y[(event_id * 31) % 5 + 1] END AS y_pred
  FROM events, (SELECT {TYPES} AS y), runs)"""
CLASSES = """
l AS (SELECT ['en-US', 'en-GB', 'en-AU', 'en-IN', 'L1-Mandarin', 'L1-Spanish', 'L1-Korean', 'L1-Arabic'] AS l),
own AS (SELECT doc_id AS clip_id, l[(doc_id * 7) % 8 + 1] AS y_true, l[CASE WHEN doc_id % 3 = 0 THEN doc_id * 5 ELSE doc_id * 7 END % 8 + 1] AS y_pred, source FROM documents, l)"""
