"""Queries over manifests: scans, mapping, the quality cascade, reports, splits, sets to emit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import encoder_frames, six, warmup_cosine, wilson
from ..functions.text import augmented_name, banned_phrase, base_clip, clip_name, l1_or_accent, normalise_key, parse_label, split_accents, token_set
from ..operators import emit, reports, split
from ..operators.quality import drop_small_classes
from ..operators.sample import class_weights, quota_plan
from ..operators.taxonomy import map_labels, misses
from ..operators.validate import violations
from . import views as v

QUERIES: dict = {}
SQL: dict[str, str] = {}
SIX = "floor({0} * 1e6 + 0.5) / 1e6"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def six_sql(expr: str, name: str) -> str:
    return f"{SIX.format('(' + expr + ')')} AS {name}"


def rounded(df, *columns: str):
    return df.withColumns({c: six(F.col(c)) for c in columns})


MATRIX = f"""m AS (
  SELECT source, accent_label, count(DISTINCT speaker_id_raw) AS n_speakers, count(*) AS n_clips, sum(duration_s) / 3600 AS hours,
    quantile_cont(duration_s, 0.5) AS med, quantile_cont(duration_s, 0.1) AS p10, quantile_cont(duration_s, 0.9) AS p90
  FROM labelled WHERE accent_label IS NOT NULL GROUP BY 1, 2)"""


def _labelled(s, d):
    return map_labels(v.clips(s, d), v.TAXONOMY)


def _matrix(s, d):
    return reports.source_accent_matrix(_labelled(s, d))


@query(
    "A1_source_accent_matrix",
    f"WITH {v.CLIPS}, {MATRIX} SELECT source, accent_label, n_speakers, n_clips, {six_sql('hours', 'hours')}, {six_sql('med', 'median_duration_s')}, {six_sql('p10', 'p10_duration_s')}, {six_sql('p90', 'p90_duration_s')} FROM m",
)
def _(s, d):
    return rounded(_matrix(s, d), "hours", "median_duration_s", "p10_duration_s", "p90_duration_s")


@query(
    "A2_confounded",
    f"""WITH {v.CLIPS}, {MATRIX}, r AS (SELECT accent_label, count(*) OVER (PARTITION BY accent_label) AS n_sources, source AS dominant_source,
  hours / sum(hours) OVER (PARTITION BY accent_label) AS share, row_number() OVER (PARTITION BY accent_label ORDER BY hours DESC, source) AS r FROM m)
SELECT accent_label, n_sources, dominant_source, {six_sql('share', 'dominant_share')}, share > 0.9 AS confounded FROM r WHERE r = 1""",
)
def _(s, d):
    return rounded(reports.confounded(_matrix(s, d)), "dominant_share")


@query(
    "A3_duration_confound",
    f"""WITH {v.CLIPS}, {MATRIX}, c AS (SELECT accent_label, min(p10) AS p10, max(p90) AS p90 FROM m GROUP BY 1)
SELECT a.accent_label, {six_sql('any_value(a.p10)', 'p10_duration_s')}, {six_sql('any_value(a.p90)', 'p90_duration_s')},
  CAST(count(b.accent_label) FILTER (WHERE b.p10 <= a.p90 AND b.p90 >= a.p10) AS INT) AS n_overlapping_classes,
  count(b.accent_label) > 0 AND count(b.accent_label) FILTER (WHERE b.p10 <= a.p90 AND b.p90 >= a.p10) = 0 AS duration_disjoint
FROM c a LEFT JOIN c b ON a.accent_label <> b.accent_label GROUP BY 1""",
)
def _(s, d):
    return rounded(reports.duration_confound(_matrix(s, d)), "p10_duration_s", "p90_duration_s")


@query(
    "A4_class_coverage",
    f"""WITH {v.CLIPS}, dom AS (SELECT unnest(['en-US', 'en-GB', 'en-AU', 'en-IN', 'L1-Mandarin', 'L1-Spanish', 'L1-Korean', 'L1-Arabic']) AS accent_label),
a AS (SELECT accent_label, count(DISTINCT speaker_id_raw) AS s, count(*) AS c, sum(duration_s) / 3600 AS h FROM labelled WHERE source = 'edacc' AND accent_label IS NOT NULL GROUP BY 1)
SELECT accent_label, coalesce(s, 0) AS n_speakers, coalesce(c, 0) AS n_clips, {six_sql('coalesce(h, 0)', 'hours')}, coalesce(s, 0) >= 5 AS include FROM dom LEFT JOIN a USING (accent_label)""",
)
def _(s, d):
    return rounded(reports.class_coverage(_labelled(s, d).where("source = 'edacc'")), "hours")


@query("P4_taxonomy_map", f"WITH {v.CLIPS} SELECT clip_id, accent_label, 'v1' AS taxonomy_version FROM labelled")
def _(s, d):
    return _labelled(s, d).select("clip_id", "accent_label", "taxonomy_version")


@query("A14_taxonomy_misses", f"WITH {v.CLIPS} SELECT key, count(*) AS n FROM labelled WHERE accent_label IS NULL AND key <> '' GROUP BY 1")
def _(s, d):
    return misses(v.clips(s, d), v.TAXONOMY)


@query("O4_top_misses", f"WITH {v.CLIPS} SELECT key, count(*) AS n FROM labelled WHERE accent_label IS NULL AND key <> '' GROUP BY 1 ORDER BY n DESC, key LIMIT 1")
def _(s, d):
    return misses(v.clips(s, d), v.TAXONOMY, top=1)


@query(
    "P6_filter_cascade",
    f"""WITH {v.QC} SELECT clip_id, accent_label, status, reject_reason,
  CASE WHEN coalesce(reject_reason, '') NOT IN ('unmapped_accent', 'too_short', 'too_long') THEN vad END AS vad_speech_ratio,
  CASE WHEN coalesce(reject_reason, '') NOT IN ('unmapped_accent', 'too_short', 'too_long', 'low_vad') THEN snr END AS snr_proxy_db,
  CASE WHEN coalesce(reject_reason, '') IN ('', 'not_english') THEN prob END AS lang_prob, CASE WHEN coalesce(reject_reason, '') IN ('', 'not_english') THEN length(transcript) END AS n_transcript FROM qc""",
)
def _(s, d):
    return v.qc(s, d).select("clip_id", "accent_label", "status", "reject_reason", "vad_speech_ratio", "snr_proxy_db", "lang_prob", F.length("transcript").cast("long").alias("n_transcript"))


@query("A10_reject_reasons", f"WITH {v.QC} SELECT reject_reason, count(*) AS n FROM qc WHERE reject_reason IS NOT NULL GROUP BY 1")
def _(s, d):
    return reports.value_counts(v.qc(s, d), "reject_reason")


@query("A12_acceptance_rate", f"WITH {v.QC} SELECT {six_sql('avg(CASE WHEN status = ' + chr(39) + 'accepted' + chr(39) + ' THEN 1.0 ELSE 0.0 END)', 'acceptance_rate')} FROM qc")
def _(s, d):
    return rounded(reports.acceptance_rate(v.qc(s, d)), "acceptance_rate")


@query(
    "A16_fetch_summary",
    f"WITH {v.QC} SELECT accent_label, count(*) AS n_clips, count(DISTINCT speaker_id_raw) AS n_speakers, {six_sql('sum(duration_s) / 3600', 'hours')} FROM qc WHERE status = 'accepted' GROUP BY 1",
)
def _(s, d):
    return rounded(reports.fetch_summary(v.qc(s, d).where("status = 'accepted'")), "hours")


@query(
    "P11_min_speakers",
    f"""WITH {v.QC}, n AS (SELECT accent_label, count(DISTINCT speaker_key) AS n FROM qc WHERE status = 'accepted' GROUP BY 1)
SELECT clip_id, CASE WHEN status = 'accepted' AND n < 12 THEN 'rejected' ELSE status END AS status,
  CASE WHEN status = 'accepted' AND n < 12 THEN 'too_few_speakers_for_smoke_test' ELSE reject_reason END AS reject_reason FROM qc LEFT JOIN n USING (accent_label)""",
)
def _(s, d):
    return drop_small_classes(v.qc(s, d), 12).select("clip_id", "status", "reject_reason")


@query("A5_speaker_table", f"WITH {v.SPEAKERS} SELECT * FROM speakers")
def _(s, d):
    return split.speaker_table(v.qc(s, d).where("status = 'accepted' AND source NOT IN ('edacc', 'youtube')"))


@query("C9_assign_splits", f"WITH {v.SPLITS} SELECT clip_id, speaker_key, label_source, split FROM splits")
def _(s, d):
    return v.splits(s, d).select("clip_id", "speaker_key", "label_source", "split")


@query("C10_leaky_split", f"WITH {v.LEAKY} SELECT clip_id, split FROM leaky")
def _(s, d):
    return v.leaky(s, d).select("clip_id", "split")


@query(
    "C8_quota",
    """WITH n AS (SELECT CAST(range AS INT) AS n FROM range(0, 400)), q0 AS (SELECT n, greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) AS t, greatest(1, CAST(round_even(n * 0.15, 0) AS INT)) AS w FROM n),
q1 AS (SELECT *, greatest(0, t + w - (n - 1)) AS e FROM q0), q2 AS (SELECT *, least(e, w - 1) AS ev FROM q1)
SELECT n, CAST(CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 ELSE t - least(e - ev, t - 1) END AS INT) AS n_test, CAST(CASE WHEN n <= 2 THEN 0 ELSE w - ev END AS INT) AS n_val FROM q2""",
)
def _(s, d):
    test, val = split.quota(F.col("n"), (0.7, 0.15, 0.15))
    return s.range(400).select(F.col("id").cast("int").alias("n")).select("n", test.alias("n_test"), val.alias("n_val"))


ROSTER = """lab2 AS (SELECT speaker_key, accent_label, row_number() OVER (PARTITION BY speaker_key ORDER BY count(*) DESC, accent_label) AS r FROM splits WHERE split <> 'unassigned' GROUP BY 1, 2)"""


@query(
    "A6_roster",
    f"""WITH {v.SPLITS}, {ROSTER} SELECT s.speaker_key, min(s.source) AS source, any_value(lab2.accent_label) AS accent_label, min(s.split) AS split, count(*) AS n_clips
FROM splits s JOIN lab2 ON lab2.speaker_key = s.speaker_key AND lab2.r = 1 WHERE s.split <> 'unassigned' GROUP BY 1""",
)
def _(s, d):
    return split.roster(v.splits(s, d))


@query(
    "A7_test_coverage",
    f"""WITH {v.SPLITS} SELECT accent_label, count(DISTINCT source) AS n_test_sources, count(DISTINCT speaker_key) AS n_test_speakers, count(*) AS n_test_clips, count(DISTINCT source) < 2 AS single_source_test
FROM splits WHERE split = 'test' GROUP BY 1""",
)
def _(s, d):
    return split.test_coverage(v.splits(s, d))


@query("A8_leaking_speakers", f"WITH {v.LEAKY} SELECT speaker_key, count(DISTINCT split) AS n_splits FROM leaky WHERE split <> 'unassigned' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(s, d):
    return split.leaking_speakers(v.leaky(s, d))


@query("J14_shared_speakers", f"WITH {v.LEAKY} SELECT speaker_key FROM leaky WHERE split = 'train' INTERSECT SELECT speaker_key FROM leaky WHERE split = 'test'")
def _(s, d):
    return split.shared_speakers(v.leaky(s, d))


@query(
    "A9_class_by_split",
    f"WITH {v.SPLITS} SELECT accent_label, "
    + ", ".join(f"count(DISTINCT speaker_key) FILTER (WHERE split = '{x}') AS {x}" for x in ("train", "val", "test", "ood_test"))
    + " FROM splits WHERE split <> 'unassigned' GROUP BY 1",
)
def _(s, d):
    return split.class_by_split(v.splits(s, d))


@query("A11_hours_per_split", f"WITH {v.SPLITS} SELECT split, round_even(sum(duration_s) / 3600 * 1000, 0) / 1000 AS hours FROM splits GROUP BY 1")
def _(s, d):
    return reports.hours_per_split(v.splits(s, d))


@query(
    "C17_augment",
    f"""WITH {v.SPLITS}, f(f, t) AS (VALUES (0.9::DOUBLE, '0.9'), (1.1::DOUBLE, '1.1'))
SELECT clip_id, split, {six_sql('duration_s', 'duration_s')}, {six_sql('duration_s', 'offset_end_s')} FROM splits
UNION ALL SELECT clip_id || '#aug-sp' || t, split, {six_sql('duration_s / f', 'duration_s')}, {six_sql('duration_s / f', 'offset_end_s')} FROM splits, f WHERE split = 'train'""",
)
def _(s, d):
    return rounded(emit.augment_train(v.splits(s, d)).select("clip_id", "split", "duration_s", "offset_end_s"), "duration_s", "offset_end_s")


_VARIANT_SQL = {
    "a_gold": "split IN ('val', 'test', 'ood_test') OR label_source <> 'weak'",
    "b_gold_oversampled": "split IN ('val', 'test', 'ood_test') OR label_source <> 'weak'",
    "c_gold_weak": "true",
    "loso_l2": "(split IN ('val', 'test', 'ood_test') OR label_source <> 'weak') AND (split IN ('val', 'test', 'ood_test') OR source <> 'l2_arctic')",
}
for _name, _where in _VARIANT_SQL.items():

    @query(f"P10_variant_{_name}", f"WITH {v.SPLITS} SELECT clip_id, split FROM splits WHERE {_where}")
    def _(s, d, name=_name):
        return emit.variant(v.splits(s, d), name).select("clip_id", "split")


@query(
    "A13_emit_stats",
    f"""WITH {v.SPLITS} SELECT 'n_total' AS stat, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM splits
UNION ALL SELECT 'n_weak_train', '', CAST(count(*) FILTER (WHERE split = 'train' AND label_source = 'weak') AS DOUBLE) FROM splits
UNION ALL SELECT 'per_split', split, CAST(count(*) AS DOUBLE) FROM splits GROUP BY 2
UNION ALL SELECT 'per_class_train', accent_label, CAST(count(*) AS DOUBLE) FROM splits WHERE split = 'train' GROUP BY 2
UNION ALL SELECT 'hours_per_split', split, round_even(sum(duration_s) / 3600 * 1000, 0) / 1000 FROM splits GROUP BY 2""",
)
def _(s, d):
    row = emit.stats(v.splits(s, d), "c_gold_weak")
    pairs = lambda name: F.transform(F.map_entries(name), lambda e: F.struct(F.lit(name).alias("stat"), e["key"].alias("key"), e["value"].cast("double").alias("value")))
    one = lambda name: F.array(F.struct(F.lit(name).alias("stat"), F.lit("").alias("key"), F.col(name).cast("double").alias("value")))
    return row.select(F.explode(F.concat(one("n_total"), one("n_weak_train"), pairs("per_split"), pairs("per_class_train"), pairs("hours_per_split"))).alias("x")).select("x.*")


@query(
    "E14_train_items",
    f"""WITH {v.SPLITS}, a AS (SELECT clip_id, clip_id AS base_id, 1.0::DOUBLE AS speed, accent_label, duration_s FROM splits WHERE split = 'train'
  UNION ALL SELECT clip_id || '#aug-sp0.9', clip_id, 0.9::DOUBLE, accent_label, duration_s / 0.9::DOUBLE FROM splits WHERE split = 'train'), n AS (SELECT *, CAST(round_even(duration_s * 16000, 0) AS BIGINT) AS n FROM a)
SELECT clip_id, base_id, speed, CAST(list_position(['en-US', 'en-GB', 'en-AU', 'en-IN', 'L1-Mandarin', 'L1-Spanish', 'L1-Korean', 'L1-Arabic'], accent_label) - 1 AS INT) AS label,
  CASE WHEN n > 480000 THEN (n - 480000) // 2 ELSE 0 END AS crop_start, least(n, 480000) AS crop_len FROM n""",
)
def _(s, d):
    return emit.train_items(emit.augment_train(v.splits(s, d), (0.9,)))


@query(
    "C21_violations",
    f"""WITH {v.CLIPS}, bad AS (SELECT CASE WHEN doc_id % 50 = 1 THEN 'doc:0' ELSE clip_id END AS clip_id, CASE WHEN doc_id % 31 = 0 THEN 'radio' ELSE source END AS source,
  CASE WHEN doc_id % 37 = 0 THEN 0.0 ELSE duration_s END AS duration_s, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE speaker_id_raw END AS speaker_id_raw, duration_s AS offset_end_s FROM clips)
SELECT 'known' AS rule, 'source' AS column, clip_id FROM bad WHERE source NOT IN ('common_voice', 'globe', 'l2_arctic', 'edacc', 'youtube')
UNION ALL SELECT 'above_0', 'duration_s', clip_id FROM bad WHERE NOT duration_s > 0
UNION ALL SELECT 'not_null', 'speaker_id_raw', clip_id FROM bad WHERE speaker_id_raw IS NULL
UNION ALL SELECT 'above_0', 'offset_end_s', clip_id FROM bad WHERE NOT offset_end_s > 0
UNION ALL SELECT 'unique', 'clip_id', clip_id FROM bad GROUP BY clip_id HAVING count(*) > 1""",
)
def _(s, d):
    i = F.substring_index("clip_id", ":", -1).cast("long")
    bad = v.clips(s, d).withColumn("i", i).withColumns(
        {
            "source": F.when(F.col("i") % 31 == 0, "radio").otherwise(F.col("source")),
            "duration_s": F.when(F.col("i") % 37 == 0, 0.0).otherwise(F.col("duration_s")),
            "speaker_id_raw": F.when(F.col("i") % 41 != 0, F.col("speaker_id_raw")),
            "clip_id": F.when(F.col("i") % 50 == 1, "doc:0").otherwise(F.col("clip_id")),
        }
    )
    return violations(bad.drop("i"), "raw")


@query("W6_quota_plan", "SELECT event_type AS label, least(count(*), 2000) AS take FROM events GROUP BY 1")
def _(s, d):
    return quota_plan(v.table(s, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")), 2000)


@query("A31_class_weights", f"WITH {v.QC} SELECT clip_id, {six_sql('1.0 / count(*) OVER (PARTITION BY accent_label)', 'weight')} FROM qc WHERE status = 'accepted'")
def _(s, d):
    return rounded(class_weights(v.qc(s, d).where("status = 'accepted'")).select("clip_id", "weight"), "weight")


@query(
    "F_text",
    """WITH t AS (SELECT doc_id, source, lang, source || ', ' || lang || ' (a, b), x' AS raw, text FROM documents)
SELECT doc_id, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS key, 3 AS n_accents, source || '#aug-sp0.9' AS aug, source AS base, source || ':' || lang || ':' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS clip,
  CASE WHEN doc_id % 4 = 0 THEN 'L1-Korean' ELSE 'unsure' END AS reply, CASE WHEN doc_id % 2 = 0 THEN 'Welsh' ELSE 'b' END AS l1, doc_id % 3 = 0 AS banned,
  CAST(len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[^ -~]', 'x', 'g'), ' +'), lambda w: w <> ''))) AS INT) AS n_words FROM t""",
)
def _(s, d):
    i = F.col("doc_id")
    raw = F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit(" (a, b), x"))
    reply = F.when(i % 4 == 0, "I hear l1-KOREAN.").when(i % 4 == 1, "en-US or en-GB").otherwise("no idea")
    line = F.when(i % 3 == 0, "A State-of-the-Art result").otherwise("sotas aside")
    return v.table(s, d, "documents").select(
        "doc_id", normalise_key(raw).alias("key"), F.size(split_accents(raw)).alias("n_accents"), augmented_name(F.col("source"), F.lit(0.9)).alias("aug"),
        base_clip(augmented_name(F.col("source"), F.lit(0.9))).alias("base"), F.concat_ws(":", "source", "lang", F.lpad(i.cast("string"), 6, "0")).alias("clip"),
        parse_label(reply).alias("reply"), l1_or_accent(F.when(i % 2 == 0, " Welsh ").otherwise("English"), F.lit(" b ")).alias("l1"), (F.size(banned_phrase(line)) > 0).alias("banned"),
        F.size(token_set(F.regexp_replace("text", "[^ -~]", "x"))).alias("n_words"),
    )


@query(
    "F_numeric",
    f"""WITH n AS (SELECT CAST(range AS INT) AS n FROM range(0, 2000))
SELECT n, CAST(least((n - 1) // 2 + 1, 1500) AS BIGINT) AS frames, {six_sql('CASE WHEN n < 100 THEN n / 100.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * (n - 100) / 1900.0::DOUBLE)) END', 'lr')},
  {six_sql('CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, ((n // 2) / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt((n // 2) / n::DOUBLE * (1 - (n // 2) / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) END', 'low')},
  {six_sql('CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, ((n // 2) / n::DOUBLE + 3.8416 / (2 * n) + 1.96 * sqrt((n // 2) / n::DOUBLE * (1 - (n // 2) / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) END', 'high')} FROM n WHERE n > 0""",
)
def _(s, d):
    n = F.col("n")
    ci = wilson(F.floor(n / 2), n)
    out = s.range(1, 2000).select(F.col("id").cast("int").alias("n")).select("n", encoder_frames(n).alias("frames"), warmup_cosine(n, 2000, 100).alias("lr"), ci.alias("ci"))
    return rounded(out.select("n", "frames", "lr", F.col("ci.low").alias("low"), F.col("ci.high").alias("high")), "lr", "low", "high")


__all__ = ["QUERIES", "SQL", "clip_name"]
