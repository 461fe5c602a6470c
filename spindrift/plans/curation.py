"""Queries over samples, weak labels, speakers and near-duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.audio import snr_proxy_expr, speech_ratio_expr
from ..functions.numeric import masked_mean
from ..operators import dedup, weaklabel
from ..operators.graph import connected_components
from ..operators.sample import stratified_sample, two_cap_sample, weighted_draws
from . import views as v
from .manifest import rounded, six_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _stream(s, d):
    return v.table(s, d, "events").select(F.col("event_id").alias("stream_idx"), F.col("event_type").alias("label"), F.col("user_id").alias("speaker"))


_CAPS = """r AS (SELECT event_id AS stream_idx, event_type AS label, user_id AS speaker, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS rs FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY stream_idx) AS rc FROM r WHERE rs <= 5), kept AS (SELECT * FROM c WHERE rc <= 400)"""


@query("R1_two_cap_sampler", f"WITH {_CAPS} SELECT stream_idx, label, speaker FROM kept")
def _(s, d):
    return two_cap_sample(_stream(s, d), 400, 5)


@query(
    "R1_two_cap_early_stop",
    f"""WITH {_CAPS}, ex AS (SELECT list_sort(list(DISTINCT event_type))[1:2] AS e FROM events), m AS (SELECT max(stream_idx) AS m, count(*) AS n FROM kept, ex WHERE rc = 400 AND list_contains(e, label)),
f AS (SELECT label, stream_idx AS f FROM kept WHERE rc = 400), stop AS (SELECT min(r.stream_idx) AS z FROM r JOIN f USING (label), m WHERE n = 2 AND r.stream_idx > m AND r.stream_idx > f)
SELECT stream_idx, label, speaker FROM kept, stop WHERE z IS NULL OR stream_idx < z""",
)
def _(s, d):
    stream = _stream(s, d)
    first = [r["label"] for r in stream.select("label").distinct().orderBy("label").limit(2).collect()]
    return two_cap_sample(stream, 400, 5, expected=first)


@query("R1_two_cap_max_rows", f"WITH {_CAPS.replace('FROM events', 'FROM events WHERE event_id < 1500')} SELECT stream_idx, label, speaker FROM kept")
def _(s, d):
    return two_cap_sample(_stream(s, d), 400, 5, max_rows=1500)


@query("W5_stratified_sample", f"WITH {v.QC}, r AS (SELECT clip_id, accent_label, row_number() OVER (PARTITION BY accent_label ORDER BY md5('0:' || clip_id), clip_id) AS r FROM qc WHERE accent_label IS NOT NULL) SELECT clip_id, accent_label FROM r WHERE r <= 25")
def _(s, d):
    return stratified_sample(v.qc(s, d), "accent_label", 25).select("clip_id", "accent_label")


@query("E12_balanced_draws")
def _(s, d):
    return weighted_draws(v.qc(s, d).where("status = 'accepted'"), 500)


@query("C12_consensus", f"WITH {v.DECIDED} SELECT clip_id, status, accent_label, reject_reason, {six_sql('consensus_score', 'consensus_score')}, CASE WHEN status = 'accepted' THEN 'train' ELSE 'unassigned' END AS split, 'weak' AS label_source FROM decided")
def _(s, d):
    out = weaklabel.decide(v.votes(s, d)).select("clip_id", "status", "accent_label", "reject_reason", "consensus_score", "split", "label_source")
    return rounded(out, "consensus_score")


_AUDIT = f"""{v.DECIDED},
ac AS (SELECT clip_id, prior_label, accent_label, human_label, reject_reason, 'accepted' AS pool, row_number() OVER (PARTITION BY accent_label ORDER BY md5('0:' || clip_id), clip_id) AS r FROM decided WHERE status = 'accepted'),
re AS (SELECT clip_id, prior_label, accent_label, human_label, coalesce(reject_reason, 'disagrees') AS reject_reason, 'rejected' AS pool,
  row_number() OVER (PARTITION BY coalesce(reject_reason, 'disagrees') ORDER BY md5('0:' || clip_id), clip_id) AS r FROM decided WHERE status <> 'accepted'),
audit AS (SELECT * FROM ac WHERE r <= 25 UNION ALL SELECT * FROM re WHERE r <= 25)"""


def _audit(s, d):
    return weaklabel.draw_audit(weaklabel.decide(v.votes(s, d)), review_reason="disagrees")


@query("C13_audit_sample", f"WITH {_AUDIT} SELECT clip_id, pool, reject_reason FROM audit")
def _(s, d):
    return _audit(s, d).select("clip_id", "pool", "reject_reason")


@query("P14_blind_sample", f"WITH {_AUDIT} SELECT clip_id, pool, '' AS human_label FROM audit")
def _(s, d):
    return weaklabel.blind(_audit(s, d))


@query(
    "A22_audit_precision",
    f"""WITH {_AUDIT}, p AS (SELECT accent_label, count(*) AS n, count(*) FILTER (WHERE human_label = accent_label) AS c FROM audit WHERE pool = 'accepted' GROUP BY 1),
w AS (SELECT *, c / n::DOUBLE AS p, 3.8416 / n AS z FROM p)
SELECT accent_label, n, {six_sql('p', 'precision')}, {six_sql('greatest(0.0, (p + z / 2 - 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n))) / (1 + z))', 'ci_low')},
  {six_sql('least(1.0, (p + z / 2 + 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n))) / (1 + z))', 'ci_high')}, p < 0.8 AS killed FROM w""",
)
def _(s, d):
    return rounded(weaklabel.accepted_precision(_audit(s, d)), "precision", "ci_low", "ci_high")


@query("A23_false_rejects", f"WITH {_AUDIT} SELECT reject_reason, {six_sql('avg(CASE WHEN human_label = prior_label THEN 1.0 ELSE 0.0 END)', 'false_reject_rate')} FROM audit WHERE pool = 'rejected' GROUP BY 1")
def _(s, d):
    return rounded(weaklabel.false_rejects(_audit(s, d)), "false_reject_rate")


_SIM = """e AS (SELECT 'youtube:' || vec_id AS key, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.key AS src, b.key AS dst, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS sim FROM e a JOIN e b ON a.key <> b.key),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM s WHERE sim >= 0.45) WHERE r <= 20)"""


@query("C3_candidate_edges", f"WITH {_SIM} SELECT src, dst, floor(sim * 1e4 + 0.5) / 1e4 AS sim FROM edges")
def _(s, d):
    return dedup.nearest(v.centroids(s, d)).withColumn("sim", F.floor(F.col("sim") * 1e4 + 0.5) / 1e4)


_COMPONENTS = f"""RECURSIVE {_SIM}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a AS node, a AS other FROM u UNION SELECT reach.node, u.b FROM reach JOIN u ON u.a = reach.other), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""


@query("C4_components", f"WITH {_COMPONENTS} SELECT node, component FROM comp")
def _(s, d):
    return connected_components(dedup.nearest(v.centroids(s, d)))


@query(
    "C5_merge_speakers",
    f"WITH {_COMPONENTS}, k AS (SELECT 'doc:' || doc_id AS clip_id, CASE WHEN doc_id % 3 = 0 THEN 'edacc' ELSE 'youtube' END AS source, 'youtube:' || (doc_id % 500) AS speaker_key FROM documents) SELECT clip_id, source, CASE WHEN source = 'youtube' THEN coalesce(component, speaker_key) ELSE speaker_key END AS speaker_key FROM k LEFT JOIN comp ON comp.node = k.speaker_key",
)
def _(s, d):
    i = F.col("doc_id")
    rows = v.table(s, d, "documents").select(
        F.concat(F.lit("doc:"), i.cast("string")).alias("clip_id"), F.when(i % 3 == 0, "edacc").otherwise("youtube").alias("source"), F.concat(F.lit("youtube:"), (i % 500).cast("string")).alias("speaker_key")
    )
    return dedup.merge_speakers(rows, v.centroids(s, d))


_NEAR = """w AS (SELECT 'doc:' || doc_id AS clip_id, CAST(n_chars AS DOUBLE) / 100 AS d, list_distinct(list_filter(regexp_split_to_array(regexp_replace(text, '[^ -~]', 'x', 'g'), ' +'), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT a.clip_id AS a, b.clip_id AS b, len(list_intersect(a.t, b.t)) AS i, len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) AS u FROM w a JOIN w b
  ON b.d - a.d BETWEEN 0 AND 0.5 AND (a.d < b.d OR a.clip_id < b.clip_id) AND a.clip_id <> b.clip_id AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)) - 1e-9 AND len(a.t) > 0)"""


def _spoken(s, d):
    return v.table(s, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("clip_id"), (F.col("n_chars") / F.lit(100.0)).alias("duration_s"), F.regexp_replace("text", "[^ -~]", "x").alias("transcript"))


@query("J7_near_pairs", f"WITH {_NEAR} SELECT a, b, {six_sql('i / u::DOUBLE', 'jaccard')} FROM pairs WHERE i / u::DOUBLE >= 0.8")
def _(s, d):
    return rounded(dedup.near_pairs(_spoken(s, d)), "jaccard")


@query("C6_near_duplicates")
def _(s, d):
    rows = _spoken(s, d).withColumns({"status": F.lit("accepted"), "reject_reason": F.lit(None).cast("string")})
    return dedup.reject_near_duplicates(rows).select("clip_id", "status", "reject_reason")


_CAL = "c AS (SELECT CAST((vec_id * 37) % 1000 AS DOUBLE) / 1000 AS similarity, CASE WHEN label < 3 THEN 'same_speaker' ELSE 'cross_source_negative' END AS pair_type FROM embeddings)"


@query("A30_threshold", f"WITH {_CAL}, t AS (SELECT DISTINCT similarity AS t FROM c) SELECT coalesce(min(t), 1.0) AS threshold FROM t WHERE (SELECT avg(CASE WHEN similarity >= t THEN 1.0 ELSE 0.0 END) FROM c WHERE pair_type = 'cross_source_negative') <= 0.01")
def _(s, d):
    sim = ((F.col("vec_id") * 37) % 1000 / F.lit(1000.0)).alias("similarity")
    rows = v.table(s, d, "embeddings")
    return dedup.suggest_threshold(dedup.calibration_table(rows.where("label < 3").select(sim), rows.where("label >= 3").select(sim)), 0.01)


@query(
    "P8_speech_ratio_and_snr",
    f"""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) * 4 AS a, CAST(label AS BIGINT) * 4 + 20 AS b FROM embeddings),
p AS (SELECT vec_id, a, b, list_avg(list_transform(v[a + 1:b], lambda z: z * z)) AS s, list_avg(list_transform(list_concat(v[1:a], v[b + 1:]), lambda z: z * z)) AS n FROM x)
SELECT vec_id, {six_sql('(b - a) / 64.0', 'vad_speech_ratio')}, {six_sql('10 * log10(s / n)', 'snr_proxy_db')} FROM p""",
)
def _(s, d):
    at = (F.col("label") * 4).cast("long")
    segments = F.array(F.struct(at.alias("start"), (at + 20).alias("end")))
    samples = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    out = v.table(s, d, "embeddings").select("vec_id", speech_ratio_expr(segments, F.size("embedding")).alias("vad_speech_ratio"), snr_proxy_expr(samples, segments).alias("snr_proxy_db"))
    return rounded(out, "vad_speech_ratio", "snr_proxy_db")


@query(
    "E13_masked_mean",
    f"WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label % 4 AS n FROM embeddings) SELECT vec_id, {six_sql('CASE WHEN n = 0 THEN 0.0 ELSE list_sum(list_transform(range(0, n), lambda i: v[i * 16 + 1])) / n END', 'first')} FROM x",
)
def _(s, d):
    v16 = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("embedding", i * 16 + 1, F.lit(16)), lambda x: x.cast("double")))
    out = v.table(s, d, "embeddings").select("vec_id", masked_mean(v16, F.col("label") % 4)[0].alias("first"))
    return rounded(out, "first")
