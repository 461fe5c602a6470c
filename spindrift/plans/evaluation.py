"""Queries over predictions: scores, tables, bootstrap, external vocabularies, budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, evaluate, protocol
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


_ONE = f"{v.PREDS}, p AS (SELECT * FROM preds WHERE arm = 'a_gold' AND seed = 0), dom AS (SELECT DISTINCT y_true AS label FROM p)"
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"


def scores(rows: str, by: str = "", labels: str = "dom") -> str:
    """A table f (by, label, tp, fp, fn, f1) of rows."""
    keys = f"{by}, " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {rows}) g, " if by else ""
    on = " AND ".join(f"r.{k.strip()} = g.{k.strip()}" for k in by.split(",")) if by else "true"
    sel = ", ".join(f"g.{k.strip()}" for k in by.split(",")) + ", " if by else ""
    return f"""t AS (SELECT {sel}l.label, count(*) FILTER (WHERE r.y_true = l.label AND r.y_pred = l.label) AS tp, count(*) FILTER (WHERE r.y_true <> l.label AND r.y_pred = l.label) AS fp,
  count(*) FILTER (WHERE r.y_true = l.label AND r.y_pred <> l.label) AS fn FROM {groups}{labels} l LEFT JOIN {rows} r ON {on} GROUP BY ALL), f AS (SELECT {keys}label, tp, fp, fn, {_F1} AS f1 FROM t)"""


def _one(s, d):
    return v.predictions(s, d).where("arm = 'a_gold' AND seed = 0")


def _labels(df):
    return evaluate.labels_of(df, "y_true")


@query("A17_confusion", f"WITH {_ONE} SELECT a.label AS y_true, b.label AS y_pred, count(p.clip_id) AS n FROM dom a CROSS JOIN dom b LEFT JOIN p ON p.y_true = a.label AND p.y_pred = b.label GROUP BY 1, 2")
def _(s, d):
    p = _one(s, d)
    return evaluate.confusion(p, _labels(p))


@query("A18_macro_f1", f"WITH {_ONE}, {scores('p')} SELECT {six_sql('avg(f1)', 'macro_f1')} FROM f")
def _(s, d):
    p = _one(s, d)
    return rounded(evaluate.macro_f1(p, _labels(p)), "macro_f1")


@query("A18_macro_f1_subset", f"WITH {_ONE}, sub AS (SELECT label FROM dom ORDER BY 1 LIMIT 3), {scores('p', labels='sub')} SELECT {six_sql('avg(f1)', 'macro_f1')} FROM f")
def _(s, d):
    p = _one(s, d)
    return rounded(evaluate.macro_f1(p, _labels(p)[:3]), "macro_f1")


@query("A21_class_f1", f"WITH {_ONE}, {scores('p')} SELECT label, tp, fp, fn, {six_sql('f1', 'f1')} FROM f")
def _(s, d):
    p = _one(s, d)
    return rounded(evaluate.class_scores(p, _labels(p)), "f1")


@query("A19_source_class_grid", f"WITH {_ONE}, {scores('p', 'source')} SELECT source, label AS accent_label, {six_sql('f1', 'f1')}, tp + fn AS n_clips FROM f")
def _(s, d):
    return rounded(evaluate.per_source_class_f1(_one(s, d)), "f1")


@query("A25_mean_std_over_seeds", f"WITH {v.PREDS}, dom AS (SELECT DISTINCT y_true AS label FROM preds), {scores('preds', 'arm, seed')}, m AS (SELECT arm, seed, avg(f1) AS m FROM f GROUP BY 1, 2) SELECT arm, {six_sql('avg(m)', 'mean')}, {six_sql('stddev_pop(m)', 'std')} FROM m GROUP BY 1")
def _(s, d):
    p = v.predictions(s, d)
    return rounded(evaluate.mean_and_std(evaluate.macro_f1(p, _labels(p), ["arm", "seed"]), "macro_f1", ["arm"]), "mean", "std")


_COVER = "cov AS (SELECT label AS accent_label, row_number() OVER (ORDER BY label) <= 3 AS include FROM dom)"


def _coverage(s, d):
    return s.createDataFrame([(x, i < 3) for i, x in enumerate(_labels(_one(s, d)))], "accent_label string, include boolean")


@query(
    "A20_supported_classes",
    f"""WITH {_ONE}, {_COVER}, sup AS (SELECT accent_label AS label FROM cov WHERE include), o AS (SELECT p.* FROM p JOIN sup ON sup.label = p.y_true WHERE source = '0'), i AS (SELECT p.* FROM p JOIN sup ON sup.label = p.y_true WHERE source <> '0'),
{scores('o', labels='sup').replace('t AS', 't1 AS').replace('f AS', 'f1t AS').replace('FROM t)', 'FROM t1)')}, {scores('i', labels='sup')}
SELECT {six_sql('(SELECT avg(f1) FROM f1t)', 'supported_class_macro_f1')}, {six_sql('(SELECT avg(f1) FROM f)', 'in_domain_supported_class_macro_f1')}, (SELECT count(*) FROM o) AS n_ood_clips""",
)
def _(s, d):
    p = _one(s, d)
    out = evaluate.supported_class_report(p.where("source = '0'"), p.where("source <> '0'"), _coverage(s, d))
    return rounded(out.select("supported_class_macro_f1", "in_domain_supported_class_macro_f1", "n_ood_clips"), "supported_class_macro_f1", "in_domain_supported_class_macro_f1")


@query("A24_majority_baseline", f"WITH {v.QC}, m AS (SELECT accent_label AS y_pred FROM qc WHERE status = 'accepted' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT clip_id, y_pred FROM qc, m WHERE status = 'rejected'")
def _(s, d):
    q = v.qc(s, d)
    return evaluate.majority_baseline(q.where("status = 'accepted'"), q.where("status = 'rejected'")).select("clip_id", "y_pred")


_EXT = "x(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in evaluate.EXTERNAL_OF.items()) + ")"
_EXTERNAL = f"{v.CLASSES}, {_EXT}, e AS (SELECT own.y_true AS ot, own.y_pred AS op, t.b AS y_true, p.b AS y_pred FROM own JOIN x t ON t.a = own.y_true JOIN x p ON p.a = own.y_pred), dom AS (SELECT y_true AS label FROM e UNION SELECT y_pred FROM e)"


@query("E7_external_report", f"WITH {_EXTERNAL}, {scores('e')} SELECT {six_sql('(SELECT avg(f1) FROM f)', 'macro_f1')}, (SELECT count(*) FROM e) AS n_clips, (SELECT count(*) FROM e WHERE ot <> op AND y_true = y_pred) AS n_errors_hidden")
def _(s, d):
    return rounded(evaluate.external_report(v.classes_for(s, d)), "macro_f1")


@query("A28_collapsed_groups", f"WITH {_EXT} SELECT b AS external, string_agg(a, ',' ORDER BY a) AS classes FROM x GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return evaluate.collapsed_groups(s).select("external", F.array_join("classes", ",").alias("classes"))


@query("A29_out_of_vocabulary", f"WITH {v.CLASSES} SELECT {six_sql('avg(CASE WHEN y_pred IN (' + chr(39) + 'en-US' + chr(39) + ', ' + chr(39) + 'en-GB' + chr(39) + ') THEN 0.0 ELSE 1.0 END)', 'oov_rate')} FROM own")
def _(s, d):
    return rounded(evaluate.out_of_vocabulary_rate(v.classes_for(s, d), ["en-US", "en-GB"]), "oov_rate")


@query("A26_budget_alignment", "WITH r AS (SELECT 'b_gold_oversampled' AS arm, 900 AS st UNION ALL SELECT 'c_gold_weak', 900 UNION ALL SELECT 'a_gold', 600) SELECT 9 AS n_runs, 1 AS n_hashes, true AS aligned FROM r LIMIT 1")
def _(s, d):
    steps = {"a_gold": 600, "b_gold_oversampled": 900, "c_gold_weak": 900}
    runs = s.createDataFrame([(a, i, n, "h") for a, n in steps.items() for i in (17, 42, 1337)], "arm string, seed long, total_steps long, shared_config_hash string")
    return evaluate.budget_alignment(runs).select(F.col("n_runs").cast("int"), F.col("n_hashes").cast("int"), "aligned")


def _boot_sql(n: int, a: str, b: str) -> str:
    return f"""{v.PREDS}, own AS (SELECT * FROM preds WHERE arm IN ('{a}', '{b}')), mem AS (SELECT DISTINCT y_true AS class, speaker_key FROM own),
num AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY speaker_key) - 1 AS pos, count(*) OVER (PARTITION BY class) AS n FROM mem),
siz AS (SELECT DISTINCT class, n FROM num), dr AS (SELECT b.range AS b, class, n, unnest(range(1, n + 1)) AS slot FROM range(0, {n}) b, siz),
pk AS (SELECT b, class, CAST('0x' || substr(md5('0:' || b || ':' || class || ':' || slot), 1, 8) AS BIGINT) % n AS pos FROM dr),
tm AS (SELECT b, speaker_key, count(*) AS times FROM pk JOIN num USING (class, pos) GROUP BY 1, 2), dom AS (SELECT DISTINCT y_true AS label FROM own),
st AS (SELECT arm, seed, speaker_key, label, count(*) FILTER (WHERE y_true = label AND y_pred = label) AS tp, count(*) FILTER (WHERE (y_true = label) <> (y_pred = label)) AS err FROM own, dom GROUP BY 1, 2, 3, 4),
sm AS (SELECT b, arm, seed, label, sum(times * tp) AS tp, sum(times * err) AS err FROM tm JOIN st USING (speaker_key) GROUP BY 1, 2, 3, 4),
sc AS (SELECT b, arm, seed, avg(CASE WHEN 2 * tp + err = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + err) END) AS f1 FROM sm GROUP BY 1, 2, 3), mn AS (SELECT b, arm, avg(f1) AS f1 FROM sc GROUP BY 1, 2),
dl AS (SELECT b, max(f1) FILTER (WHERE arm = '{a}') - max(f1) FILTER (WHERE arm = '{b}') AS delta FROM mn GROUP BY 1),
fl AS (SELECT arm, seed, label, sum(tp) AS tp, sum(err) AS err FROM st GROUP BY 1, 2, 3), fs AS (SELECT arm, seed, avg(CASE WHEN 2 * tp + err = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + err) END) AS f1 FROM fl GROUP BY 1, 2),
sd AS (SELECT seed, max(f1) FILTER (WHERE arm = '{a}') - max(f1) FILTER (WHERE arm = '{b}') AS d FROM fs GROUP BY 1)"""


_BOOT_COLUMNS = f"{six_sql('avg(delta)', 'delta_mean')}, {six_sql('quantile_cont(delta, 0.025)', 'ci_low')}, {six_sql('quantile_cont(delta, 0.975)', 'ci_high')}, count(*) AS n_boot, {six_sql('(SELECT stddev_pop(d) FROM sd)', 'seed_delta_std')}, quantile_cont(delta, 0.025) > 0 OR quantile_cont(delta, 0.975) < 0 AS ci_excludes_zero"


@query("E2_cluster_bootstrap", f"WITH {_boot_sql(10_000, 'c_gold_weak', 'b_gold_oversampled')} SELECT {_BOOT_COLUMNS} FROM dl")
def _(s, d):
    out = bootstrap.cluster_bootstrap(v.predictions(s, d), "c_gold_weak", "b_gold_oversampled", n_boot=10_000)
    return rounded(out.select("delta_mean", "ci_low", "ci_high", "n_boot", "seed_delta_std", "ci_excludes_zero"), "delta_mean", "ci_low", "ci_high", "seed_delta_std")


@query(
    "E3_ablation_table",
    "SELECT 'C-B' AS comparison, true AS headline, x.* FROM (WITH "
    + _boot_sql(10_000, "c_gold_weak", "b_gold_oversampled")
    + f" SELECT {_BOOT_COLUMNS} FROM dl) x UNION ALL SELECT 'A-B', false, x.* FROM (WITH "
    + _boot_sql(10_000, "a_gold", "b_gold_oversampled")
    + f" SELECT {_BOOT_COLUMNS} FROM dl) x",
)
def _(s, d):
    out = bootstrap.ablation_table(v.predictions(s, d), n_boot=10_000)
    return rounded(out.select("comparison", "headline", "delta_mean", "ci_low", "ci_high", "n_boot", "seed_delta_std", "ci_excludes_zero"), "delta_mean", "ci_low", "ci_high", "seed_delta_std")


@query("E9_embedding_probe")
def _(s, d):
    rows = v.table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    return protocol.embedding_probe(rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0"), max_iter=50).select("vec_id", "label", "y_pred")


@query("E15_leakage_demo")
def _(s, d):
    """How many speakers the leaky rule shares between train and test, against the strict one."""
    from ..operators.split import shared_speakers

    count = lambda df, name: shared_speakers(df).agg(F.count(F.lit(1)).alias(name))
    return count(v.splits(s, d), "strict_shared").crossJoin(count(v.leaky(s, d), "leaky_shared"))  # one row each


SQL["E15_leakage_demo"] = f"WITH {v.LEAKY} SELECT CAST(0 AS BIGINT) AS strict_shared, count(*) AS leaky_shared FROM (SELECT speaker_key FROM leaky WHERE split = 'train' INTERSECT SELECT speaker_key FROM leaky WHERE split = 'test')"


@query("E12_schedule", f"SELECT range AS step, {six_sql('CASE WHEN range < 30 THEN range / 30.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * (range - 30) / 270.0::DOUBLE)) END', 'lr')} FROM range(0, 300)")
def _(s, d):
    return rounded(protocol.schedule(s, 300, 0.1), "lr")
