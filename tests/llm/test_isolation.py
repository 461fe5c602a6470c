import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from spindrift.llm import isolation
from spindrift.llm.isolation import calibrate, grow, op5_isolation_forest, quality_stage, text_stats

from .conftest import edge_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    marked = {j for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n", "a a a", "a a a a", "a\x1cb c\xa0d", "x\n x\nx\n\n"] + [" ".join(rng.choice("ab cd e$ #é".split()) + rng.choice(["", "\n", "\t"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for t in texts + [r[1] for r in edge_rows()]:
        assert text_stats(t) == brute(t)


def test_far_rows_have_short_paths():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5_000, 3))
    forest = grow(x, 50, 256, 1)
    far = forest.score(np.array([[9.0, 9, 9], [-9, 9, 0]]))
    assert far.min() > np.quantile(forest.score(x), 0.999)
    # a tree's leaves hold the depth at which a row ends: checked by walking one tree
    node = depth = 0
    row = x[0]
    while forest.feature[0, node] >= 0:
        node, depth = forest.left[0, node] + (row[forest.feature[0, node]] >= forest.cut[0, node]), depth + 1
    assert forest.path[0, node] >= depth
    assert grow(np.zeros((0, 3)), 5, 256, 1).score(np.zeros((2, 3))).tolist() == [0, 0]
    assert len(set(grow(np.ones((10, 3)), 5, 256, 1).score(np.ones((3, 3))))) == 1


def test_threshold_keeps_good_rows():
    s = np.array([0.9, 0.8, 0.8, 0.5, 0.4, 0.3])
    assert 0.5 < calibrate(s, np.array([False, False, False, True, True, True]), 0.0) < 0.8
    assert calibrate(s, np.ones(6, bool), 0.1) == float("inf") == calibrate(s, np.zeros(6, bool), 0.1)
    assert calibrate(np.array([0.5, 0.5]), np.array([True, False]), 0.0) == float("inf")


def corpus(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, "en", rng.randint(60, 200))
        if i % 10 == 0:
            text = " ".join(w + "$$$" for w in text.split())
        rows.append((i, text, "en", "s"))
        if i % 2 == 0:
            labels.append((i, 0 if i % 10 == 0 else 1, 0))
    return rows, labels


def test_junk_goes_and_clean_stays(spark, world):
    rows, labels = corpus()
    sf = world(rows, labels + [(None, 1, 0), (5, None, None)])
    out = {r["doc_id"]: r for r in op5_isolation_forest(spark, sf).collect()}
    assert {i for i, r in out.items() if not r["kept"]} == {i for i in out if i % 10 == 0}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in out if i % 10}


def walked(forest, row):
    """A row's score by walking every tree by hand."""
    total = 0.0
    for t in range(len(forest.feature)):
        node, steps = 0, 0
        while forest.feature[t, node] >= 0:
            node = forest.left[t, node] + int(row[forest.feature[t, node]] >= forest.cut[t, node])
            steps += 1
        total += forest.path[t, node]
        assert steps <= 8 and forest.path[t, node] >= steps
    return 2 ** (-total / len(forest.feature) / forest.norm)


def test_verdicts_by_brute_force(spark, world):
    rows, labels = corpus()
    sf = world(rows, labels)
    stats = pd.DataFrame([brute(t) for _, t, *_ in rows], columns=isolation.STATS)
    frame = spark.createDataFrame([(i, *map(int, x)) for i, x in zip(range(len(rows)), stats.itertuples(index=False), strict=True)], "_id long, " + ", ".join(f"{c} long" for c in isolation.STATS))
    rules = isolation.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    x = isolation.features(stats, rules.usual)
    scores = np.array([walked(rules.forest, r) for r in x])
    # the threshold: of all there could be, one of the largest gain at no more than the allowed loss
    good = {i: q == 1 for i, q, _ in labels if not (stats.n_words[i] < 50 or 100 * stats.n_repeat_words[i] > 50 * stats.n_words[i])}
    gain = {}
    for t in sorted({scores[i] for i in good}):
        lost = sum(scores[i] >= t for i in good if good[i]) / sum(good.values())
        caught = sum(scores[i] >= t for i in good if not good[i]) / sum(not g for g in good.values())
        gain[t] = caught - lost if lost <= isolation.GOOD_LOSS else -1
    rejected = {i for i in good if scores[i] >= rules.threshold}
    assert rejected in [{i for i in good if scores[i] >= t} for t in gain if gain[t] == max(gain.values())]
    out = {r["doc_id"]: r for r in op5_isolation_forest(spark, sf).collect()}
    for i, r in out.items():
        assert abs(r["anomaly_score"] - scores[i]) < 1e-9 and r["kept"] == (not r["base_failed"] and scores[i] < rules.threshold)


def test_bounds_and_threshold_take_every_labelled_row(spark):
    n, rng = 30_001, np.random.default_rng(4)
    stats = pd.DataFrame({"n_words": rng.integers(60, 3_000, n)})
    stats["word_chars"] = (stats.n_words * rng.normal(5, 0.3, n)).astype(int)
    good = rng.random(n) < 0.95
    stats["n_symbols"] = np.where(good, rng.poisson(0.01 * stats.n_words), rng.poisson(0.03 * stats.n_words))
    stats["n_dup_lines"], stats["n_repeat_words"] = rng.poisson(0.2, n), (rng.random(n) ** 9 * 0.4 * stats.n_words).astype(int)
    stats = stats.astype("int64")[isolation.STATS]
    frame = spark.createDataFrame(stats.assign(_id=np.arange(n)))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": good.astype("int32")}))
    learnt = stats[good]
    usual = []
    for x, q in [(learnt.n_repeat_words, 0.999), (learnt.n_dup_lines, 0.999), (learnt.word_chars, 0.001), (learnt.word_chars, 0.999)]:
        share = x / learnt.n_words
        usual.append(np.median(share) + isolation.MARGIN * (np.quantile(share, q) - np.median(share)))
    for coalesced in ("true", "false"):  # one range of values, and several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        try:
            rules = isolation.fit(frame, labels)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        found = rules.usual
        assert np.allclose([found.words, found.lines, found.short, found.long], usual, rtol=1e-12, atol=0)
        scores = rules.forest.score(isolation.features(stats, found))
        want = calibrate(scores, good, isolation.GOOD_LOSS)
        assert np.isfinite(want) and abs(rules.threshold - want) < 1e-12
        assert 0 < (scores[good] >= rules.threshold).mean() <= isolation.GOOD_LOSS


def test_running_sums_and_quantiles(spark):
    rng = np.random.default_rng(6)
    drawn = pd.DataFrame({"rule": rng.choice(["a", "b"], 400), "value": rng.integers(0, 60, 400) / 7})
    drawn = pd.concat([drawn[drawn.rule == r][:150] for r in "ab"])
    rows = drawn.groupby(["rule", "value"]).size().rename("n").reset_index()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = isolation.running(spark.createDataFrame(rows), ["rule"], "value", ["n"]).toPandas().sort_values(["rule", "value"])
        assert out["n_to"].tolist() == rows.groupby("rule")["n"].cumsum().tolist()
        shares = [0.0, 0.001, 0.5, 0.73, 0.999, 1.0]
        got = isolation.quantiles(spark.createDataFrame(rows), 150, shares)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in "ab":
        assert np.allclose(got[r], np.quantile(drawn[drawn.rule == r]["value"], shares), rtol=1e-12)
    one = spark.createDataFrame([("a", 2.5, 1)], "rule string, value double, n long")
    assert isolation.quantiles(one, 1, [0.5, 0.999]) == {"a": [2.5, 2.5]}


def test_threshold_of_a_table_is_that_of_its_rows(spark):
    rng = np.random.default_rng(7)
    for loss in (0.0, 0.1, 1.0):
        for _ in range(3):
            s, g = rng.integers(0, 12, 60) / 16, rng.random(60) < 0.7
            table = spark.createDataFrame(pd.DataFrame({"score": s, "good": g.astype(int), "bad": (~g).astype(int)}))
            assert isolation.calibrate_table(table, int(g.sum()), int((~g).sum()), loss) == calibrate(s, g, loss)
    assert isolation.calibrate_table(table, 0, 3, 0.1) == float("inf") == isolation.calibrate_table(table, 3, 0, 0.1)


def test_labels_held_out_of_the_calibration(spark, world):
    rows, labels = corpus(800)
    learnt, held = [x for x in labels if x[0] % 4 == 0], [x for x in labels if x[0] % 4]
    out = {r["doc_id"]: r for r in op5_isolation_forest(spark, world(rows, learnt)).collect()}
    bad = [i for i, q, _ in held if q == 0]
    assert len(bad) >= 40 and not any(out[i]["kept"] for i in bad)
    assert sum(out[i]["kept"] for i, q, _ in held if q == 1) >= 0.99 * sum(q == 1 for _, q, _ in held)


def test_edge_rows_and_no_labels(spark, world):
    rows = edge_rows()
    out = op5_isolation_forest(spark, world(rows)).collect()
    assert len(out) == len(rows)
    want = sorted((i is not None, i or 0, *brute(t)) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, *[r[c] for c in isolation.STATS]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])
    assert op5_isolation_forest(spark, world([])).count() == 0
    assert isolation.features(pd.DataFrame({c: [0] for c in isolation.STATS}), isolation.Usual()).tolist() == [[0] * 5]
