"""The bootstrap over tasks of resamples: md5 in numpy, and intervals against a resample by resample count."""

import hashlib
import random

import numpy as np
import pytest

from spindrift.functions.md5 import first_words
from spindrift.operators import bootstrap


def word(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("before, between", [("0:", ":click:"), ("-12:", ":" + "é" * 40 + ":"), ("0:", ":" + "x" * 45 + ":"), ("7:", "::")])
def test_first_words_of_md5(before, between):
    for outer, inner in ((range(0, 12), range(1, 1203)), (range(998, 1002), range(9_990, 10_020)), (range(0), range(1, 5))):
        found = first_words(before, outer, between, inner)
        assert found.tolist() == [[word(f"{before}{o}{between}{i}") for i in inner] for o in outer]


def predictions(spark):
    rng = random.Random(5)
    rows = []
    for c in range(400):
        who = f"s{rng.randrange(50)}"
        y = rng.choice("abc")
        for s in range(2):
            for arm, right in (("a_gold", 0.5), ("b_gold_oversampled", 0.6), ("c_gold_weak", 0.9)):
                if arm != "a_gold" or (who < "s3" and y != "c"):  # fewer speakers and classes
                    rows.append((arm, s, who, y, y if rng.random() < right else rng.choice("abcd")))
    rows += [("a_gold", 0, "s11", "a", None), ("c_gold_weak", 1, None, "a", "a"), ("c_gold_weak", 1, "s1", None, "a")]
    return rows, spark.createDataFrame(rows, "arm string, seed long, speaker_key string, y_true string, y_pred string")


def counted(rows, arm_a, arm_b, n_boot):
    own = [r for r in rows if r[0] in (arm_a, arm_b) and r[2] is not None and r[3] is not None]
    labels = sorted({r[3] for r in own})
    members = {c: sorted({r[2] for r in own if r[3] == c}) for c in labels}
    out = []
    for b in range(n_boot):
        times = {}
        for c, who in members.items():
            for slot in range(1, len(who) + 1):
                s = who[word(f"0:{b}:{c}:{slot}") % len(who)]
                times[s] = times.get(s, 0) + 1
        score = {}
        for arm in (arm_a, arm_b):
            f1s = []
            for seed in (0, 1):
                for label in labels:
                    mine = [(times.get(r[2], 0), r[3] == label, r[4] == label) for r in own if r[0] == arm and r[1] == seed]
                    tp, err = sum(t for t, x, y in mine if x and y), sum(t for t, x, y in mine if x != y)
                    f1s.append(2 * tp / (2 * tp + err) if tp + err else 0.0)
            score[arm] = sum(f1s) / len(f1s)
        out.append(score[arm_a] - score[arm_b])
    return out


@pytest.fixture
def small(monkeypatch):
    """Blocks and tasks so small that each bound is met."""
    for name, value in (("BLOCK_SPEAKERS", 7), ("BLOCK_MEMBERS", 11), ("TASK_BYTES", 4 * 50 * 9), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(bootstrap, name, value)


def same(row, found):
    assert [row["delta_mean"], row["ci_low"], row["ci_high"], row["n_boot"]] == pytest.approx([np.mean(found), np.quantile(found, 0.025), np.quantile(found, 0.975), len(found)])


def test_bootstrap_against_a_count(spark):
    rows, df = predictions(spark)
    same(bootstrap.cluster_bootstrap(df, "c_gold_weak", "b_gold_oversampled", n_boot=25).first(), counted(rows, "c_gold_weak", "b_gold_oversampled", 25))


def test_bootstrap_in_many_tasks(spark, small):
    rows, df = predictions(spark)
    same(bootstrap.cluster_bootstrap(df, "c_gold_weak", "b_gold_oversampled", n_boot=25).first(), counted(rows, "c_gold_weak", "b_gold_oversampled", 25))


def test_comparisons_of_a_table_share_the_draws(spark, small, monkeypatch):
    rows, df = predictions(spark)
    calls = []
    own = bootstrap.deltas
    monkeypatch.setattr(bootstrap, "deltas", lambda *a: calls.append(1) or own(*a))
    table = {r["comparison"]: r for r in bootstrap.ablation_table(df, n_boot=25).collect()}
    same(table["C-B"], counted(rows, "c_gold_weak", "b_gold_oversampled", 25))
    same(table["A-B"], counted(rows, "a_gold", "b_gold_oversampled", 25))
    assert table["C-B"]["headline"] and len(calls) == 1
