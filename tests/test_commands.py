"""The commands from shards to a training set."""

import json

import numpy as np
import pandas as pd

from spindrift.__main__ import run
from spindrift.functions import audio


def test_from_shards_to_training_set(spark, tmp_path):
    rng = np.random.default_rng(0)
    shard = tmp_path / "sh/data"
    shard.mkdir(parents=True)
    rows = []
    for s in range(12):
        for c in range(2):
            t = np.arange(16_000 * 6) / 16_000
            x = 0.4 * np.sin(2 * np.pi * (200 + 20 * s) * t) * (t < 5) + 0.002 * rng.normal(size=len(t))
            rows.append({"speaker_id": f"p{s}", "accent": "US English" if s % 2 else "Korean", "audio": {"bytes": audio.encode(x), "path": f"{s}-{c}"}})
    rows.append({"speaker_id": "q", "accent": "Martian", "audio": rows[0]["audio"]})
    pd.DataFrame(rows).to_parquet(shard / "train-00000-of-00001.parquet")
    at = lambda name: f"file://{tmp_path}/{name}"
    run(spark, ["ingest", "read-speech-shards", at("sh"), at("raw")])
    run(spark, ["audio", at("sh"), "globe", at("wavs")])
    run(spark, ["filter", at("raw"), at("qc"), "--wavs", at("wavs")])
    counts = {r["status"]: r["n"] for r in spark.read.parquet(at("qc")).groupBy("status").count().withColumnRenamed("count", "n").collect()}
    assert counts == {"accepted": 24, "rejected": 1}
    run(spark, ["split", at("qc"), at("split"), "--roster", at("roster")])
    done = spark.read.parquet(at("split"))
    assert {r["split"] for r in done.select("split").distinct().collect()} == {"train", "val", "test", "unassigned"}
    run(spark, ["report", at("split"), at("report")])
    assert spark.read.csv(at("report/matrix"), header=True).count() == 2
    run(spark, ["emit", at("split"), at("set"), "--variant", "a_gold"])
    stats = json.loads((tmp_path / "set/stats.json").read_text())
    assert stats["n_total"] == 25 + 2 * stats["per_split"]["train"] / 3 and stats["n_weak_train"] == 0


def test_weak_labels_to_audit(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    rows = [(f"c{i}", "en-US", ["E1", "E2", "E3"][i % 3], ["en-US"] * (i % 4) + ["en-GB"]) for i in range(60)]
    spark.createDataFrame(rows, "clip_id string, prior_label string, evidence_level string, qwen_votes array<string>").write.parquet(at("votes"))
    run(spark, ["consensus", at("votes"), at("decided")])
    run(spark, ["audit-sample", at("decided"), at("blind"), at("internal")])
    blind = spark.read.csv(at("blind"), header=True)
    assert set(blind.columns) == {"clip_id", "pool", "human_label"} and blind.count() == 20 + 20
    spark.read.parquet(at("internal")).selectExpr("*", "prior_label AS human_label").write.parquet(at("annotated"))
    run(spark, ["audit-report", at("annotated"), at("audit")])
    assert spark.read.csv(at("audit/precision"), header=True).first()["precision"] == "1.0"
