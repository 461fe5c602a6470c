"""Order-dependent operators against brute force; edge rules; sinks and sources on small files."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.functions import audio
from spindrift.functions.numeric import total_steps, wilson_interval
from spindrift.functions.text import check_wording
from spindrift.operators import bootstrap, dedup, emit, evaluate, protocol, quality, reports, sample, split, validate, weaklabel
from spindrift.operators.graph import connected_components
from spindrift.operators.taxonomy import Taxonomy, map_labels, misses
from spindrift.schemas import ACCENTS
from spindrift.sources import files, speech

RAW = {
    "clip_id": "c1", "source": "globe", "source_uri": "u", "orig_file": "f", "offset_start_s": 0.0, "offset_end_s": 6.0, "sample_rate_orig": 16000,
    "duration_s": 6.0, "license": "CC0-1.0", "speaker_id_raw": "s1", "accent_raw": "US English",
}
SPLIT = RAW | {
    "accent_label": "en-US", "taxonomy_version": "v1", "snr_proxy_db": 20.0, "vad_speech_ratio": 0.9, "lang_prob": 0.9, "transcript": "a b c", "status": "accepted",
    "reject_reason": None, "speaker_key": "globe:s1", "split": "train", "label_source": "self_report", "consensus_score": None, "evidence_level": None,
}


def frame(spark, rows, stage):
    from spindrift.schemas import STAGES
    from pyspark.sql import types as T

    loose = T.StructType([T.StructField(f.name, f.dataType) for f in STAGES[stage].fields])
    return spark.createDataFrame([tuple(r[f.name] for f in loose.fields) for r in rows], loose)


def test_taxonomy_null_blank_and_miss(spark):
    df = spark.createDataFrame([(None,), ("  ",), (" US   English",), ("Martian",), ("martian ",)], "accent_raw string")
    assert [r[0] for r in map_labels(df, Taxonomy.v1()).select("accent_label").collect()].count("en-US") == 1
    assert [tuple(r) for r in misses(df, Taxonomy.v1()).collect()] == [("martian", 2)]
    with pytest.raises(ValueError):
        Taxonomy("x", {"a": "en-XX"})


def test_violations_are_all_found(spark):
    bad = [SPLIT, SPLIT | {"clip_id": "c2", "label_source": "weak", "split": "val"}, SPLIT | {"clip_id": "c3", "source": "youtube"}, SPLIT | {"clip_id": "c4", "status": "rejected"}, SPLIT | {"clip_id": "c5", "vad_speech_ratio": 1.5}]
    found = {(r["rule"], r["clip_id"]) for r in validate.violations(frame(spark, bad, "split"), "split").collect()}
    assert found == {("weak_never_in_eval", "c2"), ("youtube_needs_evidence", "c3"), ("rejected_has_reason", "c4"), ("in_0_1", "c5")}
    twice = {(r["rule"], r["clip_id"]) for r in validate.violations(frame(spark, [SPLIT, SPLIT], "split"), "split").collect()}
    assert twice == {("unique", "c1")}
    with pytest.raises(validate.InvalidManifest):
        validate.validate_manifest(frame(spark, [SPLIT | {"source": "radio"}], "split"), "split")


def test_cascade_calls_models_for_survivors_only(spark, tmp_path):
    log = str(tmp_path / "calls")

    def signal(batch):
        with open(log, "a") as f:
            f.write("".join(x + "\n" for x in batch["clip_id"]))
        return pd.DataFrame({"vad_speech_ratio": [0.9 if x != "quiet" else 0.1 for x in batch["clip_id"]], "snr_proxy_db": [20.0] * len(batch)})

    def heard(batch):
        return pd.DataFrame({"transcript": batch["clip_id"], "lang": ["de" if x == "german" else "en" for x in batch["clip_id"]], "lang_prob": [0.95] * len(batch)})

    rows = [RAW | {"clip_id": c} | more for c, more in [("good", {}), ("quiet", {}), ("unmapped", {"accent_raw": "Martian"}), ("short", {"duration_s": 3.0}), ("german", {})]]
    out = {r["clip_id"]: r for r in quality.apply_filters(frame(spark, rows, "raw"), Taxonomy.v1(), signal=signal, speech=heard).collect()}
    assert {k: r["reject_reason"] for k, r in out.items()} == {"good": None, "quiet": "low_vad", "unmapped": "unmapped_accent", "short": "too_short", "german": "not_english"}
    assert out["quiet"]["snr_proxy_db"] is None and out["quiet"]["vad_speech_ratio"] == 0.1 and out["german"]["transcript"] == "german"
    assert set(open(log).read().split()) == {"good", "quiet", "german"}


def test_greedy_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(80):
        base = rng.sample(words, 8) if i % 4 == 0 else rows[-1][2].split()[:]
        if i % 4:
            base[rng.randrange(8)] = rng.choice(words) if rng.random() < 0.6 else base[0]
        rows.append((f"c{i:03d}", round(rng.choice([5.0, 5.2, 5.4, 5.9, 6.3]), 2), " ".join(base)))
    rows += [(f"copy{i}", rows[7][1], rows[7][2] + " ") for i in range(12)] + [("none1", 5.0, " "), ("none2", 5.0, "")]
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    gone = set()
    for i, a in enumerate(order):
        if a[0] in gone:
            continue
        for b in order[i + 1 :]:
            x, y = set(a[2].split()), set(b[2].split())
            if b[0] not in gone and b[1] - a[1] <= 0.5 and x | y and len(x & y) / len(x | y) >= 0.8:
                gone.add(b[0])
    df = spark.createDataFrame(rows, "clip_id string, duration_s double, transcript string").withColumns({"status": F.lit("accepted"), "reject_reason": F.lit(None).cast("string")})
    found = {r["clip_id"] for r in dedup.reject_near_duplicates(df).where("status = 'rejected'").collect()}
    assert found == gone and gone


def test_nearest_and_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    x[10:20] = x[:10] + 0.05 * rng.normal(size=(10, 5))
    x[0] = x[1]  # twins
    df = spark.createDataFrame([(f"k{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "speaker_key string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    want = set()
    for i in range(60):
        best = sorted((j for j in range(60) if j != i and sim[i, j] >= 0.8), key=lambda j: (-round(sim[i, j], 12), j))[:4]
        want |= {(f"k{i:02d}", f"k{j:02d}") for j in best}
    found = {(r["src"], r["dst"]) for r in dedup.nearest(df, k=4, threshold=0.8).collect()}
    assert found == want
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 5)], "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(links).collect()} == {i: i - i % 10 for i in range(40)}


def test_two_cap_sampler_against_a_reader(spark):
    rng = random.Random(1)
    for trial in range(4):
        rows = [(i, rng.choice("abc") if i < 150 else rng.choice("abcd"), rng.randrange(6)) for i in range(300)]
        expected = ["a", "b"] if trial % 2 else None
        count, speakers, kept = {}, {}, []
        for i, label, who in rows:
            if count.get(label, 0) >= 20:
                if expected and all(count.get(e, 0) >= 20 for e in expected):
                    break
                continue
            if speakers.get((label, who), 0) >= 4:
                continue
            count[label] = count.get(label, 0) + 1
            speakers[label, who] = speakers.get((label, who), 0) + 1
            kept.append(i)
        df = spark.createDataFrame(rows, "stream_idx long, label string, speaker int")
        assert sorted(r["stream_idx"] for r in sample.two_cap_sample(df, 20, 4, expected).collect()) == kept


def test_split_invariants(spark):
    rows = [SPLIT | {"clip_id": f"c{s}-{i}", "speaker_key": f"globe:{s}", "accent_label": ACCENTS[s % 2]} for s in range(20) for i in range(3)]
    rows += [SPLIT | {"clip_id": "e", "source": "edacc", "speaker_key": "edacc:1"}, SPLIT | {"clip_id": "r", "status": "rejected", "reject_reason": "x"}]
    df = frame(spark, rows, "split").drop("split", "label_source")
    out = split.assign_splits(df)
    assert split.leaking_speakers(out).count() == 0
    by = {r["clip_id"]: r["split"] for r in out.collect()}
    assert by["e"] == "ood_test" and by["r"] == "unassigned" and set(by.values()) == {"train", "val", "test", "ood_test", "unassigned"}
    assert by == {r["clip_id"]: r["split"] for r in split.assign_splits(df).collect()}
    assert split.leaking_speakers(split.assign_splits_leaky(df)).count() > 0


def loop_quota(n, ratios):
    if n <= 1:
        return 0, 0
    if n == 2:
        return 1, 0
    test, val = max(1, round(n * ratios[2])), max(1, round(n * ratios[1]))
    while test + val >= n and (val > 1 or test > 1):
        test, val = (test, val - 1) if val > 1 else (test - 1, val)
    return test, val


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.7, 0.15, 0.15), (0.2, 0.4, 0.4)])
def test_quota_closed_form(spark, ratios):
    test, val = split.quota(F.col("id").cast("int"), ratios)
    for r in spark.range(120).select("id", test.alias("t"), val.alias("v")).collect():
        assert (r["t"], r["v"]) == loop_quota(r["id"], ratios)


@pytest.mark.parametrize(
    "evidence, votes, status",
    [("E1", ["en-US"] * 3, "accepted"), ("E2", ["en-US", "en-US", "en-GB"], "accepted"), ("E1", ["en-US", "en-GB"], "review"), ("E3", ["en-US"] * 3, "rejected"), (None, ["en-US"], "rejected"), ("E1", [], "review"), ("E1", None, "review")],
)
def test_consensus_rules(spark, evidence, votes, status):
    df = spark.createDataFrame([("c", "en-US", evidence, votes)], "clip_id string, prior_label string, evidence_level string, qwen_votes array<string>")
    row = weaklabel.decide(df).first()
    assert row["status"] == status
    assert (row["accent_label"] is not None) == (status == "accepted")
    if evidence == "E2":
        assert math.isclose(row["consensus_score"], 2 / 3 * 0.85)


def test_votes_are_parsed_and_prompt_is_pinned(spark):
    cfg = weaklabel.VoteConfig("m", "r", "which accent?", k_votes=2)
    df = spark.createDataFrame([("a",), ("b",)], "clip_id string")
    out = {r["clip_id"]: r["qwen_votes"] for r in weaklabel.vote(df, cfg, lambda path, prompt: "It is EN-us" if path == "a" else "en-US or en-GB").collect()}
    assert out == {"a": ["en-US"] * 2, "b": ["unsure"] * 2}
    with pytest.raises(ValueError):
        weaklabel.VoteConfig("m", "r", "other", prompt_sha256="00").checked_prompt()
    assert json.loads(cfg.metadata())["k_votes"] == 2


def test_f1_off_subset_predictions_are_misses(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", "a"), ("b", "b")], "y_true string, y_pred string")
    scores = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.class_scores(df, ["a", "b", "never"]).collect()}
    assert scores == {"a": (1, 1, 1), "b": (1, 0, 1), "never": (0, 0, 0)}
    assert sum(r["n"] for r in evaluate.confusion(df, ["a", "b"]).collect()) == 3
    assert evaluate.macro_f1(df, []).first()[0] is None
    with pytest.raises(KeyError):
        evaluate.external_report(spark.createDataFrame([("en-US", "unsure")], "y_true string, y_pred string"))


def test_bootstrap_straddles_zero_and_finds_a_shift(spark):
    rng = random.Random(2)
    rows = []
    for c in range(120):
        who, y = f"s{c % 24}", "abc"[c % 24 % 3]
        for s in range(2):
            right = rng.random()
            rows += [("same", s, who, y, y if right < 0.6 else "a"), ("base", s, who, y, y if right < 0.6 else "a"), ("better", s, who, y, y if right < 0.95 else "a")]
    df = spark.createDataFrame(rows, "arm string, seed long, speaker_key string, y_true string, y_pred string")
    same = bootstrap.cluster_bootstrap(df, "same", "base", n_boot=60).first()
    assert same["delta_mean"] == 0 and not same["ci_excludes_zero"]
    better = bootstrap.cluster_bootstrap(df, "better", "base", n_boot=60).first()
    assert better["ci_low"] > 0 and better["ci_excludes_zero"] and len(better["seed_deltas"]) == 2
    line = df.sparkSession.createDataFrame([("C-B", 0.12345, 0.1, 0.2, True, [0.1], 0.0)], "c string, delta_mean double, ci_low double, ci_high double, ci_excludes_zero boolean, seed_deltas array<double>, seed_delta_std double")
    text = line.select(bootstrap.delta_line(F.col("c"))).first()[0]
    assert text.startswith("C-B: delta macro-F1 = 0.1235;") or text.startswith("C-B: delta macro-F1 = 0.1234;")
    check_wording(text)
    with pytest.raises(ValueError):
        check_wording("our SOTA result")


def test_threshold(spark):
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(0.85, 0.03, 200), rng.normal(0.1, 0.05, 2000)
    one = lambda x: spark.createDataFrame([(float(v),) for v in x], "similarity double")
    want = next((t for t in np.unique(np.concatenate([pos, neg])) if (neg >= t).mean() <= 1e-3), 1.0)
    assert dedup.suggest_threshold(dedup.calibration_table(one(pos), one(neg))).first()[0] == want
    assert dedup.suggest_threshold(dedup.calibration_table(one(pos), one(neg).limit(0))).first()[0] == 1.0


def test_emit_writes_only_valid_sets(spark, tmp_path):
    rows = [SPLIT, SPLIT | {"clip_id": "c2", "split": "test"}, SPLIT | {"clip_id": "c3", "source": "youtube", "label_source": "weak", "evidence_level": "E1"}]
    out = emit.emit_dataset(frame(spark, rows, "split"), "a_gold", f"file://{tmp_path}/a")
    assert out["n_total"] == 2 and json.loads((tmp_path / "a/stats.json").read_text())["per_split"] == {"test": 1, "train": 1}
    with pytest.raises(validate.InvalidManifest):
        emit.emit_dataset(frame(spark, [SPLIT | {"duration_s": 0.0}], "split"), "c_gold_weak", f"file://{tmp_path}/b")
    assert not (tmp_path / "b").exists()
    with pytest.raises(ValueError):
        emit.variant_filter("other")
    assert [r["clip_id"] for r in emit.augment_train(frame(spark, [SPLIT], "split"), (1.0, 0.9)).orderBy("clip_id").collect()] == ["c1", "c1#aug-sp0.9"]


def test_reports_on_empty_and_small(spark):
    df = frame(spark, [SPLIT], "split")
    assert reports.duration_confound(reports.source_accent_matrix(df)).first()["duration_disjoint"] is False
    assert reports.source_accent_matrix(df.limit(0)).count() == 0
    assert reports.class_coverage(df.limit(0)).where("include").count() == 0
    with pytest.raises(ValueError):
        reports.class_coverage(df)


def test_protocol_and_budgets(spark):
    common = {k: 1 for k in protocol.SHARED_FIELDS} | {"seeds": [17]}
    run = protocol.load_run(common, {"arm": "a_gold", "budget": "epoch_matched"}, 17)
    assert len(run.shared_config_hash) == 16
    with pytest.raises(ValueError):
        protocol.load_run(common, {"arm": "a", "budget": "b", "lr": 2}, 17)
    with pytest.raises(ValueError):
        protocol.load_run(common, {"arm": "a", "budget": "b"}, 18)
    assert total_steps("epoch_matched", 101, 10, 3) == 33 and total_steps("step_matched_to_c", 1, 1, 1, 77) == 77
    runs = spark.createDataFrame([("b_gold_oversampled", 10, "h"), ("c_gold_weak", 11, "h")], "arm string, total_steps long, shared_config_hash string")
    with pytest.raises(AssertionError):
        evaluate.assert_budget_alignment(runs)
    with pytest.raises(AssertionError):
        evaluate.assert_budget_alignment(runs.limit(0))
    history = spark.createDataFrame([("a", 1, 10, 0.5), ("a", 1, 20, 0.5), ("a", 1, 30, 0.4)], "arm string, seed long, step long, val_macro_f1 double")
    assert protocol.checkpoints(history).first()["step"] == 10


def tone(seconds, rate=16000, hz=440.0):
    t = np.arange(int(seconds * rate)) / rate
    return 0.5 * np.sin(2 * np.pi * hz * t)


def test_audio():
    x = np.concatenate([tone(5.4), 0.01 * tone(0.6)])
    y, rate = audio.decode(audio.encode(x))
    assert rate == 16000 and np.abs(x - y).max() < 1e-3
    segments = [{"start": 0, "end": int(5.4 * 16000)}]
    assert math.isclose(audio.speech_ratio(segments, len(x)), 0.9) and audio.speech_ratio([], 0) == 0
    assert abs(audio.snr_proxy_db(x, segments) - 40) < 1
    assert audio.snr_proxy_db(x, []) == -math.inf and audio.snr_proxy_db(x, [{"start": 0, "end": len(x)}]) == math.inf
    assert len(audio.change_speed(x, 16000, 0.9)) == pytest.approx(len(x) / 0.9, rel=1e-3) and audio.change_speed(x, 16000, 1.0) is x
    z = audio.resample(tone(1, 44100), 44100, 16000)
    assert len(z) == 16000 and abs((z**2).mean() - 0.125) < 0.01
    with pytest.raises(ValueError):
        audio.cut(x, 16000, 5, 7)
    assert audio.energy_segments(x, 16000)[0]["end"] <= 5.5 * 16000


def test_sources(spark, tmp_path):
    def wav(path, seconds=1.0):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(audio.encode(tone(seconds)))

    cv = tmp_path / "cv"
    for i in range(4):
        wav(cv / f"clips/{i}.wav")
    accents = ["US English", "", "a,b", "India and South Asia (India, Pakistan, Sri Lanka)"]
    (cv / "validated.tsv").write_text("client_id\tpath\tsentence\taccents\n" + "".join(f"s{i}\t{i}.wav\tNA\t{a}\n" for i, a in enumerate(accents)))
    raw, stats = speech.common_voice(spark, f"file://{cv}", ["client_id", "path", "sentence", "accents"])
    assert {r["clip_id"] for r in raw.collect()} == {"cv:0", "cv:3"} and stats.first().asDict() == {"n_rows": 4, "n_no_accent": 1, "n_multi_accent_skipped": 1, "n_yielded": 2, "accent_fill_rate": 0.75}
    out = files.ingest(raw, f"file://{tmp_path}/raw")
    assert out.count() == 2
    with pytest.raises(validate.InvalidManifest):
        files.ingest(raw.limit(0), f"file://{tmp_path}/none")

    l2 = tmp_path / "l2"
    for who in ("BWC", "YKWK", "ASI"):
        wav(l2 / who / "wav/arctic_a0001.wav")
    assert {(r["clip_id"], r["accent_raw"]) for r in speech.speaker_directories(spark, f"file://{l2}").collect()} == {("l2arctic:BWC:arctic_a0001", "Mandarin"), ("l2arctic:YKWK:arctic_a0001", "Korean"), ("l2arctic:ASI:arctic_a0001", "Hindi")}
    wav(l2 / "XXX/wav/a.wav")
    with pytest.raises(KeyError):
        speech.speaker_directories(spark, f"file://{l2}")

    ed = tmp_path / "ed"
    wav(ed / "talk.wav", 30)
    (ed / "segments.csv").write_text("segment_id,audio_file,speaker_id,start_s,end_s\nx1,talk.wav,p1,1.5,4.0\nx2,talk.wav,p2,4,6\n")
    (ed / "speakers.csv").write_text("speaker_id,accent,l1\np1,Scottish,English\np2,none,Korean\n")
    found = {r["clip_id"]: r for r in speech.segments(spark, f"file://{ed}").collect()}
    assert found["edacc:x1"]["duration_s"] == 2.5 and found["edacc:x1"]["accent_raw"] == "Scottish" and found["edacc:x2"]["accent_raw"] == "Korean"
    (ed / "segments.csv").write_text("segment_id,audio_file,speaker_id,start_s,end_s\nx1,talk.wav,p9,1.5,4.0\n")
    with pytest.raises(KeyError):
        speech.segments(spark, f"file://{ed}")

    shard = tmp_path / "sh/data"
    shard.mkdir(parents=True)
    clip = {"bytes": audio.encode(tone(1, 44100), 44100), "path": "x"}
    pd.DataFrame({"speaker_id": ["a", "b", "c"], "accent": ["US English", "", "Korean"], "audio": [clip] * 3}).to_parquet(shard / "train-00003-of-00160.parquet")
    raw, stats = speech.read_speech_shards(spark, f"file://{tmp_path}/sh")
    assert {r["clip_id"] for r in raw.collect()} == {"globe:train:00003:000000", "globe:train:00003:000002"} and stats.first()["n_no_accent"] == 1
    wavs = f"file://{tmp_path}/wavs"
    speech.materialise_audio(spark, f"file://{tmp_path}/sh", "globe", wavs)
    assert spark.read.parquet(wavs).count() == 3
    speech.materialise_audio(spark, f"file://{tmp_path}/sh", "globe", wavs)
    assert spark.read.parquet(wavs).count() == 3
    hosted = tmp_path / "ho/data"
    hosted.mkdir(parents=True)
    pd.DataFrame({"speaker": ["a"], "accent": ["Irish"], "l1": ["english"], "audio": [clip]}).to_parquet(hosted / "test-00000-of-00001-ff.parquet")
    row = speech.conversation_shards(spark, f"file://{tmp_path}/ho").first()
    assert row["clip_id"] == "edacc:test:00000:000000" and row["source_uri"].endswith("#test") and row["accent_raw"] == "Irish" and row["sample_rate_orig"] == 44100


def test_small_readers(spark, tmp_path):
    (tmp_path / "list.csv").write_text("# a list\nurl,start_s,end_s,prior_label,evidence_level,evidence_note\nhttp://x,1,2,en-US,E1,n\n")
    assert files.read_url_list(spark, f"file://{tmp_path}/list.csv").first()["start_s"] == 1.0
    (tmp_path / "r").mkdir()
    (tmp_path / "r/metrics.json").write_text(json.dumps({"arm": "a", "seed": 1, "total_steps": 5, "shared_config_hash": "h", "best_val_macro_f1": 0.5, "history": [{"step": 1, "val_macro_f1": 0.5}]}, indent=1))
    assert files.read_runs(spark, f"file://{tmp_path}/r/*.json").first()["history"][0]["step"] == 1
    files.write_csv(spark.range(2), f"file://{tmp_path}/csv")
    assert files.write_json_row(spark.range(1), f"file://{tmp_path}/one.json") == {"id": 0}
    assert wilson_interval(0, 0) == (0.0, 1.0) and wilson_interval(24, 25)[0] > 0.79


def test_stream_sampler_equals_batch(spark, tmp_path):
    from spindrift.streaming.sampler import sample_stream

    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), str(rng.randrange(5))) for i in range(120)]
    schema = "stream_idx long, label string, speaker string"
    for part in range(2):  # two micro-batches in order
        spark.createDataFrame(rows[part * 60 : part * 60 + 60], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/p{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    q = sample_stream(stream, 15, 4).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    found = sorted(r["stream_idx"] for r in spark.table("kept").collect())
    want = sorted(r["stream_idx"] for r in sample.two_cap_sample(spark.createDataFrame(rows, schema), 15, 4).collect())
    assert len(found) == len(want) == 30 or found == want
