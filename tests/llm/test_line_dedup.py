import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from spindrift.llm import line_dedup
from spindrift.llm.line_dedup import LineRuns, dedup_lines, op9_line_dedup

from .conftest import SCHEMA, edge_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_docs=10):
    held = Counter()
    for _, t, *_ in rows:
        held.update({key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t, *_ in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if held[key(x)] < min_docs]
        out.append((i is not None, i or 0, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def test_query_on_edge_rows(spark, world):
    rows = edge_rows()
    out = found(op9_line_dedup(spark, world(rows)))
    assert out == brute(rows) and sum(r[3] for r in out) > 10
    assert op9_line_dedup(spark, world([])).count() == 0


def test_counts_at_the_bound_repeats_and_shuffle_join(spark, world, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "\n".join(["nine" if i < 9 else "x", " TEN\t" if i < 10 else "y", "ten", *[f"l{rng.randrange(400)}" for _ in range(5)]]) if i < 10 else f"l{rng.randrange(400)}\n\nl{rng.randrange(400)}", "en", "s") for i in range(300)]
    rows += [(7, "same\nrow", "en", "s")] * 10 + [(8, "É\né", "en", "s")] * 5 + [(9, "É", "en", "s")] * 6
    sf = world(rows)
    for bound in (line_dedup.BROADCAST_KEYS, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", bound)
        assert found(op9_line_dedup(spark, sf)) == brute(rows)


def test_runs_are_levelled_and_compacted(spark):
    store = LineRuns(spark, min_docs=3, fanout=2)
    total = Counter()
    rng = random.Random(3)
    for _ in range(5):
        batch = [(rng.randrange(20),) for _ in range(30)]
        # a settled key needs no further count
        total.update(h for (h,) in batch)
        store.add(spark.createDataFrame(batch, "_h1 long").withColumn("_h2", F.col("_h1")))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    assert {r["_h1"] for r in store.common().collect()} == {h for h, n in total.items() if n >= 3}
    for run in store.runs():
        assert run.count() == run.select("_h1", "_h2").distinct().count()
    store.drop()


def test_kept_text_and_minimum_length(spark):
    rows = [(i, "ab\nlonger line\nmine %d" % i, "en", "s") for i in range(12)]
    out = dedup_lines(spark.createDataFrame(rows, SCHEMA), min_docs=5, min_chars=3).collect()
    assert {r["kept"] for r in out} == {f"ab\nmine {i}" for i in range(12)}
