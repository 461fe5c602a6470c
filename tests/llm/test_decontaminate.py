import random
import time

import numpy as np

from spindrift.llm import decontaminate
from spindrift.llm.decontaminate import _stable, decontamination_stage, op6_decontamination, rolling, tile, words_of

from .conftest import edge_rows, sentence


def greedy(doc, item, least):
    """Mark the longest unmarked common run (first in the document, then in the item) until none has `least` words."""
    ud, ui = [0] * len(doc), [0] * len(item)
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not ud[i + k] and not ui[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return sum(ui)
        ud[i : i + k] = ui[j : j + k] = [1] * k


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        letters = "abcdef"[: rng.randint(1, 6)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(1, n))] for n in (40, 20))
        assert tile(_stable(a), _stable(b), 3) == greedy(a, b, 3)
    h = _stable(list("abcab"))
    r = rolling(h, 2)
    assert r[0] == r[3] and len(np.unique(r)) == 3 and len(rolling(h, 6)) == 0


def test_long_item_in_a_very_long_text():
    rng = random.Random(5)
    item = [f"w{rng.randrange(3000)}" for _ in range(5_000)]
    doc, i = [f"w{rng.randrange(3000)}" for _ in range(60_000)], 0
    while i < len(item):
        n, at = rng.randint(3, 60), rng.randrange(len(doc) - 60)
        doc[at : at + n] = item[i : i + n]
        i += n
    began = time.perf_counter()
    assert tile(_stable(doc), _stable(item), 3) > 4_000
    assert time.perf_counter() - began < 30  # some seconds at worst, not minutes: no pass for each length there could be


def test_planted_reordered_and_clean(spark, world, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"Item{i}w{j}" for j in range(24)) + ".") for i in range(6)] + [(10, "short one here"), (11, None), (12, ""), (None, "no id for this item at all")]
    w = items[3][1].split()
    rows = [(i, sentence(rng, "en", 200), "en", "s") for i in range(30)]
    rows += [(100, f"{rows[0][1]} {items[2][1].upper()} {rows[1][1]}", "en", "s"), (101, " ".join([*w[16:], "and", *w[:8], "then", *w[8:16]]), "en", "s"), (102, " ".join(w[:10]), "en", "s")]
    rows += [(103, "so SHORT, one: here it is", "en", "s"), (104, "Short here one", "en", "s")]
    sf = world(rows + edge_rows(4)[-15:], benchmark=items)
    for rows, bits in ((500_000, 1 << 27), (0, 64)):  # all joins by broadcast; all by a shuffle, with a filter that lets everything through
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
        out = {r["doc_id"]: r for r in op6_decontamination(spark, sf).collect()}
        assert {i for i, r in out.items() if r["contaminated"]} == {100, 101, 103}
        assert out[100]["item_id"] == 2 and out[101]["item_id"] == 3 and out[101]["coverage"] == 1.0 and abs(out[102]["coverage"] - 10 / 24) < 1e-9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = decontamination_stage(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_query_against_brute_force(spark, world, monkeypatch):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(2, 14)))) for k in range(120)] + [(7, "v1 v2 v3 v4 v5 v6"), (200, "v1 " * 30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "en", "s") for i in range(60)]
    rows += [(i + 60, rows[i][1], "en", "s") for i in range(20)] + [(i + 100, " ".join(rng.choice(items)[1] for _ in range(4)), "en", "s") for i in range(20)]
    monkeypatch.setattr(decontaminate, "ITEMS_A_ROW", 7)  # a text's items in many rows
    out = {r["doc_id"]: r for r in op6_decontamination(spark, world(rows, benchmark=items)).collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    for i, t, *_ in rows:
        doc, best = words_of(t), (0.0, None)
        for k, it in items:
            w = words_of(it)
            n = min(5, len(w))
            if grams(doc, n) & grams(w, n):
                c = greedy(doc, w, min(3, len(w))) / len(w)
                if c > best[0] or (c == best[0] and best[1] is not None and k < best[1]):
                    best = c, k
        assert (out[i]["coverage"], out[i]["item_id"]) == best and out[i]["contaminated"] == (best[0] >= 0.8)


def test_empty_tables(spark, world):
    rows = edge_rows()
    out = op6_decontamination(spark, world(rows)).collect()
    assert len(out) == len(rows) and not any(r["contaminated"] for r in out) and all(r["coverage"] == 0 for r in out)
    assert op6_decontamination(spark, world([], benchmark=[(1, "some words to look for here")])).count() == 0
    assert words_of(None) == [] and words_of("Don't_stop, ÉTÉ 3.5") == ["don", "t", "stop", "été", "3", "5"]
