import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import simhash
from spindrift.llm.simhash import close_pairs, fingerprint, links_within, op7_simhash, simhash_stage

from spindrift.operators.graph import connected_components

from .conftest import edge_rows, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(t):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, radius=3):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def planted(seed, n):
    """Numbers of which many are a few bits apart, in chains too."""
    rng = random.Random(seed)
    out = [0, (1 << 64) - 1, 7]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.5 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_fingerprints():
    for _, t, *_ in edge_rows():
        if len(t or "") < 60_000:
            assert fingerprint(t) == brute_print(t)
    assert fingerprint("A b") == fingerprint("a B") == xxhash.xxh64_intdigest(b"a b", 42)


def test_pairs_are_all_found(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    v = np.array(sorted(set(planted(1, 300))), np.uint64)
    i, j = close_pairs(v, None, 3)
    want = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if int(v[a] ^ v[b]).bit_count() <= 3}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and len(i) == len(want)
    i, j = close_pairs(v[:100], v[100:], 3)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b - 100) for a, b in want if a < 100 <= b}


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    v = sorted(set(planted(2, 500)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in v], "fp long")
    found = {r["node"]: r["component"] for r in connected_components(links_within(df), "a", "b").collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in v]
    groups = brute_groups(v)
    for a in range(len(v)):
        for b in range(a):
            assert (groups[a] == groups[b]) == (found.get(signed[a], signed[a]) == found.get(signed[b], signed[b]))


def test_query_and_stage(spark, world):
    rng = random.Random(6)
    rows = edge_rows()
    base = sentence(rng, "en", 300)
    rows += [(300 + k, base + f" tail{k}", "en", "s") for k in range(10)] + [(400 + k, base, "en", "s") for k in range(30)]
    sf = world(rows)
    out = op7_simhash(spark, sf).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    groups = brute_groups(prints)
    least = {}
    for (i, *_), g in zip(rows, groups, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted((i is not None, i or 0, f"{p:016x}", least.get(g)) for (i, *_), p, g in zip(rows, prints, groups, strict=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in out) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(groups)) and sorted(i for i in ids if i is not None) == sorted(least.values())
    assert simhash_stage(spark, docs.where(F.lit(False)), sf).count() == 0


def test_null_ids_and_empty(spark, world):
    rows = [(None, "one two three four", "en", "s"), (None, "completely different words here", "en", "s"), (None, "one two three four", "en", "s")]
    sf = world(rows)
    assert simhash_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count() == 2
    assert op7_simhash(spark, world([])).count() == 0


def five_word_sets(texts):
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    return [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]


def jaccard_groups(texts):
    sets = five_word_sets(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_stage_keeps_one_of_each_group_by_brute_force_jaccard(spark, world, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(8)
    texts = []
    for i in range(25):
        base = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([30, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # copies of copies too, on both sides of 0.8
            base = list(base)
            for _ in range(max(1, len(base) * rng.choice([1, 2, 4]) // 100)):
                base[rng.randrange(len(base))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(base))
    common = [f"c{k}" for k in range(150)]
    for k in range(60):  # a large group of near copies
        texts.append(" ".join([*common[: k + 40], f"own{k}", *common[k + 40 :]]))
    groups = jaccard_groups(texts)
    # op7's contract would keep more: that is what this stage must not do
    assert len(set(groups)) < len(set(brute_groups([brute_print(t) for t in texts])))
    sf = world([(i, t, "en", "s") for i, t in enumerate(texts)])
    kept = simhash_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(groups))
