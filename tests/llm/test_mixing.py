import random
import re

from pyspark.sql import functions as F

from spindrift.llm import mixing
from spindrift.llm.mixing import mix, mix_overlapping_sources, op1_mixing, route, target_words

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_share_everything_below_the_cap():
    sizes = {"a": 10, "b": 1000, "c": 500, None: 20}
    t = target_words(sizes, {"a": 5, "b": 2, "c": 1, None: 5})
    assert abs(sum(t.values()) - 1530) < 1e-9 and t["a"] == 30 and t[None] == 60 and abs(t["b"] / t["c"] - 2) < 1e-9
    assert target_words({}, {}) == {} and target_words({"a": 0}, {"a": 1}) == {"a": 0}


def least_cost(capacity, quota, levels):
    """Brute force over whole words: the most routed, then the least sum of repetition costs (0, 1, 3 a word)."""
    patterns, sources = list(capacity), list(quota)
    best = None

    def go(i, left, cost, routed):
        nonlocal best
        if i == len(patterns):
            key = (-routed, cost)
            best = key if best is None or key < best else best
            return
        p, cap = patterns[i], capacity[patterns[i]]

        def share(k, given, left):
            if k == len(p):
                yield given, left
                return
            for x in range(min(left[p[k]], levels * cap - given) + 1):
                yield from share(k + 1, given + x, left | {p[k]: left[p[k]] - x})

        for given, rest in share(0, 0, left):
            extra = max(0, min(given - cap, cap)) * 1 + max(0, given - 2 * cap) * 3
            go(i + 1, rest, cost + extra, routed + given)

    go(0, dict(quota), 0, 0)
    return best


def test_flow_is_of_least_cost():
    rng = random.Random(1)
    for _ in range(25):
        sources = ["a", "b", "c"][: rng.randint(1, 3)]
        patterns = {tuple(sorted(rng.sample(sources, rng.randint(1, len(sources))))) for _ in range(3)}
        capacity = {p: rng.randint(0, 3) for p in patterns}
        quota = {s: rng.randint(0, 5) for s in sources}
        given = route(capacity, quota)
        words = {p: sum(g.values()) for p, g in given.items()}
        assert all(words[p] <= 3 * capacity[p] for p in capacity)
        for s in sources:
            assert sum(g.get(s, 0) for g in given.values()) <= quota[s]
        cost = sum(max(0, min(words[p] - capacity[p], capacity[p])) + 3 * max(0, words[p] - 2 * capacity[p]) for p in capacity)
        assert (-sum(words.values()), cost) == least_cost(capacity, quota, 3)


def test_overlapping_sources(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice([["a"], ["b"], ["a", "b"], ["b", "a", "a"]])) for i in range(3000)]
    rows += [(9000, "lost words", []), (9001, "lost words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    found = mix(df, F.col("members"), ["doc_id"], weights=(1, 3))
    out = {r["doc_id"]: r for r in found.documents.collect()}
    assert len(out) == len(rows) and out[9000]["_mix_repeats"] == 0 == out[9001]["_mix_repeats"]
    for s in ("a", "b"):
        got = sum(r["_mix_size"] * r["_mix_routed"].count(s) for r in out.values())
        assert abs(got - found.targets[s]) <= 60
    for i, _, m in rows:
        assert set(out[i]["_mix_routed"]) <= set(m or []) and out[i]["_mix_repeats"] <= 3


def test_query_on_edge_rows(spark, world):
    sf = world(edge_rows())
    rows = op1_mixing(spark, sf).collect()
    assert len(rows) == len(edge_rows())
    size = sorted(len(WORD.findall(t or "")) for _, t, _, _ in edge_rows())
    assert sorted(r["size"] for r in rows) == size
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert all(r["source_size"] == sum(x["size"] for x in own) for r in own) and own[0]["target"] <= 3 * own[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, op1_mixing(spark, sf).collect()))


def test_buckets_decide_nothing(spark, monkeypatch):
    df = spark.range(5_000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 17 AS int)) AS text")
    taken = lambda: sorted(map(tuple, mix(df, F.array(F.lit("s")), ["doc_id"], weights=(1,), max_repeats=1).documents.where("doc_id % 3 = 0").collect()))
    monkeypatch.setattr(mixing, "target_words", lambda sizes, weights, cap: {s: n / 2 for s, n in sizes.items()})
    few = taken()
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)  # 5,000 buckets, in 50 groups
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 100)
    assert taken() == few and 0 < sum(r[2] for r in few) < len(few)


def test_texts_held_by_several_sources(spark, world):
    rows = [(i, f"text of number {i // 2}", "en", ("a", "b", None)[(i % 2) * (1 + i % 3 // 2)]) for i in range(300)] + [(900, None, "en", "a"), (901, "", "en", "b")]
    sf = world(rows)
    sources = {}
    for i, t, _, s in rows:
        if t is not None:
            sources.setdefault(t, [i, set()])[1].add(s)
    out = {r["doc_id"]: r for r in mix_overlapping_sources(spark, sf).collect()}
    assert {i: set(r["sources"]) for i, r in out.items()} == {i: s for i, s in sources.values()}
    assert all(set(r["routed"]) <= set(r["sources"]) and len(r["routed"]) == r["repeats"] for r in out.values()) and any(len(set(r["routed"])) > 1 for r in out.values())
    assert mix_overlapping_sources(spark, world([])).count() == 0


def test_empty_table(spark, world):
    assert op1_mixing(spark, world([])).count() == 0
