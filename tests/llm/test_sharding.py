import random
import zlib

import numpy as np
import pytest

from spindrift.llm import sharding
from spindrift.llm.sharding import Splitters, op8_sharding, shard_by_bytes

from .conftest import SCHEMA, edge_rows


def test_locate():
    s = Splitters(np.array([1, 5, 5, 5, 9]), np.array([0, 2, 4, 6, -(2**63)]))
    pairs = list(zip(s.first.tolist(), s.second.tolist(), strict=True))
    rng = random.Random(0)
    keys = [(rng.randrange(11), rng.randrange(8)) for _ in range(300)]
    found = s.locate(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
    assert found.tolist() == [sum(p <= k for p in pairs) for k in keys]


def check(rows, out, n_shards=8):
    assert len(out) == len(rows)
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == want
    for s in range(n_shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_edge_rows(spark, world):
    rows = edge_rows()
    sf = world(rows)
    out = op8_sharding(spark, sf).collect()
    check(rows, out)
    assert {r["law"] for r in out} == {"bytes"} and all(r["grown_shard"] is None for r in out)
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
    assert sorted(map(key, out)) == sorted(map(key, op8_sharding(spark, sf).collect()))
    assert op8_sharding(spark, world([])).count() == 0


@pytest.mark.parametrize("least", [1, 2_048])
def test_near_equal_with_a_third_in_one_group(spark, monkeypatch, least):
    monkeypatch.setattr(sharding, "MIN_RANGES", max(least, 256))
    rng = random.Random(1)
    rows = [(i, "copy of one text " * 5 if i % 3 == 0 else "t" * rng.randint(1, 300) + str(i), "en", "s") for i in range(6_000)]
    out = shard_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    check(rows, out)
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(8)]
    assert max(sizes) < 1.03 * sum(sizes) / 8 and min(sizes) > 0.97 * sum(sizes) / 8


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 4} " * 10, "en", "s") for i in range(8_000)]
    out = shard_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect()
    shards = {}
    for r in out:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
