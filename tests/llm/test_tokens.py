import random
import zlib

import numpy as np
import pytest

from spindrift.llm import tokens
from spindrift.llm.tokens import Encoder, decode_range, default_tokenizer, expand, lengths, op4_repair_tokens, repair, write_shards

from .conftest import SCHEMA, edge_rows

PARTS = ["a", "ab", "é", "ß", "word", "don't", "x.y", "1,2", "...", "\n", " ", "  ", "\t", "\xa0", "日本", "🙂", "<|endoftext|>", "'s", "$$$", "\r\n", "_", "Z" * 60, "\x00", "\x1c", "-"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_words_give_what_whole_texts_give(library):
    rng = random.Random(5)
    encoder = Encoder(default_tokenizer(), "<u2")
    for _ in range(150):
        texts = ["".join(rng.choice(PARTS) + rng.choice([" ", "", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 12))]
        ids, n = encoder.encode(texts, 0)
        want = [x + [0] for x in library(texts)]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_strings_of_special_tokens():
    text = ["hello <|endoftext|> world", "plain text"]
    ids, n = Encoder(default_tokenizer(), "<u2").encode(text, 0)
    plain, _ = Encoder(default_tokenizer(), "<u2", plain_specials=True).encode(text, 0)
    assert 50256 in ids.tolist() and 50256 not in plain.tolist() and n[0] == 5


@pytest.mark.parametrize("n, end", [(0, 1 << 16), (1, 1 << 16), (2, 1 << 16), (500, 1 << 16), (20_000, 1 << 16), (20_000, 330), (5_000, 1 << 32)])
def test_repair_round_trip_and_random_access(n, end):
    rng = random.Random(n)
    ids = np.array([rng.choice([1, 2, 3, 7, rng.randrange(300)]) for _ in range(n)] + [5] * (n // 10), np.uint32)
    s, left, right = repair(ids, 300, end, least=3)
    assert 300 + len(left) <= end and (expand(s, left, right, 300) == ids).all()
    if n >= 20_000 and end > 1000:
        assert len(s) < 0.8 * len(ids)
    size = lengths(left, right, 300)
    for _ in range(50):
        a = rng.randint(0, len(ids))
        b = rng.randint(a, len(ids))
        assert (decode_range(s, left, right, size, 300, a, b) == ids[a:b]).all()


def test_query_on_edge_rows(spark, world, library):
    rows = edge_rows()
    out = op4_repair_tokens(spark, world(rows)).collect()
    assert len(out) == len(rows)
    want = sorted((i is not None, i or 0, len(x) + 1, zlib.crc32(np.array(x + [0], "<u4").tobytes())) for (i, *_), x in zip(rows, library([r[1] or "" for r in rows]), strict=True))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in out) == want
    out.sort(key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_many_shards_and_random_access_from_the_file(spark, tmp_path, library, monkeypatch):
    rows = edge_rows(3)
    shards = write_shards(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/t", default_tokenizer(), shard_bytes=2_000)
    assert shards.count() > 10
    text = {r[0]: r[1] for r in rows}
    for r in shards.collect()[:8]:
        left, right, s, size = (np.frombuffer(x, kind).astype(np.int64) for x, kind in ((r["rule_left"], "<u2"), (r["rule_right"], "<u2"), (r["symbols"], "<u2"), (r["rule_length"], "<u4")))
        at = 0
        for i, n in zip(r["doc_ids"], r["doc_tokens"], strict=True):
            if i is not None:
                assert decode_range(s, left, right, size, r["first_free"], at, at + n).tolist() == library([text[i] or ""])[0] + [0]
            at += n


def test_shards_stay_small_beyond_the_most_ranges(spark, tmp_path, library):
    rows = [(i, f"number {i} " * 20, "en", "s") for i in range(800)]
    shards = write_shards(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/t", default_tokenizer(), shard_bytes=2_000, max_ranges=5)
    found = shards.collect()
    size = {i: len(t) + 1 for i, t, *_ in rows}
    assert len(found) > 60 and max(sum(size[i] for i in r["doc_ids"]) for r in found) < 2 * 2_000 + 300
    out = sorted(tokens.read_documents(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == list(range(800))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))
    assert [r["n_tokens"] for r in out] == [len(x) + 1 for x in library([t for _, t, *_ in rows])]


def test_empty_table(spark, world):
    assert op4_repair_tokens(spark, world([])).count() == 0
    assert tokens.SHARD_BYTES > 0
