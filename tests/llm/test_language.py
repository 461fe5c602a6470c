import random

from spindrift.llm.language import Parser, op2_language_id

from .conftest import VOCABULARY, edge_rows, sentence


def phrases(x, train):
    i = count = 0
    while i < len(x):
        k = 1
        while i + k <= len(x) and x[i : i + k] in train:
            k += 1
        i += max(1, k - 1)
        count += 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    train = {lang: sentence(rng, lang, 200).encode() for lang in VOCABULARY}
    parser = Parser.of(train)
    texts = [sentence(rng, rng.choice(list(VOCABULARY)), rng.randint(1, 120)).encode()[:1000] for _ in range(40)] + [b"\x00\xff\xfe", b"a", b"zzzzzz"]
    for x, found in zip(texts, parser.phrases(texts), strict=True):
        assert [phrases(x, train[lang]) for lang in parser.langs] == found.tolist()
    # longer texts are parsed block by block, whole
    long = sentence(rng, "en", 2_000).encode()
    want = [sum(phrases(long[i : i + 1024], train[lang]) for i in range(0, len(long), 1024)) for lang in parser.langs]
    assert parser.phrases([long])[0].tolist() == want


def test_table_grows_with_transitions_alone():
    rng = random.Random(4)
    wide = {f"l{k}": "".join(chr(rng.randrange(0x4E00, 0x9000)) + rng.choice("abc ") for _ in range(500)).encode() for k in range(50)}
    parser = Parser.of(wide)
    learnt = sum(map(len, wide.values()))
    assert parser.slots.nbytes <= 8 * (3 * learnt + 50 * 512)
    for k in (0, 17, 49):
        x = wide[f"l{k}"][100:400]
        assert parser.phrases([x])[0][parser.langs.index(f"l{k}")] == 1 and parser.phrases([x])[0].max() > 20


def test_held_out_accuracy(spark, world):
    rng = random.Random(2)
    rows = [(i, sentence(rng, lang := rng.choice(list(VOCABULARY)), rng.randint(5, 60)), lang, "s") for i in range(300)]
    out = {r["doc_id"]: r for r in op2_language_id(spark, world(rows)).collect()}
    held = [r for r in rows if out[r[0]]["held_out"]]
    assert len(held) > 50 and sum(out[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_edge_rows(spark, world):
    rows = edge_rows()
    out = op2_language_id(spark, world(rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" for i in (200, 201, 202, 205, 208))
    assert by[204]["lang_pred"] == "en" and by[206]["lang_pred"] != "und"
    assert all(not r["held_out"] for r in out if r["doc_id"] is None)


def test_nothing_to_learn_from_and_empty(spark, world):
    out = op2_language_id(spark, world([(1, "some words", None, "s")])).first()
    assert out["lang_pred"] == "und" and out["score"] == 0
    assert op2_language_id(spark, world([])).count() == 0
