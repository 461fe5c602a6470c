import hashlib
import math
import random
import re

from spindrift.llm.pii import find, op10_pii_sanitise, sanitised

from .conftest import SCHEMA, edge_rows

# The patterns as the contract gives them.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def base(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


ALPHABET = ["a@b.c", "@", ".", "1.2.3.4", "300.1.1.1", "0255.1.1.01", "4111 1111-1111 1111", "4111111111111112", "12", "-", " ", "+", "+1 (017) 555-7713", "+49", "(", "é", "🙂", "x_y%z@mail.example.com", "\n", "5", "9" * 13, "@a-b.c-d", "..", "+1"]


def test_spans_against_the_plain_patterns(spark, world):
    rng = random.Random(1)
    rows = [(10_000 + i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 14))), "en", "s") for i in range(1_500)] + [r for r in edge_rows() if r[0] is not None]
    rows.append((5_000, "a" * 10_000 + " " + "1" * 10_000 + " " + "1." * 5_000 + "+" + "1" * 10_000, "en", "s"))
    rows.append((5_001, "a@b" + ".c" * 20_000 + " 4111 1111 1111 1111 " * 300, "en", "s"))
    text = {}
    for r in rows:
        text.setdefault(r[0], []).append(r[1])
    out = op10_pii_sanitise(spark, world(rows)).collect()
    assert len(out) == len(rows) and sum(r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] > 0 for r in out) > 200
    for r in out:
        spans = base(text[r["doc_id"]][0])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert hashlib.sha256(written.encode()).hexdigest() == r["base_sha256"] and r["spans"].startswith(written)


def corpus():
    rng = random.Random(2)
    common = "the of and to in that was with for are this from have".split()
    rows = []
    for i in range(120):
        words = [rng.choice(common) for _ in range(30)]
        if i % 10 == 0:  # one person, with a telling name beside the address
            words[10:10] = ["Quillfeather", "zeta.q@mail.example.com"]
        if i % 10 == 1:  # an address alone among common words
            words[5:5] = ["info@shop.example.com"]
        rows.append((i, " ".join(words), "en", "s"))
    return rows


def classes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.split("@")[-1].lower(), "ip": value.rsplit(".", 1)[0]}.get(kind, digits[:6])


def telling_of(texts, support=2, class_support=5, generalise=0.9):
    """Terms that tell of a value or its class, by plain counting over distinct texts."""
    texts = sorted(set(texts))
    n = len(texts)
    terms, holds = [], {}
    for i, t in enumerate(texts):
        spans = base(t)
        terms.append({m[0].lower() for m in re.finditer(r"[^\W_]+", t)})
        free = {m[0].lower() for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and m.start() < b for _, a, b in spans)}
        for k, a, b in spans:
            for e in ((k, False, t[a:b]), (k, True, classes(k, t[a:b]))):
                holds.setdefault(e, {})[i] = free
    out = {}
    for e, docs in holds.items():
        for w in set().union(*docs.values()):
            both = sum(w in free for free in docs.values())
            if both < (class_support if e[1] else support) or len(docs) == n:
                continue
            share = math.log2(both * n / (len(docs) * sum(w in x for x in terms))) / math.log2(n / len(docs))
            if share >= generalise:
                out[w] = max(out.get(w, 0), share)
    return out


def check_against_counting(spark, rows):
    want = telling_of([t for _, t, *_ in rows])
    out = {r["doc_id"]: r for r in find(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        spans = base(t)
        places = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        places = [(a, b, "remove" if want[w] >= 0.95 else "generalise", want[w]) for a, b, w in places if w in want]
        found = [(s["start"], s["end"], s["action"], s["share"]) for s in out[i]["terms"]]
        assert [x[:3] for x in found] == [x[:3] for x in places] and all(abs(x[3] - y[3]) < 1e-9 for x, y in zip(found, places, strict=True))
    return want, out


def test_telling_terms_by_counting(spark):
    rows = corpus()
    want, _ = check_against_counting(spark, rows)
    assert "quillfeather" in want and "the" not in want
    texts = [t for _, t, *_ in rows]
    clean = {r["doc_id"]: r["clean_text"] for r in sanitised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "Quill" not in clean[0] and "<EMAIL>" in clean[0] and clean[2] == texts[2]
    general = {r["doc_id"]: r["clean_text"] for r in sanitised(spark.createDataFrame(rows, SCHEMA), remove_from=2.0).collect()}
    assert general[0] == texts[0].replace("Quillfeather", "<NAME>").replace("zeta.q@mail.example.com", "<EMAIL>")


def test_terms_are_marked_where_no_value_stands(spark):
    rows = corpus()
    rows += [(500 + i, f"{rows[2 + i][1]} Quillfeather was here", "en", "s") for i in range(3)]
    want, out = check_against_counting(spark, rows)
    assert 0.9 <= want["quillfeather"] < 0.95
    assert all([x["action"] for x in out[500 + i]["terms"]] == ["generalise"] and not out[500 + i]["base"] for i in range(3))


def test_copies_say_nothing_twice(spark):
    once = corpus()
    many = once + [(1_000 + i, once[10][1], "en", "s") for i in range(40)] + [(2_000 + i, once[3][1], "en", "s") for i in range(40)]
    assert check_against_counting(spark, many)[0] == telling_of([t for _, t, *_ in once])
    lone = [(i, t, "en", "s") for i, t in enumerate(["the of and to in that was"] * 50 + ["write to Zeta at zeta.q@mail.example.com today"] * 9 + [f"other words {k}" for k in range(20)])]
    assert check_against_counting(spark, lone)[0] == {}


def test_a_class_of_values_is_an_entity(spark):
    rng = random.Random(4)
    common = "the of and to in that was with for are this from have".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(30)) + f" {i}", "en", "s") for i in range(200)]
    rows += [(300 + i, " ".join(rng.choice(common) for _ in range(20)) + f" Acmecorp person{i}@acme.example.com", "en", "s") for i in range(6)]
    want, _ = check_against_counting(spark, rows)
    assert want == {"acmecorp": 1.0}


def test_secrets_are_spans_of_their_own(spark, world):
    secret = "908038b7daaf91e730d2f64001c52934d43"
    texts = [f'so token = "{secret}" it is', f"API_KEY={secret.upper()}, a@b.cd", f"a hash {secret} of no name", "password: correct horse battery", "token = abcdefghijklmnopqrstuvwx", None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    out = {r["doc_id"]: r for r in op10_pii_sanitise(spark, world(rows)).collect()}
    assert out[0]["spans"] == f"secret:{texts[0].index(secret)}:{texts[0].index(secret) + 35}" and out[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert out[1]["spans"] == "email:45:51,secret:8:43" and out[1]["base_sha256"] == hashlib.sha256(b"email:45:51").hexdigest()
    assert [out[i]["spans"] for i in (2, 3, 4, 5)] == [""] * 4
    clean = {r["doc_id"]: r["clean_text"] for r in sanitised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[0] == 'so token = "<SECRET>" it is' and clean[1] == "API_KEY=<SECRET>, <EMAIL>"


def test_very_many_matches_in_a_text(spark, world):
    text = "a@b.cd " * 60_000
    out = op10_pii_sanitise(spark, world([(1, text, "en", "s")])).first()
    assert out["n_email"] == 60_000
    assert out["base_sha256"] == hashlib.sha256(",".join(f"email:{7 * i}:{7 * i + 6}" for i in range(60_000)).encode()).hexdigest()


def test_empty_table(spark, world):
    assert op10_pii_sanitise(spark, world([])).count() == 0


def test_telling_terms_anywhere_in_the_document(spark):
    rng = random.Random(3)
    common = "the of and to in that was with for are this from have".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(30)), "en", "s") for i in range(100)]
    text = "Zorblax Quimby, head of sales at our Leeds office, zq@x.com. Ask Zorblax. "
    rows += [(200 + i, text + " ".join(rng.choice(common) for _ in range(5)), "en", "s") for i in range(5)]
    _, out = check_against_counting(spark, rows)
    marked = {(s["start"], s["end"]) for s in out[200]["terms"]}
    assert {(m.start(), m.end()) for m in re.finditer("Zorblax|Quimby", text)} <= marked and not out[0]["terms"]
    clean = {r["doc_id"]: r["clean_text"] for r in sanitised(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert "Zorblax" not in clean[200] and "Quimby" not in clean[200]


def test_adjacent_values_take_no_place_from_terms(spark):
    # the card alone repeats, so nothing but the card can tell of the name
    rows = [(i, f"the of and to in that was with {i}", "en", "s") for i in range(100)]
    rows += [(200 + i, f"Quillfeather 213.174.{i}.103, 4111111111111111", "en", "s") for i in range(3)]
    _, out = check_against_counting(spark, rows)
    assert [m["kind"] for m in out[200]["base"]] == ["ip", "card"]
    assert all([(s["start"], s["end"]) for s in out[200 + i]["terms"]] == [(0, 12)] for i in range(3))
