import gzip
import random

from pyspark.sql import functions as F

from spindrift.llm import warc
from spindrift.llm.warc import canonical_url, op3_warc_revisits, read_warc, resolve_revisits, whole_records

SCHEMA = f"record_id string, type string, url string, ts long, headers {warc.HEADERS}, digest string"


def test_canonical_urls(spark):
    same = ["http://www.Example.com/a/", "https://user@example.com:443/a#frag", "EXAMPLE.com/a?utm_source=x&ref=y"]
    other = ["http://example.com/A", "http://example.com/a?b=2&a=1", "http://example.com:8080/a"]
    df = spark.createDataFrame([(u,) for u in same + other + ["", None, "#x"]], "u string")
    found = [r[0] for r in df.select(canonical_url(F.col("u"))).collect()]
    assert set(found[:3]) == {"example.com/a"} and found[3:6] == ["example.com/A", "example.com/a?a=1&b=2", "example.com:8080/a"] and found[6:] == [None] * 3


def records(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        url = rng.choice(["http://a.com/x", "http://www.a.com/x#1", "http://b.com/y", None, "http://c.com/z"])
        tag = rng.choice(["1", "2"])
        h = {"ETag": f'"{tag}"', "Date": f"d{i}", "Content-Type": "t"} if rng.random() < 0.7 else {"last-modified": tag, "Server": "s"}
        if rng.random() < 0.1:
            h = None
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        rows.append((f"r{i:04d}", kind, url, rng.choice([None, *range(40)]), None if h is None else list(h.items()), f"p{i}" if kind == "response" else None))
    return rows


def brute(rows):
    key = {"http://a.com/x": "a.com/x", "http://www.a.com/x#1": "a.com/x", "http://b.com/y": "b.com/y", "http://c.com/z": "c.com/z", None: None}
    out = {}
    for rid, kind, url, ts, h, _ in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[1] == "response" and key[r[2]] is not None and key[r[2]] == key[url] and r[3] is not None and ts is not None and r[3] < ts]
        if not before:
            out[rid] = ("no_response", None)
            continue
        last = max(before, key=lambda r: (r[3], r[0]))
        mine, theirs = ({k.lower(): v for k, v in (x or [])} for x in (h, last[4]))
        kind = "unvalidated"
        for name, bad in (("etag", "etag_mismatch"), ("last-modified", "date_mismatch")):
            if name in mine and name in theirs:
                kind = "resolved" if mine[name] == theirs[name] else bad
                break
        out[rid] = (kind, last[0])
    return out


def test_against_brute_force_in_one_and_in_many_buckets(spark, monkeypatch):
    rows = records(3, 300)
    want = brute(rows)
    assert len({k for k, _ in want.values()}) == 5
    df = spark.createDataFrame(rows, SCHEMA)
    for per_bucket in (100_000, 20):
        monkeypatch.setattr(warc, "BUCKET_ROWS", per_bucket)
        found = {r["record_id"]: (r["outcome"], r["response_id"]) for r in resolve_revisits(df).collect()}
        assert found == want


def test_only_permitted_headers_are_merged(spark):
    rows = [("a", "response", "http://a.com", 1, [("ETag", '"1"'), ("Content-Type", "html"), ("Vary", "x")], "p"), ("b", "revisit", "http://a.com/", 2, [("etag", 'W/"1"'), ("Set-Cookie", "c"), ("Vary", "y"), ("Content-Type", "none")], None)]
    row = resolve_revisits(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["outcome"] == "resolved" and row["digest"] == "p"
    assert {h["name"]: h["value"] for h in row["headers"]} == {"content-type": "html", "etag": 'W/"1"', "vary": "y"}
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_odd_pages(spark, world):
    pages = [(i, f"http://h{i % 3}.com/p{i}", f"<p>{i}</p>") for i in range(40)] + [(50, None, None), (51, "", "x"), (52, "http://h.com/p", None), (None, "http://h.com/q", "y"), (1, "http://h1.com/p1", "<p>1</p>")]
    out = op3_warc_revisits(spark, world([], pages=pages)).collect()
    assert len(out) == len(pages) and {r["outcome"] for r in out} >= {"resolved", "etag_mismatch", "no_response"}
    assert op3_warc_revisits(spark, world([])).count() == 0


def test_warc_files(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\n<html>"
    again = b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\nDate: later\r\n\r\n"

    def record(kind, rid, date, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\nWARC-Target-URI: http://a.com/\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: d-{rid}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = record("response", "one", "2026-01-01T00:00:00Z", body) + record("metadata", "m", "2026-01-01T00:00:00Z", b"x") + record("revisit", "two", "2026-01-02T00:00:00Z", again)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    (tmp_path / "b.warc").write_bytes(data)
    for name in ("a.warc.gz", "b.warc"):
        found = read_warc(spark, f"file://{tmp_path}/{name}")
        assert sorted((r["record_id"], bytes(r["payload"]), r["status"]) for r in found.collect()) == [("one", b"<html>", 200), ("two", b"", 304)]
        row = resolve_revisits(found.drop("payload")).first()
        assert row["outcome"] == "resolved" and row["digest"] == "d-one"


def test_damaged_and_odd_warc_files(spark, tmp_path):
    rng = random.Random(1)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(rng.randint(0, 3_000)) + rng.choice([b"", b"\r\n\r\nWARC/1.0\r\nnot a record", b"\r\n\r\n"]) for _ in range(50)]
    rec = lambda i, b, n=None: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: r{i}\r\nContent-Length: {len(b) if n is None else n}\r\n\r\n".encode() + b + b"\r\n\r\n"
    data = b"".join(rec(i, b) for i, b in enumerate(blocks))
    members = b"".join(gzip.compress(rec(i, b)) for i, b in enumerate(blocks))
    want = sorted((f"r{i}", b[19:]) for i, b in enumerate(blocks))
    got = lambda name: sorted((r["record_id"], bytes(r["payload"])) for r in read_warc(spark, f"file://{tmp_path}/{name}").collect())
    (tmp_path / "whole.warc").write_bytes(data)
    (tmp_path / "members.warc.gz").write_bytes(members)
    (tmp_path / "cut.warc.gz").write_bytes(members[: len(members) // 2])
    (tmp_path / "length.warc").write_bytes(rec(0, b"short", "many") + rec(1, b"last", 4_000))
    (tmp_path / "empty.warc").write_bytes(b"")
    assert got("whole.warc") == want == got("members.warc.gz")
    cut = got("cut.warc.gz")
    assert 10 < len(cut) < 50 and set(cut[:-1]) & set(want)
    assert got("length.warc") == [("r0", b"short"), ("r1", b"last\r\n\r\n")] and got("empty.warc") == []
    assert list(whole_records(iter([]))) == []


def test_only_full_responses_and_not_modified_revisits(spark):
    rows = [
        ("ok", "response", "http://a.com", 1, None, "p1", 200, None, None),
        ("lost", "response", "http://a.com", 2, None, "p2", 404, None, None),
        ("moved", "response", "http://a.com", 3, None, "p3", 301, None, None),
        ("part", "response", "http://a.com", 4, None, "p4", 206, None, None),
        ("asked", "revisit", "http://a.com", 5, None, None, 304, "http://netpreserve.org/warc/1.1/revisit/server-not-modified", "ok"),
        ("elsewhere", "revisit", "http://a.com", 6, None, None, None, None, "part"),
        ("same", "revisit", "http://a.com", 7, None, "p1", 200, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "ok"),
    ]
    out = {r["record_id"]: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA + ", status int, profile string, refers_to string")).collect()}
    assert [(out[i]["outcome"], out[i]["response_id"], out[i]["as_referred"]) for i in ("asked", "elsewhere", "same")] == [("unvalidated", "ok", True), ("unvalidated", "ok", False), ("other_profile", None, None)]
