import hashlib
import random

import pyarrow.parquet as pq

from thicket.llm.store import Workspace
from thicket.llm.warc import LoserTree, archive_pages, capture_index, parse, read_archives, url_key, write_archives

SCHEMA = "page_id long, url string, html string"
LONG = "é" * 60
ODD = [
    (1, "http://a.example/x", LONG), (2, "https://B.example:80/?q=1#f", LONG), (3, None, LONG), (4, "no scheme", None), (5, "u\r\nWARC-Type: x", ""),
    (6, "http://a.example/x", "short"), (7, "http://a.example/x", "short"), (None, "http://a.example/x", LONG), (8, "http://c/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 9),
    (9, "http://c/", "x" * 300000), (1, "http://a.example/x", LONG), (None, None, "only null " * 20), (None, None, "only null " * 20),
]


def want(rows):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        r = first.get(b) if len(b) >= 100 else None
        again = r is not None and p != r
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", r if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip(spark):
    rows = ODD + [(r["page_id"] + 100, r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()]
    df = spark.createDataFrame([(*r, "z") for r in rows], SCHEMA + ", record_type string").repartition(4)
    index = archive_pages(df)
    assert got(index) == want(rows)
    keys = [(r.url_key, r.time, -1 if r.page_id is None else r.page_id) for r in index.collect()]
    assert keys == sorted(keys)


def test_payloads_byte_for_byte(spark):
    ws = Workspace(spark, "test")
    for how in ("none", "gzip"):
        path = ws.path(f"a-{how}")
        write_archives(spark.createDataFrame(ODD, SCHEMA), path, ws, compression=how)
        back = [r for f in spark.read.format("binaryFile").load(path).collect() for r in parse(f.content if how == "none" else __import__("gzip").decompress(f.content))]
        payloads = sorted(p for _, h, p in back if h["WARC-Type"] == "response")
        assert payloads == sorted((h or "").encode() for (p, _, h), w in zip(ODD, [None] * len(ODD)) if (p, h) not in [(2, LONG), (3, LONG), (None, LONG)])
        assert got(read_archives(spark, path)) == want(ODD)


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_loser_tree():
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_merge_of_many_runs(spark):
    ws = Workspace(spark, "test")
    rows = [(url_key(f"http://h{i % 7}.example/{i % 3}"), f"{i % 11:014}", i, "response", 1, "d", None, "f", i) for i in range(2000)]
    from thicket.llm.warc import CAPTURES

    df = spark.createDataFrame(rows, CAPTURES).repartition(6)
    merged = [(r.url_key, r.time, r.page_id) for r in capture_index(df, ws).collect()]
    assert merged == sorted(merged) and len(merged) == 2000


def test_a_column_of_times_and_odd_values(spark):
    rows = [(1, "http://a/x", "p" * 200, "12"), (2, "http://a/x", "q", None), (3, None, None, "not a time"), (4, "http://a/x", "r", "999999999999999")]
    df = spark.createDataFrame(rows, SCHEMA + ", fetched_at string")
    plain = [r[:3] for r in rows]
    assert got(archive_pages(df)) == want(plain)  # the column means nothing unless it is named
    index = archive_pages(df, time="fetched_at")
    assert got(index) == want(plain)
    assert {r.page_id: r.time for r in index.collect()} == {1: "19700101000012", 2: "20200101000002", 3: "20200101000003", 4: "20200101000004"}


def test_long_payloads_make_small_files(spark, monkeypatch):
    from thicket.llm import warc

    monkeypatch.setattr(warc, "CLASSES", (100, 1000, 10_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    rows = [(i, f"http://a/{i}", str(i % 9) * (1 + i * i % 30_000)) for i in range(300)] + [(999, "http://a/z", "z" * 90_000)]
    ws = Workspace(spark, "test")
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), ws.path("a"), ws)
    sizes = [r.length for r in spark.read.format("binaryFile").load(ws.path("a")).select("length").collect()]
    assert max(sizes) < 100_000 and sum(s > 60_000 for s in sizes) == 1
    assert got(read_archives(spark, ws.path("a"))) == want(rows)
