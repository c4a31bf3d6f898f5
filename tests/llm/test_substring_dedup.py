import random

import pyarrow.parquet as pq

from thicket.llm.substring_dedup import dedup, dedup_digest

from .brute import substrings

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert got(dedup_digest(spark.read.parquet(path))) == substrings(rows)


def odd_rows():
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(150):
        own = [f"{rng.choice('abc')}{rng.randrange(40)}" for _ in range(rng.randrange(1, 90))]
        cut = rng.randrange(0, 30), rng.randrange(30, 61)
        rows.append((i, " ".join(own + passage[cut[0] : cut[1]] + own[: rng.randrange(0, 40)])))
    rows += [(900, "so " * 300), (901, "la di da " * 40), (902, "la di da " * 12), (903, None), (904, ""), (905, " \n"), (906, "ä\tö  ü"), (907, "one"), (7, rows[7][1]), (None, rows[8][1])]
    rows += [(950, " ".join(f"z{i % 20000}" for i in range(40100)))]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    assert got(dedup_digest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == substrings(rows)


def test_widths(spark):
    rows = odd_rows()[:80]
    for width in (2, 3, 7):
        assert got(dedup_digest(spark.createDataFrame(rows, SCHEMA).repartition(3), width)) == substrings(rows, width)


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "keep  me", "x", 1), (2, " ".join(f"w{i}" for i in range(40)), "y", 2), (3, " ".join(f"w{i}" for i in range(40)), None, 3)], "doc_id long, text string, key string, spans int")
    plain = dedup(df)
    out = {r["doc_id"]: r for r in plain.collect()}
    assert plain.columns == ["doc_id", "text", "key", "spans"]
    assert out[1]["text"] == "keep  me" and out[2]["text"] == "" and out[3]["key"] is None and out[3]["spans"] == 3


def test_empty(spark):
    assert got(dedup_digest(spark.createDataFrame([], SCHEMA))) == []
