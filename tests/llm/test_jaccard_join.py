import random

import pyarrow.parquet as pq

from thicket.llm.jaccard_join import jaccard_classes

from .brute import jaccard

SCHEMA = "doc_id long, text string"


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert got(jaccard_classes(spark.read.parquet(path))) == jaccard(rows)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_hot_group_short_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, edited(rng, base, rng.randrange(0, 7))) for i in range(400)]
    rows += [(1000 + i, "one two three four five six seven" + " x" * (i % 3)) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "a b"), (2004, "A  B"), (2005, "a b c"), (None, "a b"), (None, None), (7, rows[7][1])]
    rows += [(3000, " ".join(f"z{i}" for i in range(30000)))]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], SCHEMA + ", n string").repartition(5)
    assert got(jaccard_classes(df)) == jaccard(rows)


def test_empty(spark):
    assert got(jaccard_classes(spark.createDataFrame([], SCHEMA))) == []
