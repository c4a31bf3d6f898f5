import re

import pyarrow.parquet as pq

from thicket.llm.quality_rules import COUNTS, QualityModel, judge

from .brute import WORD

SCHEMA = "doc_id long, text string"


def base(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count = {}
    for i in range(len(w) - 4):
        count[tuple(w[i : i + 5])] = count.get(tuple(w[i : i + 5]), 0) + 1
    hit = set()
    for i in range(len(w) - 4):
        if count[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


ODD = [(1, None), (2, ""), (3, " \n\n"), (4, "é ü\nx\n\nx\n x\nx"), (5, "a b c d e " * 30), (None, "## ** $$ | <a> & %" + " word" * 12), (6, "la la la la la la\nla la la"), (6, "tail\r\ntail\r\ntail\r"), (9, "y" * 70000 + " z" * 50000)]


def test_counts_match(spark):
    rows = ODD + [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = sorted(((r["doc_id"], *(r[c] for c in COUNTS), r["base_failed"]) for r in judge(spark.createDataFrame(rows, SCHEMA), None).collect()), key=str)
    assert got == sorted(((d, *base(t)) for d, t in rows), key=str)


def test_verdicts_against_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = judge(docs, labels).join(labels, "doc_id").select("quality", "toxic", "kept", "base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) >= 0.995 * len(clean) and sum(junk) <= 0.06 * len(junk)


def test_kept_rows_and_columns(spark):
    docs = spark.createDataFrame([(i, f"number {i} " + "clear plain words about ten different things in each one", "s", 1.5) for i in range(20)] + [(99, "| # | %% ## && |" * 9, None, None)], "doc_id long, text string, score string, kept double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15)] + [(99, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = QualityModel(docs, labels)
    out = model.kept(docs)
    assert out.schema == docs.schema
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(20))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert judge(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_scores_threshold_and_verdict(spark):
    """Counts, ratios, scores, threshold and verdict anew, a document at a time."""
    import math
    from collections import Counter

    import numpy as np

    from thicket.llm import quality_rules as Q
    from thicket.llm import words as W

    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()] + ODD[:-1] + [(77001, "z" * 50_000)]
    labels = spark.read.parquet(f"{d}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}

    def half(i):
        return int(W.mix(np.array([i]).view(np.uint64))[0]) & 1

    def grams(text):
        b = (text or "").encode()
        packed = np.array([int.from_bytes(b[i : i + 4], "big") for i in range(len(b) - 3)], np.uint64)
        return Counter((W.mix(packed) & np.uint64(Q.BUCKETS - 1)).tolist())

    bags = [grams(t) for _, t in rows]
    corpus, target = Counter(), Counter()
    for (i, _), bag in zip(rows, bags):
        corpus.update(bag)
        if i in trusted and half(i):
            target.update(bag)
    n, m = sum(corpus.values()), sum(target.values())
    weight = lambda g: math.log((target[g] + 1) / (m + Q.BUCKETS)) - math.log((corpus[g] + 1) / (n + Q.BUCKETS))
    scores = [sum(k * weight(g) for g, k in bag.items()) / (sum(bag.values()) + Q.PRIOR_GRAMS) for bag in bags]
    held_out = [s for (i, _), s in zip(rows, scores) if i in trusted and not half(i)]
    assert m and len(held_out) > 5
    threshold = float(np.quantile(held_out, Q.QUANTILE)) - Q.MARGIN
    got = sorted(judge(spark.createDataFrame(rows, SCHEMA).repartition(3), labels).collect(), key=lambda r: (str(r.doc_id), r.n_words, r.word_chars, r.score))
    want = sorted(((i, *base(t), s) for (i, t), s in zip(rows, scores)), key=lambda x: (str(x[0]), x[1], x[2], x[-1]))
    for r, (i, words, *_, failed, s) in zip(got, want, strict=True):
        assert (r.doc_id, r.n_words, r.base_failed) == (i, words, failed) and abs(r.score - s) < 1e-8
        assert r.kept == (not failed and s >= threshold) or abs(s - threshold) < 1e-8


def test_a_score_does_not_depend_on_its_neighbours():
    import numpy as np
    import pyarrow as pa

    from thicket.llm import quality_rules as Q

    weights = np.random.default_rng(3).normal(size=Q.BUCKETS)
    texts = ["", "abc", "abcd", None, "some words of a text " * 50, "é" * 9, "x" * 5000]
    alone = [Q.scores(pa.array([t], pa.string()), weights)[0] for t in texts]
    assert Q.scores(pa.array(texts, pa.string()), weights).tolist() == alone
