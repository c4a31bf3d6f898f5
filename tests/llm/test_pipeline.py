import importlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from thicket.llm.quality_rules import judge
from thicket.llm.tokens import vocabulary_path

from .brute import WORD, jaccard
from .test_tokens import check_pieces

pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(rows, width=35):
    docs = [(d, t, WORD.findall(t or "")) for d, t in rows]
    count = Counter(tuple(w[i : i + width]) for _, _, w in docs for i in range(len(w) - width + 1))
    out = {}
    for d, t, w in docs:
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id for r in judge(docs, spark.read.parquet(f"{D}/labels.parquet")).where("kept").select("doc_id").collect()}
    one = pipeline.quality_rules(spark, docs, D)
    assert one.columns == COLUMNS and {r.doc_id for r in one.select("doc_id").collect()} == kept
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    alone = {c for _, _, c in jaccard(rows)}
    two = pipeline.jaccard_join(spark, one, D)
    assert two.columns == COLUMNS and sorted(r.doc_id for r in two.select("doc_id").collect()) == sorted(alone)
    want = cut([r for r in rows if r[0] in alone])
    three = pipeline.substring_dedup(spark, two, D)
    got = {r.doc_id: r for r in three.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())
    four = pipeline.mixing(spark, three, D)
    times = Counter(r.doc_id for r in four.collect())
    assert set(times) == alone and max(times.values()) <= 2
    library = Tokenizer.from_file(vocabulary_path())
    texts = [(d, library.encode(want[d] or "", add_special_tokens=False).ids + [1]) for d in times.elements()]
    padding, total = check_pieces(pipeline.packing(spark, four, D).collect(), texts)
    assert padding < 0.01 * total
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    final = pipeline.run(spark, D).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in final if r.start == 0) == Counter((d, len(ids)) for d, ids in texts)


def test_keep_one_odd_rows(spark):
    from thicket.llm.jaccard_join import keep_one

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (None, "q r s", "d"), (None, "Q r  s", "e"), (9, None, "f"), (9, None, "f"), (10, "", "g"), (2, "other words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    out = keep_one(df)
    assert out.columns == df.columns
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert sum(r[1] is not None and r[1].lower().split() == ["q", "r", "s"] for r in got) == 1
    assert [r for r in got if r[0] is not None] == sorted([(2, text, "b"), (9, None, "f"), (9, None, "f"), (10, "", "g"), (2, "other words", "h")], key=str)


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    assert {"pipeline", "op1_jaccard_join", "op10_chat_quotes"} <= set(entry.queries())
