import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from thicket.llm.packing import Packer, pack_documents
from thicket.llm.tokens import document_ids, token_counts, vocabulary_path

SCHEMA = "doc_id long, text string, n_tokens string"
ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\t\n c "), (5, "x   y 　 z\u0085 q"), (6, "don't<|endoftext|>we'll  <|endoftext|> 's"), (7, "a\x1cb \x1d\x1e c"), (8, "中文 字符 。 テスト"), (9, "!!! ???...12 345"), (None, "no id"), (4, "again again"), (10, "é   ​ x\r\n\r\ny"), (11, "word " * 30000), (12, "x" * 9000)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def rows_of_table():
    return [(r["doc_id"], r["text"]) for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def test_counts(spark, library):
    rows = ODD + rows_of_table()
    got = sorted((tuple(r) for r in token_counts(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()), key=str)
    want = []
    for d, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((d, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_counts_empty(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_space_ids(library):
    rng = random.Random(1)
    alphabet = "ab1'.,! \t\n  　\x1c\x1f\u0085é<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    for t, ids in zip(texts, document_ids(texts, vocabulary_path(), None)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def check_pieces(pieces, docs, limit=2048):
    """docs: list of (doc_id, ids); repeated ids may be the same document twice."""
    rows = defaultdict(list)
    for p in pieces:
        rows[p.doc_id].append(p)
    want = defaultdict(list)
    for d, ids in docs:
        want[d].append(ids)
    assert set(rows) == set(want)
    for d, copies in want.items():
        seen = defaultdict(int)
        for p in rows[d]:
            ids = next(i for i in copies if len(i) == p.doc_tokens and zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32)
            assert p.length > 0
            for k in range(p.start, p.start + p.length):
                seen[len(ids), k] += 1
        for n in {len(i) for i in copies}:
            assert [seen[n, k] for k in range(n)] == [sum(len(i) == n for i in copies)] * n
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding, sum(p.length for p in pieces)


def test_packing(spark, library):
    rows = ODD[:-1] + rows_of_table()
    docs = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    pieces = pack_documents(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)).collect()
    padding, total = check_pieces(pieces, docs)
    assert padding <= 0.01 * total


def test_packing_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_limits_in_all_dimensions():
    rng = np.random.default_rng(2)
    packer, out, sizes = Packer(tokens=256, segments=5, loss=150, buffer=40), [], {}
    for i in range(600):
        mask = rng.random(rng.integers(1, 700)) < rng.random()
        sizes[i] = mask
        out += packer.add(i, len(mask), mask)
    out += packer.end()
    used, covered = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for i, start, length, sequence, offset in out:
        assert used[sequence][0] == offset
        used[sequence][0] += length
        used[sequence][1] += 1
        used[sequence][2] += int(sizes[i][start : start + length].sum())
        covered[i] += range(start, start + length)
    assert all(t <= 256 and s <= 5 and k <= 150 for t, s, k in used.values())
    assert all(sorted(covered[i]) == list(range(len(m))) for i, m in sizes.items())


@pytest.mark.parametrize("words", [0, 1, 3, 30])
def test_short_texts_are_packed_without_padding(spark, library, words):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(words))) for i in range(1500)]
    docs = [(d, library.encode(t, add_special_tokens=False).ids + [1]) for d, t in rows]
    padding, total = check_pieces(pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect(), docs)
    assert padding < 0.01 * total


def test_loss_limit_through_the_operator(spark, library):
    rows = [(i, "ask me " * (i % 40 + 1) + "answer " * (i % 7 + 1)) for i in range(300)] + [(900, None), (901, "long " * 5000)]
    n = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    spans = {d: None if d % 10 == 0 else [(max(0, n[d] - 5), n[d] + 3)] for d, _ in rows}
    df = spark.createDataFrame([(d, t, spans[d]) for d, t in rows], "doc_id long, text string, answers array<struct<first: long, end: long>>")
    out = pack_documents(df.repartition(2), limit=256, segments=6, loss=40, loss_spans="answers").collect()
    per, covered = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for r in out:
        own = range(r.start, r.start + r.length)
        assert r.loss_tokens == sum(spans[r.doc_id] is None or k >= spans[r.doc_id][0][0] for k in own)
        per[r.sequence_id] = [a + b for a, b in zip(per[r.sequence_id], (r.length, 1, r.loss_tokens))]
        covered[r.doc_id] += own
    assert all(t <= 256 and s <= 6 and k <= 40 for t, s, k in per.values())
    assert all(sorted(covered[d]) == list(range(n[d])) for d in n)


def test_the_table_is_bounded_by_bytes(monkeypatch):
    from thicket.llm import tokens

    monkeypatch.setattr(tokens, "TABLE_BYTES", 20_000)
    table = tokens.Table(vocabulary_path(), len)
    for i in range(3000):
        assert table[f" piece{i}"] == len(table.encode(f" piece{i}", add_special_tokens=False).ids)
    assert table["y" * 100_000] > 0 and "y" * 100_000 not in table
    assert len(table) + len(table.old) < 3000
