"""Token counts and token ids of whole texts, in Arrow batches.

Long texts are split at safe boundaries: between a character that is not white
space and a white-space character.  The tokenizer's own pre-tokenization always
breaks there, and its special strings hold no white space, so ids of the pieces
side by side are the ids of the text.  Pieces repeat, so each worker encodes a
piece once and keeps a table bounded by bytes; batches are cut by bytes, not by
rows.

Defined results: null text is the empty text: no tokens.  Rows are never
merged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from sys import getsizeof

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import KEPT, lean, prepare, sub_batches

VOCABULARY = "byte_bpe_50k.json"
#: Bytes, with Python's own, of one generation of a worker's table; and of the longest piece that it keeps.
TABLE_BYTES, LONGEST = 40 << 20, 256
#: Bytes of a dictionary's place for an entry, at most.
PLACE_BYTES = 110
#: Bytes of text handled at a time.
BATCH_BYTES = 1 << 22
OVER = 512

#: White space as the tokenizer's pattern has it: Python's, without the four separators U+001C to U+001F.
_SPACE, _INK = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
PIECE = re.compile(f"{_SPACE}*{_INK}+|{_SPACE}+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[str, object] = {}
KEPT.append(_LOADED)


def tokenizer(path: str):
    """One tokenizer per worker and file; stages that use none let go of it, some 50 MB, and it loads in 0.2 s."""
    if path not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_padding()
        found.no_truncation()
        _LOADED[path] = found
    return _LOADED[path]


def _byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def ranked(path: str):
    """The same vocabulary in a library that is faster on single words, or None where its merges are not in order of ids.

    It is used for pieces without special strings only.
    """
    key = path + "#ranks"
    if key not in _LOADED:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
        of, vocabulary = _byte_characters(), {}
        pre = spec["pre_tokenizer"] or {}
        ok = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["normalizer"]
        if ok:
            vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
            merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
            ok = merged == sorted(merged)
        _LOADED[key] = (tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(of[c] for c in t): i for t, i in vocabulary.items()}, special_tokens={}), special) if ok else None
    return _LOADED[key]


class Table(dict):
    """piece -> value, learnt on first use, in two generations: a full table becomes the old one, and what is still used moves over.

    A generation is full at ``TABLE_BYTES``, whatever the pieces; one piece of a
    text without white space may be very long, and such are never kept.
    """

    def __init__(self, path: str, value):
        super().__init__()
        self.value, self.old, self.encode, self.bytes = value, {}, tokenizer(path).encode, 0
        fast = ranked(path)
        self.one, self.special = (fast[0].encode_ordinary, fast[1]) if fast else (None, ())

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self._learn(piece)
        if len(piece) <= LONGEST:
            if self.bytes >= TABLE_BYTES:
                self.old, self.bytes = dict(self), 0
                self.clear()
            self.bytes += getsizeof(piece) + getsizeof(found) + PLACE_BYTES
            self[piece] = found
        return found

    def _learn(self, piece: str):
        if self.one is None or ("<" in piece and any(s in piece for s in self.special)):
            return self.value(self.encode(piece, add_special_tokens=False).ids)
        if piece[-1] in MARKS and piece[-2:-1].isalpha():  # such a mark is a token of its own
            return self[piece[:-1]] + self.value(self.one(piece[-1]))
        return self.value(self.one(piece))


MARKS = frozenset(".,;:!?")

_TABLES: dict[tuple[str, str], Table] = {}
KEPT.append(_TABLES)


def table(path: str, kind: str) -> Table:
    """The worker's table of counts or of ids (little-endian unsigned 32-bit)."""
    if (path, kind) not in _TABLES:
        _TABLES[path, kind] = Table(path, len if kind == "count" else lambda ids: array("I", ids).tobytes())
    return _TABLES[path, kind]


def pieces(text: str | None) -> list[str]:
    return PIECE.findall(text) if text else []


def _counts(path: str, over: int):
    def run(batches):
        known = table(path, "count")
        for b in sub_batches(batches, BATCH_BYTES):
            cut = [pieces(t) for t in b.column(1).to_pylist()]
            n = [sum(map(known.__getitem__, c)) for c in cut]
            size = pa.compute.fill_null(pa.compute.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > over for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str | None = None, over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; a map over the scan, no shuffle."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lean(_counts(path or vocabulary_path(), over), True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def document_ids(texts: list[str | None], path: str, end: int | None) -> list[bytes]:
    """The ids of each text as bytes, then ``end``."""
    get = table(path, "ids").__getitem__
    tail = b"" if end is None else array("I", [end]).tobytes()
    return [b"".join(map(get, pieces(t))) + tail for t in texts]
