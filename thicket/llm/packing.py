"""Packing documents into training sequences by vector bin packing.

A sequence has simultaneous limits: tokens, segments (pieces of examples) and
loss-bearing tokens.  Bins are filled one at a time: of the items at hand that
fit in every dimension, the one with the greatest dot product of its demand and
the bin's free room, both relative to the limits, goes next.

Examples longer than a sequence are cut into whole sequences and a rest.  Items
wait in a bounded buffer; a bin that nothing at hand fits is topped up with a
piece cut from the smallest item at hand, so it ends full unless its segments or
loss tokens are used up.  What such a bin holds, and the rest of a task that
fills no sequence, is cut into lengths that are powers of two, which need no
padding; only a bin that lacks less than ``1 / SLACK`` of its tokens is padded.

Packing is a map over the scan: every task packs its own rows, nothing is
shuffled, and memory is bounded by the buffer.  Sequence ids hold the task's
number above and a running number below; they are unique, not consecutive.

Defined results: a null text is an empty one; its document is the end token
alone.  Repeated rows are packed each.  Of items with equal dot products the one
that stands first in the buffer goes next, so which sequence holds a document
depends on the order of rows in a task; every token lies in exactly one piece
whatever the order.  A null list of loss spans means that all tokens bear loss;
spans beyond the document's end are cut.  An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import lean, prepare, sub_batches
from .tokens import BATCH_BYTES, document_ids, vocabulary_path

LIMIT = 2048
END = 1
SEGMENTS = 64
#: Items that wait at most.
BUFFER = 1024
#: A sequence whose segments or loss tokens are used up is padded only if it lacks less than this part.
SLACK = 128


class Packer:
    """Fills sequences from items (payload, tokens, loss tokens); hands out (payload, start, length, sequence, offset).

    ``start`` counts from the item's own first token.
    """

    def __init__(self, tokens: int = LIMIT, segments: int = SEGMENTS, loss: int | None = None, buffer: int = BUFFER):
        self.limits = np.array([tokens, segments, loss or tokens], float)
        self.tokens, self.segments, self.loss, self.buffer = tokens, segments, loss or tokens, buffer
        # Tokens and loss tokens of the waiting items, in the first len(items) places.
        self.size = np.zeros(2 * buffer + 64, np.int64)
        self.need = np.zeros(2 * buffer + 64, np.int64)
        self.items: list[tuple[object, int, np.ndarray | None]] = []
        self.sequence = 0

    def add(self, payload, n_tokens: int, bears_loss: np.ndarray | None = None):
        """bears_loss: which tokens bear loss; None means all."""
        at = 0
        while n_tokens - at >= self.tokens and (bears_loss is None or bears_loss[at : at + self.tokens].sum() <= self.loss) and self.loss >= (self.tokens if bears_loss is None else 0):
            yield payload, at, self.tokens, self.sequence, 0
            self.sequence += 1
            at += self.tokens
        while at < n_tokens:
            to = self._reach(bears_loss, at, min(n_tokens, at + self.tokens), self.loss)
            self._wait((payload, at, bears_loss), to - at)
            at = to
        while len(self.items) > self.buffer:
            yield from self._fill(False)

    def end(self):
        while self.items:
            yield from self._fill(True)

    def _reach(self, mask, at, to, room):
        """The furthest end of a piece from ``at`` whose loss tokens fit in ``room``."""
        if mask is None:
            return min(to, at + room)
        over = np.cumsum(mask[at:to]) > room
        return at + int(over.argmax()) if over.any() else to

    def _wait(self, item, n):
        payload, at, mask = item
        k = len(self.items)
        if k == len(self.size):  # one long example may wait in many pieces
            self.size, self.need = (np.concatenate([x, np.zeros(k, np.int64)]) for x in (self.size, self.need))
        self.items.append((payload, at, mask))
        self.size[k], self.need[k] = n, n if mask is None else int(mask[at : at + n].sum())

    def _take(self, i):
        item, n = self.items[i], int(self.size[i])
        last = len(self.items) - 1
        self.items[i] = self.items[last]
        self.size[i], self.need[i] = self.size[last], self.need[last]
        self.items.pop()
        return item, n

    def _fill(self, ending):
        room, segments, loss, placed = self.tokens, self.segments, self.loss, []
        while room and segments and self.items:
            size, need = self.size[: len(self.items)], self.need[: len(self.items)]
            fits = (size <= room) & (need <= loss)
            score = (size * (room / self.tokens**2) + segments / self.segments**2 + need * (loss / self.loss**2)) * fits
            i = int(np.argmax(score))
            if fits[i]:
                item, n = self._take(i)
            else:
                i = int(np.argmin(size))
                payload, at, mask = self.items[i]
                to = self._reach(mask, at, at + min(room, int(self.size[i])), loss)
                if to == at:
                    break
                item, whole = self._take(i)
                n = to - at
                if whole > n:
                    self._wait((payload, to, mask), whole - n)
            placed.append((item, n))
            room, segments = room - n, segments - 1
            loss -= n if item[2] is None else int(item[2][item[1] : item[1] + n].sum())
        if room * SLACK > self.tokens or (room and ending and not self.items):
            yield from self._powers(placed, self.tokens - room)
            return
        offset = 0
        for (payload, at, _), n in placed:
            yield payload, at, n, self.sequence, offset
            offset += n
        self.sequence += 1

    def _powers(self, placed, total):
        """The last tokens of a task in sequences whose lengths are powers of two."""
        room, offset = 1 << (total.bit_length() - 1), 0
        for (payload, at, _), n in placed:
            while n:
                k = min(n, room - offset)
                yield payload, at, k, self.sequence, offset
                at, n, offset, total = at + k, n - k, offset + k, total - k
                if offset == room:
                    self.sequence += 1
                    room, offset = (1 << (total.bit_length() - 1)) if total else 0, 0


def _mask(spans, n: int) -> np.ndarray | None:
    """Which of n tokens lie in the spans."""
    if spans is None:
        return None
    out = np.zeros(n, bool)
    for s in spans:
        if s is not None and s["first"] is not None and s["end"] is not None:
            out[max(0, s["first"]) : max(0, s["end"])] = True
    return out


def _pack(path, end, limit, segments, loss, with_loss):
    names = [f.name for f in SCHEMA.fields] + ["loss_tokens"] * with_loss

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        packer, rows = Packer(limit, segments, loss), []

        def emit(found):
            for (doc, before, ids, n, mask), start, length, sequence, offset in found:
                row = (doc, before + start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, base + sequence, offset)
                rows.append((*row, length if mask is None else int(mask[start : start + length].sum())) if with_loss else row)

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return out

        for b in sub_batches(batches, BATCH_BYTES):
            spans = b.column(2).to_pylist() if with_loss else [None] * b.num_rows
            for doc, ids, own in zip(b.column(0).to_pylist(), document_ids(b.column(1).to_pylist(), path, end), spans):
                n = len(ids) // 4
                mask = _mask(own, n)
                # What waits holds its own tokens only, never the whole document.
                for at in range(0, n, limit):
                    part = ids[4 * at : 4 * (at + limit)]
                    flags = None if mask is None else mask[at : at + limit]
                    emit(packer.add((doc, at, part, n, flags), len(part) // 4, flags))
                if len(rows) > ROWS:
                    yield batch()
            if rows:
                yield batch()
        emit(packer.end())
        if rows:
            yield batch()

    return run


#: Rows of an output batch, about.
ROWS = 10_000
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, segments: int = SEGMENTS, end: int = END, loss: int | None = None, loss_spans: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``loss_spans`` names a column of token ranges, ``array<struct<first, end>>``:
    the tokens that bear loss (end exclusive; null: all).  A sequence holds at
    most ``loss`` of them, and pieces tell theirs in ``loss_tokens``.  Without
    that column all tokens bear loss, so the third limit is the first.
    """
    prepare(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    schema = SCHEMA
    if loss_spans:
        cols.append(F.col(f"`{loss_spans}`").cast("array<struct<first: long, end: long>>").alias("spans"))
        schema = T.StructType([*SCHEMA.fields, T.StructField("loss_tokens", T.LongType())])
    return docs.select(*cols).mapInArrow(lean(_pack(path or vocabulary_path(), end, limit, segments, loss, bool(loss_spans)), True), schema)
