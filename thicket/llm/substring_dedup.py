"""Exact substring deduplication by level-wise doubling.

A window of ``width`` consecutive words goes when its word sequence also starts
anywhere else in the corpus.  Windows are not dealt out one by one: lengths
double from about ``width / 4`` up, and only what repeats at one length is
looked at in the next.

1. Level 1 counts short windows at *anchors*: in every window of ``width``
   words the short window with the smallest hash (leftmost if equal).  Equal
   windows have equal anchors, so a repeated window has a repeated anchor.
2. Level 2 counts windows of twice that length that begin or end with a
   repeated anchor.  A repeated window holds one of the two whole.
3. The last level takes, for each surviving anchor, the *span* of all windows
   of ``width`` words that chose it - about twice as long again.  If the span
   repeats, all its windows do.  Only under anchors with an unrepeated span are
   single windows counted, one copy of each repeated span standing for all.

Between levels 1, 2 and 3 a bitmap of fixed size thins the scan; it lets
through too much rather than too little, and level 3 decides exactly on 128-bit
hashes.  Occurrences are summed before every shuffle; equal texts of a task are
walked once.  A passage that many documents share meets in joins that adaptive
execution may split, never in one list.

Defined results: null or empty text: no words, nothing removed, the digest of
the empty string.  Repeated rows and repeats inside a text count as occurrences.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import Workspace, lean, passes, pick, runtime_filter, sub_batches

WIDTH = 35

_SECOND = 0xC2B2AE3D27D4EB4F  # base of the other half of 128-bit hashes


def base_width(width: int) -> int:
    """The first level's length; two doublings reach ``width``."""
    if width < 2:
        raise ValueError("a window has two words at least")
    return -(-width // 4)


def _anchors(short: np.ndarray, n_words: int, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places and, for each, the first and last window start that chose it."""
    n = n_words - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    choose = np.argmin(np.lib.stride_tricks.sliding_window_view(short[: n_words - base + 1], width - base + 1), axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], choose[1:] != choose[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    return choose[first], first, last


def _unique_texts(batches):
    """Per batch: (key, word hashes, first or second meeting) of the texts that the task meets."""
    seen: dict[bytes, int] = {}
    for b in sub_batches(batches):
        texts = b.column(0)
        raw, offsets = W.buffers(texts)
        keys = [hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest() for i in range(len(offsets) - 1)]
        starts, ends, wo = W.spans(raw, offsets)
        h = W.hashes(raw, starts, ends)
        fresh = []
        for i, k in enumerate(keys):
            # The second meeting is handed out too: two is all that matters.
            seen[k] = seen.get(k, 0) + 1
            if seen[k] <= 2 and wo[i + 1] > wo[i]:
                fresh.append((k, h[wo[i] : wo[i + 1]], seen[k]))
        yield fresh


def _counted(values: list[np.ndarray]) -> pa.RecordBatch:
    k, c = np.unique(np.concatenate(values), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.minimum(c, 2).astype(np.int64))], names=["k", "c"])


def _level(find, most: int = 1_500_000):
    """Rows (k, c) of the windows that ``find`` returns, summed over pieces of a task."""

    def run(batches):
        held, size = [], 0
        for fresh in _unique_texts(batches):
            for _, h, _ in fresh:
                found = find(h)
                if len(found):
                    held.append(found)
                    size += len(found)
            if size > most:
                yield _counted(held)
                held, size = [], 0
        if held:
            yield _counted(held)

    return run


def _first(width, base):
    def find(h):
        if len(h) < width:
            return h[:0]
        short = W.shingles(h, base)
        return short[_anchors(short, len(h), width, base)[0]]

    return find


def _doubled(h, at, base):
    """Hashes of the windows of twice the length that begin and that end with the anchors, and which exist."""
    sums = W.prefix_sums(h)
    begin, end = at + 2 * base <= len(h), at >= base
    a = W.window(sums, np.where(begin, at, 0), 2 * base) if len(h) >= 2 * base else np.zeros(len(at), np.uint64)
    b = W.window(sums, np.where(end, at - base, 0), 2 * base) if len(h) >= 2 * base else a
    return a, begin, b, end


def _second(width, base, level1):
    def find(h):
        if len(h) < width:
            return h[:0]
        short = W.shingles(h, base)
        at = _anchors(short, len(h), width, base)[0]
        at = at[passes(level1.value, short[at])]
        a, begin, b, end = _doubled(h, at, base)
        # A window that begins with one anchor and ends with another is one occurrence.
        place = np.unique(np.concatenate([at[begin], at[end] - base]))
        return W.window(W.prefix_sums(h), place, 2 * base) if len(place) else h[:0]

    return find


def _surviving(h, width, base, level1, level2):
    """Anchors that both levels leave: hash, first and last window; and the two hash sums of the text."""
    short = W.shingles(h, base)
    at, first, last = _anchors(short, len(h), width, base)
    ok = passes(level1.value, short[at])
    a, begin, b, end = _doubled(h, at, base)
    ok &= (begin & passes(level2.value, a)) | (end & passes(level2.value, b))
    sums = W.prefix_sums(h), W.prefix_sums(W.mix(h ^ np.uint64(_SECOND)))
    return short[at[ok]], first[ok], last[ok], sums


def _span_hashes(sums, first, last, width):
    length = last - first + width
    return [W.mix((total[first + length] - total[first]) * back[first] + length.astype(np.uint64)) for total, back in sums]


def _pairs(a, b):
    """One number for two hashes, to group the few of one text or batch."""
    return W.mix(a) + b * np.uint64(_SECOND)


def _runs(first, last):
    """Ranges of windows merged where they touch."""
    if not len(first):
        return first, last
    cut = np.flatnonzero(first[1:] > last[:-1] + 1)
    return first[np.concatenate([[0], cut + 1])], last[np.concatenate([cut, [len(last) - 1]])]


class _Columns:
    """Collects rows by column, with nulls given as None arrays."""

    def __init__(self, **kinds):
        self.kinds, self.parts = kinds, []

    def add(self, n, **values):
        if n:
            self.parts.append((n, values))

    def __len__(self):
        return sum(n for n, _ in self.parts)

    def batch(self):
        cols = []
        for name, kind in self.kinds.items():
            chunks = []
            for n, v in self.parts:
                x = v.get(name)
                chunks.append(pa.nulls(n, kind) if x is None else pa.array([x] * n, kind) if isinstance(x, bytes) else pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x).cast(kind))
            cols.append(pa.concat_arrays(chunks))
        self.parts = []
        return pa.RecordBatch.from_arrays(cols, names=list(self.kinds))


def _third(width, base, level1, level2):
    """Spans.  Rows with an anchor count occurrences; those with a text ask whether the span repeats; without an anchor it surely does."""

    def run(batches):
        out = _Columns(anchor=pa.int64(), s1=pa.int64(), s2=pa.int64(), text=pa.binary(), first=pa.int32(), last=pa.int32(), c=pa.int32())
        for fresh in _unique_texts(batches):
            for key, h, meeting in fresh:
                if len(h) < width:
                    continue
                anchor, first, last, sums = _surviving(h, width, base, level1, level2)
                s1, s2 = _span_hashes(sums, first, last, width)
                _, one, which, times = np.unique(_pairs(s1, s2), return_index=True, return_inverse=True, return_counts=True)
                self_repeated = times > 1
                if meeting == 2:
                    out.add(1, text=key, first=np.zeros(1, np.int32), last=np.array([len(h) - width], np.int32))
                    self_repeated[:] = True  # counted here, asked about by the first meeting
                else:
                    a, z = _runs(first[self_repeated[which]], last[self_repeated[which]])
                    out.add(len(a), text=key, first=a, last=z)
                    ask = ~self_repeated[which]
                    out.add(int(ask.sum()), anchor=anchor[ask], s1=s1[ask], s2=s2[ask], text=key, first=first[ask], last=last[ask], c=np.ones(int(ask.sum()), np.int32))
                i = one[self_repeated]
                out.add(len(i), anchor=anchor[i], s1=s1[i], s2=s2[i], c=np.minimum(times[self_repeated], 2))
            if len(out):
                yield out.batch()

    return run


def _single(width, base, level1, level2, mixed, alone):
    """Windows under mixed anchors: summed where the span repeats, one by one, with their text, where it does not."""

    def run(batches):
        out = _Columns(w1=pa.int64(), w2=pa.int64(), text=pa.binary(), first=pa.int32(), c=pa.int32())
        for fresh in _unique_texts(batches):
            held = []
            for key, h, _ in fresh:
                if len(h) < width:
                    continue
                anchor, first, last, sums = _surviving(h, width, base, level1, level2)
                ok = passes(mixed.value, anchor)
                first, last = first[ok], last[ok]
                if not len(first):
                    continue
                asks = passes(alone.value, _span_hashes(sums, first, last, width)[0])
                n = last - first + 1
                start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                asks = np.repeat(asks, n)
                w1, w2 = (W.window(x, start, width) for x in sums)
                out.add(int(asks.sum()), w1=w1[asks], w2=w2[asks], text=key, first=start[asks], c=np.ones(int(asks.sum()), np.int32))
                held.append((w1[~asks], w2[~asks]))
            if held:
                w1, w2 = (np.concatenate(x) for x in zip(*held))
                _, one, times = np.unique(_pairs(w1, w2), return_index=True, return_counts=True)
                out.add(len(one), w1=w1[one], w2=w2[one], c=np.minimum(times, 2))
            if len(out):
                yield out.batch()

    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(text)`` -> ``(key, spans)``: the md5 of each text with repeated windows, and the word ranges they cover."""
    ws = Workspace(docs.sparkSession, "substring")
    base = base_width(width)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    repeats = lambda find: texts.mapInArrow(lean(_level(find)), "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).where("c > 1").select("k")
    level1 = runtime_filter(repeats(_first(width, base)))
    level2 = runtime_filter(repeats(_second(width, base, level1)))
    ws.release()
    rows = ws.save(texts.mapInArrow(lean(_third(width, base, level1, level2)), "anchor long, s1 long, s2 long, text binary, first int, last int, c int"), "anchors")
    count = ws.save(rows.where("anchor is not null").groupBy("s1", "s2", "anchor").agg(F.sum("c").alias("times")), "spans")
    sure = rows.where("anchor is null").select("text", "first", "last")
    whole = rows.where("anchor is not null and text is not null").join(count.where("times > 1").select("s1", "s2"), ["s1", "s2"], "left_semi").select("text", "first", "last")
    # Anchors under which some span is not repeated while the anchor is: their windows are counted singly.
    # Written first: the join then meets plain exchanges, and an anchor with many spans can be split.
    mixed = ws.save(count.groupBy("anchor").agg(F.min("times").alias("least"), F.sum("times").alias("all")).where("least = 1 and all > 1").select("anchor"), "mixed")
    alone = count.where("times = 1").join(mixed, "anchor", "left_semi").select("anchor", "s1")
    alone = ws.save(alone, "alone")
    single = texts.mapInArrow(lean(_single(width, base, level1, level2, runtime_filter(alone.select(F.col("anchor").alias("k"))), runtime_filter(alone.select(F.col("s1").alias("k"))))), "w1 long, w2 long, text binary, first int, c int")
    single = ws.save(single, "single")
    ws.release()
    seen = single.groupBy("w1", "w2").agg(F.sum("c").alias("times")).where("times > 1").select("w1", "w2")
    part = single.where("text is not null").join(seen, ["w1", "w2"], "left_semi").select("text", "first", F.col("first").alias("last"))
    spans = sure.union(whole).union(part).groupBy("text").agg(F.collect_set(F.struct(F.col("first"), (F.col("last") + width).alias("end"))).alias("spans"))
    out = ws.save(spans.select(F.col("text").alias("key"), "spans"), "found")
    ws.drop("anchors", "spans", "mixed", "alone", "single")
    return out


def with_spans(docs: DataFrame, width: int = WIDTH, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs and ``spans`` (null where nothing repeats)."""
    found = repeated_spans(docs, width)
    names = columns or docs.columns
    left = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("key"))
    return left.join(found, "key", "left").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "spans")


def _masked(texts, spans):
    """Words of each text and the mask of removed ones."""
    values = spans.values
    first, end = (values.field(i).to_numpy() for i in (0, 1)) if len(values) else (np.zeros(0, np.int32),) * 2
    offsets = spans.offsets.to_numpy() - spans.offsets[0].as_py() if len(spans) else np.zeros(1, np.int64)
    base = spans.offsets[0].as_py() if len(spans) else 0
    first, end = first[base:], end[base:]
    for i in range(len(texts)):
        raw = texts[i].as_py()
        words = raw.encode().split() if raw else []
        a, b = offsets[i], offsets[i + 1]
        if a == b:
            yield words, None
            continue
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first[a:b], 1)
        np.add.at(edge, end[a:b], -1)
        yield words, np.cumsum(edge[:-1]) > 0


def _digest(batches):
    for b in sub_batches(batches):
        n, gone, sha = [], [], []
        for words, mask in _masked(b.column(1), b.column(2)):
            n.append(len(words))
            gone.append(0 if mask is None else int(mask.sum()))
            kept = words if mask is None else [words[j] for j in np.flatnonzero(~mask)]
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_spans(docs, width).mapInArrow(lean(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(at: int, names: list[str]):
    def run(batches):
        for b in sub_batches(batches):
            texts, out = b.column(at), []
            for i, (words, mask) in enumerate(_masked(texts, b.column(b.num_columns - 1))):
                out.append(texts[i].as_py() if mask is None else b" ".join(words[j] for j in np.flatnonzero(~mask)).decode())
            cols = [pa.array(out, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with repeated windows cut out of ``text``; untouched texts stay as they are, all columns are kept."""
    at = docs.columns.index("text")
    plain = docs.withColumn("text", F.col("text").cast("string"))
    spread = with_spans(plain, width)
    return spread.toDF(*[f"c{i}" for i in range(len(spread.columns))]).mapInArrow(lean(_cut(at, plain.columns)), plain.schema)
