"""Quality rules: counting rules, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams of bytes: one of trusted documents, one of
the whole corpus.  A document's score is the sum over its n-grams of
``log p_trusted - log p_corpus``, divided by their number plus a constant that
draws very short texts to zero.  It is kept when the score reaches a threshold:
a fixed low quantile of the scores of trusted documents that the model has not
seen, less a margin; a score equal to it is kept.  Half of the trusted documents, by hash of their id, fit
the model, the other half sets the threshold.  Everything is deterministic.

Corpus counts cover every byte of every document; tasks send one row for each
bucket they met.  All labelled documents (quality 1, not toxic) fit the model or
set the threshold.  Their ids are joined: sent whole up to ``SENT`` of them, merged
beyond.  Weights are a broadcast array of ``BUCKETS`` numbers.

Defined results: null and empty texts have no words and fail the base rules.
Without trusted documents the score is 0 and the base rules decide.  Rows with
a null doc_id are judged like others but are never trusted.  Repeated rows are
judged each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import lean, prepare, sub_batches

GRAM = 4
BUCKETS = 1 << 18
#: Trusted ids that are sent to every task; more are joined by merging.
SENT = 1_000_000
PRIOR_GRAMS = 32
QUANTILE = 0.001
MARGIN = 0.02
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 10, 20, 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INLINE_SPACE = " \t\x0b\x0c\r"


def _grams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    packed = np.zeros(n, np.uint64)
    for k in range(GRAM):
        packed = (packed << np.uint64(8)) | raw[k : k + n]
    return (W.mix(packed) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _ranges(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 n-gram of each text."""
    return offsets[:-1], np.maximum(offsets[1:] - GRAM + 1, offsets[:-1])


def _per_text(raw, offsets, most=1 << 20):
    """Pieces of a batch of about ``most`` bytes: (first row, buckets, offsets of its texts)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most)) - 1)
        yield at, to, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _count():
    def run(batches):
        corpus, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in sub_batches(batches):
            raw, offsets = W.buffers(b.column(1))
            good = _fits(b.column(0)) & b.column(2).is_valid().to_numpy(zero_copy_only=False)
            for at, to, part, offs in _per_text(raw, offsets):
                g = _grams(part)
                own = np.ones(len(g), bool)  # n-grams that cross from one text to the next are none
                for k in range(1, GRAM):
                    own[offs[(offs >= k) & (offs - k < len(g))] - k] = False
                corpus += np.bincount(g[own], minlength=BUCKETS)
                lo, hi = _ranges(offs)
                for i in np.flatnonzero(good[at:to]):
                    target += np.bincount(g[lo[i] : hi[i]], minlength=BUCKETS) if hi[i] - lo[i] > BUCKETS else _sparse(g[lo[i] : hi[i]])
        met = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(corpus[met]), pa.array(target[met])], names=["bucket", "corpus", "target"])

    return run


def _sparse(g):
    out = np.zeros(BUCKETS, np.int64)
    np.add.at(out, g, 1)
    return out


def _fits(column: pa.Array) -> np.ndarray:
    """Rows whose id is of the half that fits the model; the other half sets the threshold."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (W.mix(ids.view(np.uint64)) & np.uint64(1)).astype(bool)


def scores(texts: pa.Array, weights: np.ndarray | None) -> np.ndarray:
    raw, offsets = W.buffers(texts)
    out = np.zeros(len(offsets) - 1)
    if weights is None:
        return out
    for at, to, part, offs in _per_text(raw, offsets):
        lo, hi = _ranges(offs)
        some = np.flatnonzero(hi > lo)
        if len(some):  # each text is summed alone, so its score does not depend on its neighbours
            each = np.append(weights[_grams(part)], 0.0)
            total = np.add.reduceat(each, np.stack([lo[some], hi[some]], axis=1).ravel())[::2]
            out[at + some] = total / (hi[some] - lo[some] + PRIOR_GRAMS)
    return np.round(out, 9)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counting rules' numbers of each text."""
    raw, offsets = W.buffers(texts)
    starts, ends, wo = W.spans(raw, offsets)
    n = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    chars = total(~W.SEPARATOR[raw] & ((raw & 0xC0) != 0x80))
    out = {"n_words": np.diff(wo), "word_chars": chars, "n_symbols": total(_SYMBOL[raw]), "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64)}
    h = W.hashes(raw, starts, ends)
    s = W.shingles(h, WINDOW)
    for i in range(n):
        a, b = wo[i], wo[i + 1]
        if a == b:
            continue
        lines = [x for x in texts[i].as_py().split("\n") if x.strip(_INLINE_SPACE)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if b - a > WINDOW:
            own = s[a : b - WINDOW + 1]
            kinds, which, times = np.unique(own, return_inverse=True, return_counts=True)
            if len(kinds) < len(own):
                edge = np.zeros(b - a + 1, np.int64)
                at = np.flatnonzero(times[which] > 1)
                edge[at] += 1
                np.add.at(edge, at + WINDOW, -1)
                out["n_repeat_words"][i] = (np.cumsum(edge[:-1]) > 0).sum()
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


class QualityModel:
    """Broadcast weights and the threshold that come from one pass over the corpus."""

    def __init__(self, docs: DataFrame, labels: DataFrame | None, sent: int = SENT):
        spark = docs.sparkSession
        prepare(spark)
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        trusted, marked = None, plain.withColumn("trusted", F.lit(None).cast("boolean"))
        if labels is not None:
            trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(True))
            trusted = F.broadcast(trusted) if trusted.count() <= sent else trusted.hint("merge")
            marked = plain.join(trusted, "doc_id", "left")
        counts = marked.mapInArrow(lean(_count()), "bucket int, corpus long, target long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")).toArrow()
        corpus, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        corpus[counts.column("bucket").to_numpy()] = counts.column("corpus").to_numpy()
        target[counts.column("bucket").to_numpy()] = counts.column("target").to_numpy()
        self.threshold = -np.inf
        self.weights = spark.sparkContext.broadcast(None)
        if target.sum():
            ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((corpus + 1) / (corpus.sum() + BUCKETS))
            self.weights = weights = spark.sparkContext.broadcast(ratio)

            def own(batches):
                for b in sub_batches(batches):
                    ok = ~_fits(b.column(0))
                    yield pa.RecordBatch.from_arrays([pa.array(scores(b.column(1).filter(pa.array(ok)), weights.value))], names=["score"])

            low = plain.join(trusted, "doc_id").select("doc_id", "text").mapInArrow(lean(own), "score double").agg(F.percentile("score", F.lit(QUANTILE))).first()[0]
            self.threshold = -np.inf if low is None else low - MARGIN

    def judged(self, docs: DataFrame) -> DataFrame:
        """doc_id, the counts, score, base_failed and kept of every row."""
        weights, threshold = self.weights, self.threshold

        def run(batches):
            for b in sub_batches(batches):
                c, score = base_counts(b.column(1)), scores(b.column(1), weights.value)
                failed = base_failed(c)
                cols = [b.column(0), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *COUNTS, "score", "base_failed", "kept"])

        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return plain.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double, base_failed boolean, kept boolean")

    def labelled(self, rows: DataFrame, text: str) -> DataFrame:
        """rows without the text column and with ``bad``: whether base rules or score reject its text; null for a null text."""
        weights, threshold = self.weights, self.threshold
        at = rows.columns.index(text)
        schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("bad", T.BooleanType())])

        def run(batches):
            for b in sub_batches(batches):
                own = b.column(at)
                bad = base_failed(base_counts(own)) | (scores(own, weights.value) < threshold)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), pa.array(bad, mask=~own.is_valid().to_numpy(zero_copy_only=False))], names=schema.names)

        return rows.mapInArrow(lean(run), schema)

    def kept(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are kept, with all their columns."""
        weights, threshold = self.weights, self.threshold
        at = docs.columns.index("text")

        def run(batches):
            for b in sub_batches(batches):
                text = b.column(at)
                yield b.filter(pa.array(~base_failed(base_counts(text)) & (scores(text, weights.value) >= threshold)))

        return docs.mapInArrow(lean(run), docs.schema)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    return QualityModel(docs, labels).judged(docs)
