"""The two-sided dispersion scan that scores thresholds of an input feature.

Samples are drawn in ascending order of the input feature; position i splits
them into the i drawn so far and the rest.  D[i] sums over output features the
term ``(dispersion * (side / n)^sfr / std)^norm`` of both sides.  The window form
is the executable specification; the kernel does the same on arrays, for all
outputs at once, inside one Arrow task per node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dispersion import Dispersion
from ..functions.frames import Frames

CHUNK = 4_000_000


# -- window form -----------------------------------------------------------------------------------------------------


def scan_windows(long: DataFrame, mode: str = "ssme", norm: int = 1, sfr: float = 0.0, standardize: bool = False) -> DataFrame:
    """(feature_id, position, threshold, d) for positions 1..n of every input feature; outputs are all features."""
    mode = Dispersion.parse(mode)
    if mode is Dispersion.ENTROPY:
        raise ValueError("the window form has no entropy; use the kernel")
    if standardize and mode not in (Dispersion.VAR, Dispersion.SSE, Dispersion.SSME):
        raise ValueError("standardised windows: var, sse and ssme")
    order = Window.partitionBy("feature_id").orderBy("value", "sample_id")
    draws = long.select(F.col("feature_id").alias("fi"), F.col("value").alias("threshold"), "sample_id", F.row_number().over(order).alias("r"))
    rows = draws.join(long.select("sample_id", F.col("feature_id").alias("fo"), "value").hint("merge"), "sample_id")

    def dispersion(f):
        if mode is Dispersion.SSME:
            return f.ssme(f.median())
        if mode is Dispersion.MAD:
            return f.mad(f.median())
        return {Dispersion.SSE: f.sse, Dispersion.VAR: f.var, Dispersion.SME: f.sme}[mode]()

    def run(t):
        t = t.sort_by("r")
        column = t.column("value").combine_chunks()
        value, known = column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        n, full, out = known.sum(), 1.0, np.zeros(len(value))
        for k, f in enumerate((Frames.prefixes(value, known), Frames.suffixes(value, known, 1))):
            d = dispersion(f)
            if standardize and not k and abs(d[-1]) > 1e-10:  # the last prefix is the whole
                full = d[-1]
            out += (np.where(f.n == 0, 0.0, d * (f.n / max(1, n)) ** sfr) / full) ** norm
        return pa.table({"fi": t.column("fi"), "r": t.column("r"), "threshold": t.column("threshold"), "t": out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    terms = rows.select("fi", "fo", "r", "threshold", F.col("value").cast("double").alias("value")).groupBy("fi", "fo").applyInArrow(run, f"fi {kinds['fi']}, r int, threshold {kinds['threshold']}, t double")
    return terms.groupBy(F.col("fi").alias("feature_id"), F.col("r").alias("position"), "threshold").agg(F.sum("t").alias("d"))


def best_splits(scan: DataFrame) -> DataFrame:
    """(feature_id, position, threshold, d, candidate): first minimum of each feature, best feature first."""
    best = scan.groupBy("feature_id").agg(F.min(F.struct(F.round("d", 9).alias("d"), "position", "threshold")).alias("m")).select("feature_id", "m.position", "m.threshold", "m.d")
    return best.withColumn("candidate", F.row_number().over(Window.orderBy("d", "feature_id")))


# -- kernel ----------------------------------------------------------------------------------------------------------


def _slow(values: np.ndarray, mode: Dispersion) -> np.ndarray:
    """Dispersion of each column."""
    n = len(values)
    if n == 0:
        return np.zeros(values.shape[1])
    if mode is Dispersion.VAR:
        return values.var(axis=0)
    if mode is Dispersion.SSE:
        return values.var(axis=0) * n
    med = np.median(values, axis=0)
    far = np.abs(values - med)
    if mode is Dispersion.SSME:
        return (far * far).sum(axis=0)
    if mode is Dispersion.SME:
        return far.sum(axis=0)
    if n < 2:
        return np.zeros(values.shape[1])
    if mode is Dispersion.MAD:
        return np.median(far, axis=0)
    k = max(n // 2, 1) - (1 - n % 2)
    out = np.zeros(values.shape[1])
    for c in range(values.shape[1]):
        rank = np.argsort(values[:, c], kind="stable")
        place = np.empty(n, int)
        place[rank] = np.arange(1, n + 1)
        dropped = np.lexsort((values[:, c], -far[:, c]))[:k]
        left = int((place[dropped] * 2 <= n).sum())
        p = np.array([left, k - left, n - k]) / n
        out[c] = n * sum(x * np.log2(x) for x in p if x > 0)
    return out


def _remaining(outputs: np.ndarray, orders: np.ndarray, mode: Dispersion) -> np.ndarray:
    """Dispersion of what remains before each draw: orders (f, n) of rows -> (f, n + 1, m), zero when all is drawn."""
    f, n = orders.shape
    m = outputs.shape[1]
    out = np.zeros((f, n + 1, m))
    if mode in (Dispersion.VAR, Dispersion.SSE):
        v = (outputs - outputs.mean(axis=0))[orders][:, ::-1]
        k = np.arange(1, n + 1)[None, :, None]
        s, q = np.cumsum(v, axis=1), np.cumsum(v * v, axis=1)
        sse = np.maximum(0, q - s * s / k)
        out[:, :n] = (sse if mode is Dispersion.SSE else sse / k)[:, ::-1]
    elif mode in (Dispersion.SSME, Dispersion.SME):
        out[:, :n] = _by_middles(outputs, orders, mode)
    else:
        for i in range(f):
            for d in range(n):
                out[i, d] = _slow(outputs[orders[i, d:]], mode)
    return out


def _by_middles(outputs: np.ndarray, orders: np.ndarray, mode: Dispersion) -> np.ndarray:
    """SSME or SME while values leave, for all (order, column) pairs side by side.

    Each pair keeps its remaining ranks as a doubly linked list and the two
    middle ranks; a value that leaves moves the middle by one link at most.
    """
    f, n = orders.shape
    m = outputs.shape[1]
    ranked = np.sort(outputs, axis=0)
    rank = np.empty((n, m), np.int64)
    rank[np.argsort(outputs, axis=0, kind="stable"), np.arange(m)] = np.arange(n)[:, None]
    leaving = rank[orders].transpose(1, 0, 2).reshape(n, -1) + 1  # ranks from 1; 0 and n + 1 are the ends
    value = outputs[orders].transpose(1, 0, 2).reshape(n, -1)
    pairs = f * m
    at = np.arange(pairs)
    table = np.zeros((n + 2, m))
    table[1:-1] = ranked
    column = np.tile(np.arange(m), f)
    nxt = np.tile(np.arange(1, n + 3, dtype=np.int32), (pairs, 1))
    prv = np.tile(np.arange(-1, n + 1, dtype=np.int32), (pairs, 1))
    low = np.full(pairs, (n + 1) // 2)
    high = np.full(pairs, n // 2 + 1)
    half = table[1 : n // 2 + 1].sum(axis=0)[column]  # sum of the n // 2 smallest
    total = np.cumsum(value[::-1], axis=0)[::-1]
    squares = np.cumsum((value * value)[::-1], axis=0)[::-1]
    out = np.empty((n, pairs))
    for d in range(n):
        k = n - d
        a, b = table[low, column], table[high, column]
        if mode is Dispersion.SSME:
            mid = (a + b) / 2
            out[d] = np.maximum(0, k * mid * mid - 2 * mid * total[d] + squares[d])
        else:
            out[d] = total[d] - 2 * half - (a if k % 2 else 0)
        q = leaving[d]
        before, after = prv[at, q], nxt[at, q]
        if k % 2:  # one middle value: two of them are left
            half += np.where(q < low, a - value[d], 0)
            low, high = np.where(q < low, low, prv[at, low]), np.where(q > high, high, nxt[at, high])
        else:
            gone = q <= low
            half -= np.where(gone, value[d], a)
            low = high = np.where(gone, high, low)
        nxt[at, before], prv[at, after] = after, before
    return out.reshape(n, f, m).transpose(1, 0, 2)


def scores(outputs: np.ndarray, orders: np.ndarray, mode: Dispersion, norm: int, sfr: float, std: np.ndarray) -> np.ndarray:
    """D[0..n] of each draw order: (f, n + 1)."""
    f, n = orders.shape
    out = np.empty((f, n + 1))
    step = max(1, CHUNK // max(1, n * outputs.shape[1]))
    side = (np.arange(n + 1) / max(1, n))[None, :, None] ** sfr
    for a in range(0, f, step):
        some = orders[a : a + step]
        left = _remaining(outputs, some, mode) * side[:, ::-1]
        drawn = _remaining(outputs, some[:, ::-1], mode)[:, ::-1] * side
        out[a : a + step] = ((left / std) ** norm + (drawn / std) ** norm).sum(axis=2)
    return out


def two_sided(outputs: np.ndarray, mode: Dispersion, norm: int, sfr: float, std: np.ndarray) -> np.ndarray:
    """D[0..n] for outputs (n rows in draw order, m features)."""
    return scores(outputs, np.arange(len(outputs))[None], mode, norm, sfr, std)[0]


def candidates(inputs: np.ndarray, outputs: np.ndarray, mode="ssme", norm: int = 2, sfr: float = 1.0, standardize: bool = False, retry: bool = False) -> list[tuple[int, int, float, float]]:
    """(feature place, drawn sample, threshold, D) of each input feature, best first; ties to the lower place.

    The position with everything drawn may win; such a feature fails the leaf
    check later.  ``retry`` leaves that position out.
    """
    mode = Dispersion.parse(mode) if isinstance(mode, str) else mode
    n = len(inputs)
    if not n:
        return []
    std = np.ones(outputs.shape[1])
    if standardize:
        whole = _slow(outputs, mode)
        std = np.where(np.abs(whole) > 1e-10, whole, 1.0)
    found = []
    orders = np.argsort(inputs, axis=0, kind="stable").T
    every = scores(outputs, orders, mode, norm, sfr, std)[:, 1 : n if retry and n > 1 else n + 1]
    for f, (order, d) in enumerate(zip(orders, every)):
        i = int(np.argmin(np.round(d, 9)))
        found.append((f, int(order[i]), float(inputs[order[i], f]), float(d[i])))
    return [c for _, c in sorted(enumerate(found), key=lambda x: (round(x[1][3], 9), x[0]))]
