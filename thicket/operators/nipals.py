"""Components by power iteration with deflation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
ROUNDS = 300


def components(x: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights n x features, loadings n x samples, means): components of the centred rows.

    Each weight vector is a unit vector whose largest entry is positive; when
    nothing is left to explain, weights and loadings are zero.
    """
    x = np.asarray(x, float)
    means = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    rest = x - means
    floor = 1e-10 * max(1.0, np.abs(rest).max(initial=0.0))
    weights, loadings = np.zeros((n, x.shape[1])), np.zeros((n, len(x)))
    rng = np.random.default_rng(seed)
    for k in range(n):
        if np.abs(rest).max(initial=0.0) <= floor:
            break
        w = rng.standard_normal(x.shape[1])
        w /= np.linalg.norm(w)
        for _ in range(ROUNDS):
            new = rest.T @ (rest @ w)
            size = np.linalg.norm(new)
            if size == 0:
                break
            new /= size
            done = np.linalg.norm(new - w) < TOLERANCE
            w = new
            if done:
                break
        w = w * np.sign(w[np.argmax(np.abs(w))])
        t = rest @ w
        weights[k], loadings[k] = w, t
        rest = rest - np.outer(t, w)
    return weights, loadings, means


def weights(wide: DataFrame, n: int, seed: int = 0) -> np.ndarray:
    """The weights of ``components`` for (x) of any number of rows: means and products of centred features are summed where rows are."""
    first = wide.select(F.size("x")).first()
    if first is None:
        return np.zeros((n, 0))
    width = first[0]
    means = np.array(wide.agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first(), float)

    def run(batches):
        import pyarrow as pa

        part = np.zeros((width, width))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, width) - means
            part += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(part.ravel())], names=["place", "total"])

    sums = wide.select("x").mapInArrow(run, "place long, total double").groupBy("place").agg(F.sum("total")).collect()
    products = np.zeros(width * width)
    for place, total in sums:
        products[place] = total
    return from_products(products.reshape(width, width), n, seed)


def from_products(products: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Weights from the products of centred features; zero when what is left is rounding."""
    rest, found = np.array(products, float), np.zeros((n, len(products)))
    floor = 1e-13 * np.trace(rest)
    rng = np.random.default_rng(seed)
    for k in range(n):
        if np.trace(rest) <= floor:
            break
        w = rng.standard_normal(len(rest))
        w /= np.linalg.norm(w)
        for _ in range(ROUNDS):
            new = rest @ w
            size = np.linalg.norm(new)
            if size == 0:
                break
            new /= size
            done = np.linalg.norm(new - w) < TOLERANCE
            w = new
            if done:
                break
        w = w * np.sign(w[np.argmax(np.abs(w))])
        found[k] = w
        left = np.eye(len(rest)) - np.outer(w, w)
        rest = left @ rest @ left
    return found
