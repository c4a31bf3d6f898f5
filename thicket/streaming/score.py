"""Scoring a stream: routing and additive prediction are maps, so the batch code runs unchanged on every micro-batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Forest
from ..operators import predict, routing

#: Bytes of leaf vectors that are sent to the executors at most.
LEAF_BYTES = 512 << 20


def _add(trees: list[int], table):
    """Sums the leaf vectors of each sample; a leaf that the model does not have adds nothing."""

    def run(batches):
        keys, vectors = table.value
        for b in batches:
            n, k = b.num_rows, len(trees)
            leaves = np.asarray(b.column(1).flatten()).reshape(n, k)
            total = np.zeros((n, vectors.shape[1]))
            for j in range(k):
                at = np.minimum(np.searchsorted(keys[j][0], leaves[:, j]), len(keys[j][0]) - 1) if len(keys[j][0]) else None
                if at is not None:
                    known = keys[j][0][at] == leaves[:, j]
                    total[known] += vectors[keys[j][1][at[known]]]
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * total.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array((total / max(1, k)).ravel()))], names=["sample_id", "leaves", "prediction"])

    return run


def score_stream(forest: Forest, stream: DataFrame, mode: str = "additive_mean") -> DataFrame:
    """stream: (sample_id, x) -> (sample_id, leaves, prediction): an array of output values per sample.

    Leaf vectors are as large as the model.  Their size is checked before they are
    broadcast as one array; a model beyond ``LEAF_BYTES`` is refused and can be
    scored in batches by ``Forest.predict``, which joins them.
    """
    leaves = predict.leaf_vectors(forest.stats, forest.node_table, mode)
    n, width = leaves.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if 8 * n * width > LEAF_BYTES:
        raise ValueError(f"the leaves hold {n} vectors of {width} numbers, more than {LEAF_BYTES} bytes; score in batches instead")
    found = leaves.select("tree_id", F.col("node_id").cast("long").alias("node_id"), "v").orderBy("tree_id", "node_id").toArrow()
    tree, node = (found.column(c).to_numpy() for c in ("tree_id", "node_id"))
    vectors = np.array(found.column("v").to_pylist(), float).reshape(n, width)
    trees = forest.trees
    keys = [(node[tree == t], np.flatnonzero(tree == t)) for t in trees]
    table = stream.sparkSession.sparkContext.broadcast((keys, vectors))
    routed = routing.route(stream, forest.node_table).select(F.col("sample_id").cast("long").alias("sample_id"), "leaves")
    return routed.mapInArrow(_add(trees, table), "sample_id long, leaves array<long>, prediction array<double>")
