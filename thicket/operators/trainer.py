"""Growing all trees of a forest together, one level per round.

A round draws a bag of samples for every open node, searches splits on the bags
(one Arrow task per node; a bag is small whatever the node holds), and applies
the candidates to all samples of the nodes.  Samples are never moved between
nodes: the matrix stays where it is and routing is computed from the splits.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dispersion import Dispersion
from . import nipals, sampling, scan
from .routing import COMPILED, Split, _route_arrow, at_most, leaf_of, reduction_score

NODE_SCHEMA = "tree_id int, node_id long, level int, is_leaf boolean, features array<int>, means array<double>, scores array<double>, split double"

#: Other names of the options.
_ALIASES = {
    "t": "trees", "depth": "max_depth", "l": "min_leaf", "leaves": "min_leaf", "dm": "dispersion", "dispersion_mode": "dispersion", "n": "norm", "norm_mode": "norm",
    "split_fraction_regularization": "sfr", "std": "standardize", "standardized": "standardize", "if": "input_features", "ifs": "input_features", "in_features": "input_features",
    "in_feature_subsample": "input_features", "of": "output_features", "ofs": "output_features", "out_features": "output_features", "out_feature_subsample": "output_features",
    "ss": "samples", "sample_sub": "samples", "sample_subsample": "samples", "r": "reduction", "ri": "reduce_input", "ro": "reduce_output", "u": "unsupervised",
}
#: Options that mean nothing here: process, thread and file settings.
_IGNORED = {"p", "processors", "threads", "parallel_trees", "auto", "a", "components", "tg", "tree_glob", "o", "output_location", "suppress_warnings", "sw"}


@dataclass(frozen=True)
class Parameters:
    trees: int = 1
    max_depth: int = 1
    min_leaf: int = 1
    dispersion: str = "ssme"
    norm: int = 2
    sfr: float = 1.0
    standardize: bool = False
    input_features: int = 1
    output_features: int = 1
    samples: int = 1
    unsupervised: bool = False
    reduce_input: bool = False
    reduce_output: bool = False
    reduction: int = 1
    retry_positions: bool = False
    seed: int = 0

    @classmethod
    def of(cls, **options) -> Parameters:
        """Accepts long names and the short flags; unknown ones raise TypeError."""
        given = {}
        for key, value in options.items():
            if key in ("fs", "feature_sub", "feature_subsample"):
                given["input_features"] = given["output_features"] = int(value)
                continue
            name = _ALIASES.get(key, key)
            if name in _IGNORED:
                continue
            kinds = {f.name: f.type for f in fields(cls)}
            if name not in kinds:
                raise TypeError(f"no option {key!r}")
            if name == "norm":
                value = int(str(value).lstrip("lL"))
            elif kinds[name] == "bool" and isinstance(value, str):
                value = value.lower() not in ("false", "0", "no", "")
            elif kinds[name] in ("int", "float"):
                value = {"int": int, "float": float}[kinds[name]](value)
            given[name] = value
        p = cls(**given)
        Dispersion.parse(p.dispersion)
        if p.norm not in (1, 2):
            raise ValueError("the norm is 1 or 2")
        return p


CANDIDATE = "tree_id int, node_id long, place int, features array<int>, means array<double>, scores array<double>, split double, d double"


def _search(p: Parameters, width_in: int, width_out: int):
    """Candidates of one node from its bag (draw_no, x, y)."""

    def run(table):
        tree, node = table.column("tree_id")[0].as_py(), table.column("node_id")[0].as_py()
        table = table.sort_by("draw_no")
        x = np.array(table.column("x").to_pylist(), float).reshape(len(table), width_in)
        y = np.array(table.column("y").to_pylist(), float).reshape(len(table), width_out)
        ins, outs = list(range(width_in)), list(range(width_out))
        if p.unsupervised:
            ins, outs = sampling.feature_pools(tree, node, width_in, p.seed, True)
        fi = sampling.feature_draws(ins, tree, node, p.input_features, p.seed, 0)
        fo = sampling.feature_draws(outs, tree, node, p.output_features, p.seed, 1)
        rows = []
        if fi and fo:
            a, b = x[:, fi], y[:, fo]
            weights = means = None
            if p.reduce_input:
                weights, a, means = nipals.components(a, p.reduction, p.seed)
                a = a.T
            if p.reduce_output:
                b = nipals.components(b, p.reduction, p.seed)[1].T
            for place, (f, _, threshold, d) in enumerate(scan.candidates(a, b, p.dispersion, p.norm, p.sfr, p.standardize, p.retry_positions)):
                if weights is None:
                    rows.append((tree, node, place, [fi[f]], [0.0], [1.0], threshold, d))
                else:
                    rows.append((tree, node, place, fi, means.tolist(), weights[f].tolist(), threshold, d))
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in CANDIDATE.split(", ")]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})

    return run


def _routed(matrix: DataFrame, trees: int, splits: list[Split]) -> DataFrame:
    ids = list(range(trees))
    if len(splits) <= COMPILED:
        return matrix.withColumn("leaves", F.array(*[leaf_of(F.col("x"), [s for s in splits if s.tree_id == t]) for t in ids]))
    routed = matrix.select("sample_id", "x").mapInArrow(_route_arrow(ids, splits), "sample_id long, x array<double>, leaves array<long>")
    return routed


def _accept(at: DataFrame, candidates: DataFrame, least: int, widths=(4, 1 << 30)) -> list:
    """For each node the first candidate that leaves more than ``least`` samples on both sides.

    at: (tree_id, node_id, x) of all samples of open nodes.  The first few
    candidates are counted, then the others of the nodes where none of them did.
    """
    chosen, low, open_ = [], 0, candidates
    for width in widths:
        some = open_.where((F.col("place") >= low) & (F.col("place") < low + width))
        j = at.join(some.withColumn("r", F.struct("features", "means", "scores")), ["tree_id", "node_id"])
        right = (~at_most(reduction_score("x", "r"), F.col("split"))).cast("long")
        count = j.groupBy("tree_id", "node_id", "place").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("all"))
        ok = count.where((F.col("right") > least) & (F.col("all") - F.col("right") > least)).groupBy("tree_id", "node_id").agg(F.min("place").alias("place"))
        won = candidates.join(ok, ["tree_id", "node_id", "place"]).collect()  # one row per split of the model
        chosen += won
        low += width
        done = at.sparkSession.createDataFrame([(r.tree_id, r.node_id) for r in won], "tree_id int, node_id long")
        open_ = open_.join(done, ["tree_id", "node_id"], "left_anti")
        if open_.where(F.col("place") >= low).isEmpty():
            break
    return chosen


def grow(inputs: DataFrame, outputs: DataFrame | None, p: Parameters) -> tuple[DataFrame, list[Split]]:
    """inputs, outputs: wide matrices by sample -> (nodes, splits)."""
    spark: SparkSession = inputs.sparkSession
    if outputs is None:
        matrix = inputs.select("sample_id", "x", F.col("x").alias("y"))
    else:
        matrix = inputs.select("sample_id", "x").join(outputs.select("sample_id", F.col("x").alias("y")), "sample_id")
    matrix = matrix.persist()
    try:
        total, wi, wo = matrix.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.size("y"))).first()
        if not total:
            raise ValueError("the matrix is empty")
        splits: list[Split] = []
        open_nodes = [(t, 1) for t in range(p.trees)]
        every: dict[tuple[int, int], Split | None] = dict.fromkeys(open_nodes)
        for _ in range(p.max_depth):
            if not open_nodes:
                break
            routed = _routed(matrix, p.trees, splits)
            opened = spark.createDataFrame(open_nodes, "tree_id int, node_id long")
            at = routed.select("sample_id", "x", F.posexplode("leaves").alias("tree_id", "node_id")).join(opened, ["tree_id", "node_id"])
            member = at.select("tree_id", "node_id", "sample_id")
            active = member.groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("pop"))
            # Counted, so that the joins below know how small draws and candidates are.
            drawn = sampling.drawn_samples(member, sampling.node_draws(active, p.samples, p.seed), total).persist()
            drawn.count()
            bags = drawn.join(matrix, "sample_id").select("tree_id", "node_id", "draw_no", "x", "y")
            found = bags.groupBy("tree_id", "node_id").applyInArrow(_search(p, wi, wo), CANDIDATE).persist()
            found.count()
            won = _accept(at.select("tree_id", "node_id", "x"), found, p.min_leaf)
            found.unpersist()
            drawn.unpersist()
            open_nodes = []
            for r in sorted(won, key=lambda r: (r.tree_id, r.node_id)):
                s = Split(r.tree_id, r.node_id, tuple(r.features), tuple(r.means), tuple(r.scores), r.split)
                splits.append(s)
                every[r.tree_id, r.node_id] = s
                for child in (2 * r.node_id, 2 * r.node_id + 1):
                    every[r.tree_id, child] = None
                    open_nodes.append((r.tree_id, child))
    finally:
        matrix.unpersist()
    rows = [(t, n, n.bit_length() - 1, s is None, *((list(s.features), list(s.means), list(s.scores), s.split) if s else (None,) * 4)) for (t, n), s in sorted(every.items())]
    return spark.createDataFrame(rows, NODE_SCHEMA), splits
