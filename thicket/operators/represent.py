"""Node representations, and distances between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from . import node_stats as S
from .navigate import sister

KEY = ["tree_id", "node_id"]


def sample_rows(member: DataFrame) -> DataFrame:
    """mode sample: 1 where a node holds a sample."""
    return member.select(*KEY, F.col("sample_id").alias("item"), F.lit(1.0).alias("value"))


def factor_rows(factor_nodes: DataFrame) -> DataFrame:
    return factor_nodes.select(*KEY, F.col("factor_id").cast("long").alias("item"), F.lit(1.0).alias("value"))


def sister_rows(member: DataFrame) -> DataFrame:
    """mode sister: +1 for own samples, -1 for the sister's."""
    other = member.where("node_id > 1").select("tree_id", sister().alias("node_id"), "sample_id")
    return sample_rows(member).union(other.select(*KEY, F.col("sample_id").alias("item"), F.lit(-1.0).alias("value")))


def representation(mode: str, stats: DataFrame, nodes: DataFrame, member: DataFrame | None = None, factor_nodes: DataFrame | None = None) -> DataFrame:
    """(tree_id, node_id, item, value), sparse."""
    if mode == "sample":
        return sample_rows(member)
    if mode == "sister":
        return sister_rows(member)
    if mode == "factor":
        return factor_rows(factor_nodes)
    tables = {
        "gain": lambda: S.local_gains(stats).withColumnRenamed("gain", "value"),
        "absolute_gain": lambda: S.absolute_gains(stats).withColumnRenamed("gain", "value"),
        "error_ratio": lambda: S.error_ratios(stats).withColumnRenamed("error_ratio", "value"),
        "additive": lambda: S.additive_gains(stats, "median").withColumnRenamed("gain", "value"),
        "additive_mean": lambda: S.additive_gains(stats, "mean").withColumnRenamed("gain", "value"),
        "mean": lambda: stats.withColumnRenamed("mean", "value"),
        "median": lambda: stats.withColumnRenamed("median", "value"),
        "partial": lambda: S.partials(stats, nodes).withColumnRenamed("partial", "value"),
        "partial_absolute": lambda: S.absolute_partials(stats).withColumnRenamed("partial", "value"),
    }
    tables["conditional_gain"] = tables["additive_mean"]
    if mode not in tables:
        raise ValueError(f"no representation {mode!r}")
    return tables[mode]().select(*KEY, F.col("feature_id").cast("long").alias("item"), "value")


def weights(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Output weights: all ones."""
    return nodes.select(*KEY).crossJoin(F.broadcast(features.select("feature_id"))).withColumn("weight", F.lit(1.0))


def vectors(rep: DataFrame) -> DataFrame:
    """Dense representations -> (tree_id, node_id, v), items in order."""
    pairs = F.array_sort(F.collect_list(F.struct("item", "value")))
    return rep.groupBy(*KEY).agg(F.transform(pairs, lambda p: p["value"]).alias("v"))


def pca(vec: DataFrame, k: int) -> DataFrame:
    """Scores on the first k principal components of dense vectors (columns centred)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    width = len(vec.first()["v"])
    m = vec.select(*KEY, array_to_vector("v").alias("raw"))
    centred = StandardScaler(inputCol="raw", outputCol="c", withMean=True, withStd=False).fit(m).transform(m)
    fitted = PCA(k=min(k, width), inputCol="c", outputCol="p").fit(centred)
    return fitted.transform(centred).select(*KEY, vector_to_array("p").alias("v"))


def metric(a, b, name: str):
    """Distance of two array columns."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    if name == "cosine":
        return 1 - ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if name == "correlation":
        centre = lambda x: F.transform(x, lambda v: v - total(x) / F.size(x))
        return metric(centre(a), centre(b), "cosine")
    if name == "euclidean":
        return F.sqrt(total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))))
    if name == "sqeuclidean":
        return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))
    if name == "cityblock":
        return total(F.zip_with(a, b, lambda p, q: F.abs(p - q)))
    raise ValueError(f"no metric {name!r}")


def pair_distances(vec: DataFrame, name: str = "cosine") -> DataFrame:
    """All pairs of nodes of a model: (tree_a, node_a, tree_b, node_b, distance).  Models are small; rows are not compared."""
    a = vec.select(F.col("tree_id").alias("tree_a"), F.col("node_id").alias("node_a"), F.col("v").alias("va"))
    b = vec.select(F.col("tree_id").alias("tree_b"), F.col("node_id").alias("node_b"), F.col("v").alias("vb"))
    j = a.crossJoin(b).where(F.struct("tree_a", "node_a") < F.struct("tree_b", "node_b"))
    return j.select("tree_a", "node_a", "tree_b", "node_b", metric("va", "vb", name).alias("distance"))


def sister_distances(rep: DataFrame) -> DataFrame:
    """1 - (a.b + min of sizes) / (2 * max of sizes) for nodes that share a sample or its absence; sizes count non-zero items.

    Items that lie in the same nodes are counted before their nodes are paired; nothing of a sample is joined.
    """
    size = rep.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
    kinds = rep.where("item is not null").groupBy("item").agg(F.sort_array(F.collect_list(F.struct(*KEY, "value"))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    pairs = kinds.select("n", "p", F.explode("p").alias("a")).select("n", "a", F.explode("p").alias("b"))
    pairs = pairs.where(F.struct("a.tree_id", "a.node_id") < F.struct("b.tree_id", "b.node_id"))
    keys = [F.col(f"{s}.{c}_id").alias(f"{c}_{s}") for s in "ab" for c in ("tree", "node")]
    dots = pairs.groupBy(*keys).agg(F.sum(F.col("a.value") * F.col("b.value") * F.col("n")).alias("dot"))
    sa = size.select(F.col("tree_id").alias("tree_a"), F.col("node_id").alias("node_a"), F.col("size").alias("sa"))
    sb = size.select(F.col("tree_id").alias("tree_b"), F.col("node_id").alias("node_b"), F.col("size").alias("sb"))
    j = dots.join(sa, ["tree_a", "node_a"]).join(sb, ["tree_b", "node_b"])
    return j.select("tree_a", "node_a", "tree_b", "node_b", (1 - (F.col("dot") + F.least("sa", "sb")) / (2 * F.greatest("sa", "sb"))).alias("distance"))


def leaf_order(matrix, names: str = "cosine") -> list[int]:
    """Row order of an average-linkage tree over a gathered small matrix (a few thousand rows)."""
    import numpy as np

    m = np.asarray(matrix, float)
    if names == "correlation":
        m = m - m.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(m, axis=1)
    norm[norm == 0] = 1
    d = 1 - (m / norm[:, None]) @ (m / norm[:, None]).T
    np.fill_diagonal(d, np.inf)
    groups, size = {i: [i] for i in range(len(m))}, np.ones(len(m))
    for _ in range(len(m) - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        groups[i] += groups.pop(j)
    return next(iter(groups.values())) if groups else []
