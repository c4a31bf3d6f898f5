"""Comparison of two datasets through one forest, for all factors at once.

Both sides are stacked with a boolean column ``a`` (true for this dataset), so
each comparison is one grouped query over factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, symmetric_kl, t_density, t_tail, two_sample
from .represent import metric

KEY = ["tree_id", "node_id"]


def stack(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("a", F.lit(True)).unionByName(b.withColumn("a", F.lit(False)))


def factor_fractions(a: DataFrame, b: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """Node fractions: mean of each side and rank test."""
    rows = stack(a, b).join(factor_nodes, KEY)
    means = rows.groupBy("factor_id").agg(F.avg(F.when(F.col("a"), F.col("fraction"))).alias("mean_a"), F.avg(F.when(~F.col("a"), F.col("fraction"))).alias("mean_b"))
    return means.join(two_sample(rows, ["factor_id"], "fraction", "a"), "factor_id")


def factor_residuals(a: DataFrame, b: DataFrame) -> DataFrame:
    """z of the difference of jackknifed factor errors, null without variance: both (factor_id, estimate, variance)."""
    j = a.join(b.select("factor_id", F.col("estimate").alias("other")), "factor_id")
    return j.select("factor_id", "estimate", "other", F.when(F.col("variance") > 1e-9, (F.col("estimate") - F.col("other")) / F.sqrt("variance")).alias("z"))


def with_t(df: DataFrame, z: str, dof: float) -> DataFrame:
    """Density of Student's t at z (what is reported as p) and the two-sided tail."""
    density = F.pandas_udf(lambda s: s.map(lambda x: t_density(x, dof), na_action="ignore"), "double")
    tail = F.pandas_udf(lambda s: s.map(lambda x: t_tail(x, dof), na_action="ignore"), "double")
    return df.withColumns({"t_density": density(F.col(z)), "t_tail": tail(F.col(z))})


def factor_fvu(a: DataFrame, b: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """Total error ratios of both sides, and a rank test of node determinations; node errors (tree, node, own, parent)."""
    rows = stack(a, b).join(factor_nodes, KEY)
    pick = lambda c, side: F.sum(F.when(F.col("a") if side else ~F.col("a"), F.col(c)))
    total = rows.groupBy("factor_id").agg(ratio(pick("own", True), pick("parent", True)).alias("fvu_a"), ratio(pick("own", False), pick("parent", False)).alias("fvu_b"))
    cod = rows.where("parent != 0").withColumn("cod", F.round(1 - F.col("own") / F.col("parent"), 9))
    return total.join(two_sample(cod, ["factor_id"], "cod", "a"), "factor_id")


def factor_values(a: DataFrame, b: DataFrame, bins: int = 100) -> DataFrame:
    """Scores of both sides (factor_id, sample_id, score): symmetric divergence, rank and distance statistics."""
    rows = stack(a, b)
    return symmetric_kl(rows, ["factor_id"], "score", "a", bins).join(two_sample(rows, ["factor_id"], "score", "a"), "factor_id")


def _mean_vectors(rows: DataFrame, value: str) -> DataFrame:
    """(factor_id, a, mean vector) of node vectors."""
    m = rows.groupBy("factor_id", "a", "feature_id").agg(F.avg(value).alias("m"))
    return m.groupBy("factor_id", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "m"))), lambda p: p["m"]).alias("mean"))


def factor_vectors(a: DataFrame, b: DataFrame, factor_nodes: DataFrame, value: str, distance: str = "cosine") -> DataFrame:
    """Marginals or means of a factor's nodes (tree, node, feature, value) on both sides.

    own: mean distance of this side's nodes to their mean; other: distance of the
    other side's mean to it; rank: share of own distances below that.
    """
    rows = stack(a, b).join(factor_nodes, KEY)
    means = _mean_vectors(rows, value)
    ma = means.where("a").select("factor_id", F.col("mean").alias("ma"))
    mb = means.where("not a").select("factor_id", F.col("mean").alias("mb"))
    v = rows.where("a").groupBy("factor_id", *KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", value))), lambda p: p[value]).alias("v"))
    j = v.join(ma.join(mb, "factor_id"), "factor_id").select("factor_id", F.round(metric("v", "ma", distance), 9).alias("own"), F.round(metric("mb", "ma", distance), 9).alias("other"))
    return j.groupBy("factor_id").agg(F.avg("own").alias("own"), F.first("other").alias("other"), F.avg((F.col("own") < F.col("other")).cast("double")).alias("rank"))


def cluster_frequencies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cluster_id, count_a, count_b) of predicted clusters."""
    return stack(a, b).groupBy("cluster_id").agg(F.sum(F.col("a").cast("int")).alias("count_a"), F.sum((~F.col("a")).cast("int")).alias("count_b"))


def feature_residuals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per feature: tests of residual distributions and the changes of mse and determination; (sample, feature, value, residual)."""
    from .predict import feature_errors

    rows = stack(a.select("feature_id", F.round("residual", 9).alias("residual")), b.select("feature_id", F.round("residual", 9).alias("residual")))
    ea = feature_errors(a).select("feature_id", F.col("mse").alias("mse_a"), F.col("cod").alias("cod_a"))
    eb = feature_errors(b).select("feature_id", F.col("mse").alias("mse_b"), F.col("cod").alias("cod_b"))
    j = two_sample(rows, ["feature_id"], "residual", "a").join(ea, "feature_id").join(eb, "feature_id")
    return j.select("feature_id", "u", "rank_sum", "z", "ks", "n_a", "n_b", (F.col("mse_b") - F.col("mse_a")).alias("mse_delta"), (F.col("cod_b") - F.col("cod_a")).alias("cod_delta"))


def all_factors(a: DataFrame, b: DataFrame, node_a: DataFrame, node_b: DataFrame, factor_nodes: DataFrame, bins: int = 100) -> DataFrame:
    """Value and error comparisons of every factor in one table: scores of both sides and node errors of both sides."""
    v = factor_values(a, b, bins).select("factor_id", "symmetric_kl", F.col("z").alias("value_z"), F.col("ks").alias("value_ks"))
    e = factor_fvu(node_a, node_b, factor_nodes).select("factor_id", (F.col("fvu_b") - F.col("fvu_a")).alias("fvu_delta"), F.col("z").alias("cod_z"))
    return v.join(e, "factor_id", "full_outer")


def rank_among(own: DataFrame, keys: list[str], value: str, other: str) -> DataFrame:
    """Share of a group's values that are below another value."""
    return own.groupBy(*keys).agg(F.avg((F.col(value) < F.col(other)).cast("double")).alias("rank"))


def leave_one_out(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's group sum without it."""
    return df.withColumn("rest", F.sum(value).over(Window.partitionBy(*keys)) - F.col(value))
