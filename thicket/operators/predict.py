"""Predictions of a forest for new samples, and their errors.

A sample's prediction needs only its leaf in each tree, so node tables are
joined by leaf: what is added up along the path is summed per node beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import jackknife_variance, ratio
from . import node_stats as S
from .navigate import ancestry, parent

KEY = ["tree_id", "node_id"]


def leaf_vectors(stats: DataFrame, nodes: DataFrame, mode: str = "additive_mean") -> DataFrame:
    """(tree_id, node_id, v): what a leaf contributes, per output feature in order.

    additive: sum of additive median gains along the path; additive_mean: of
    additive mean gains, which is the leaf's mean; mean and median: of the leaf.
    """
    if mode in ("additive", "additive_mean"):
        gains = S.additive_gains(stats, "median" if mode == "additive" else "mean")
        a = ancestry(nodes.where("is_leaf").select(*KEY))
        t = a.join(gains.select("tree_id", F.col("node_id").alias("ancestor_id"), "feature_id", "gain"), ["tree_id", "ancestor_id"]).groupBy(*KEY, "feature_id").agg(F.sum("gain").alias("value"))
    elif mode in ("mean", "median"):
        t = stats.join(nodes.where("is_leaf").select(*KEY), KEY, "left_semi").select(*KEY, "feature_id", F.col(mode).alias("value"))
    else:
        raise ValueError(f"no prediction mode {mode!r}")
    pairs = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    return t.groupBy(*KEY).agg(F.transform(pairs, lambda p: p["value"]).alias("v"))


def predict(routed: DataFrame, trees: list[int], leaves: DataFrame) -> DataFrame:
    """routed, leaf vectors -> (sample_id, feature_id, prediction): mean over trees; 0 where no tree has a value.

    Leaf vectors are a model's size and are broadcast by Spark when below its
    threshold; predictions are then one aggregation per sample.
    """
    ids = F.array(*[F.lit(t) for t in trees])
    at = routed.select("sample_id", F.posexplode("leaves").alias("k", "node_id")).select("sample_id", F.get(ids, F.col("k")).alias("tree_id"), "node_id")
    values = at.join(leaves, KEY, "left").select("sample_id", F.posexplode_outer("v").alias("feature_id", "value"))
    return values.where("feature_id is not null").groupBy("sample_id", "feature_id").agg((F.sum("value") / F.lit(float(len(trees)))).alias("prediction"))


def node_average(member: DataFrame, stats: DataFrame, which: str = "mean", mask: DataFrame | None = None) -> DataFrame:
    """Average of node means or medians over the (masked) nodes that hold a sample: (sample_id, feature_id, prediction)."""
    m = member if mask is None else member.join(mask.select(*KEY), KEY, "left_semi")
    return m.join(stats.select(*KEY, "feature_id", F.col(which).alias("__v")), KEY).groupBy("sample_id", "feature_id").agg(F.avg("__v").alias("prediction"))


def residuals(long: DataFrame, predictions: DataFrame) -> DataFrame:
    """Truth less prediction; missing predictions count as 0."""
    j = long.join(predictions, ["sample_id", "feature_id"], "left")
    return j.select("sample_id", "feature_id", "value", (F.col("value") - F.coalesce("prediction", F.lit(0.0))).alias("residual"))


def feature_errors(res: DataFrame) -> DataFrame:
    """Per feature: mse, remaining error (sum of squares over that about the mean) and determination."""
    r, v = F.col("residual"), F.col("value")
    s = res.groupBy("feature_id").agg(F.avg(r * r).alias("mse"), F.sum(r * r).alias("own"), (F.var_pop(v) * F.count(v)).alias("null"))
    return s.select("feature_id", "mse", ratio("own", "null").alias("remaining"), (1 - ratio("own", "null")).alias("cod"))


def feature_mse_jackknife(res: DataFrame) -> DataFrame:
    return jackknife_variance(res, ["feature_id"], "residual")


def report(res: DataFrame) -> DataFrame:
    """One row: fraction of squared and of absolute deviation that is left unexplained."""
    means = res.groupBy("feature_id").agg(F.avg("value").alias("m"))
    j = res.join(means, "feature_id")
    d = F.col("value") - F.col("m")
    return j.agg(ratio(F.sum(F.col("residual") * F.col("residual")), F.sum(d * d)).alias("squared"), ratio(F.sum(F.abs("residual")), F.sum(F.abs(d))).alias("absolute"))


def report_by(res: DataFrame, key: str) -> DataFrame:
    """(key, ratio): smoothed squared residuals over squared deviations from the feature means, by feature or sample."""
    means = res.groupBy("feature_id").agg(F.avg("value").alias("m"))
    d = F.col("value") - F.col("m")
    j = res.join(means, "feature_id").groupBy(key).agg(F.sum(F.col("residual") * F.col("residual")).alias("a"), F.sum(d * d).alias("b"))
    return j.select(key, ((F.col("a") + 1) / (F.col("b") + 1)).alias("ratio"))


def node_sample_errors(values: DataFrame, stats: DataFrame) -> DataFrame:
    """(node, sample, error): squared distance to the trained node mean, summed over features.  values: new data by node."""
    j = S.beside(values, stats.select(*KEY, "feature_id", "mean"), [*KEY, "feature_id"])
    d = F.col("value") - F.col("mean")
    return j.groupBy(*KEY, "sample_id").agg(F.sum(d * d).alias("error"))


def node_feature_errors(values: DataFrame, stats: DataFrame) -> DataFrame:
    """(node, feature): n, squared error about the trained own mean and about the trained parent's (0 at the root)."""
    p = S.with_parent(stats).select(*KEY, "feature_id", "mean", F.coalesce("p_mean", F.lit(0.0)).alias("p_mean"))
    j = S.beside(values, p, [*KEY, "feature_id"])
    a, b = F.col("value") - F.col("mean"), F.col("value") - F.col("p_mean")
    return j.groupBy(*KEY, "feature_id").agg(F.count(F.lit(1)).alias("n"), F.sum(a * a).alias("own"), F.sum(b * b).alias("parent"))


def node_mse(errors: DataFrame) -> DataFrame:
    """(node, n, mse): mean over samples and features."""
    return errors.groupBy(*KEY).agg(F.max("n").alias("n"), (F.sum("own") / F.sum("n")).alias("mse"))


def observed_means(values: DataFrame, nodes: DataFrame, features: DataFrame) -> DataFrame:
    """Node means of the new data; 0 for empty nodes."""
    m = values.groupBy(*KEY, "feature_id").agg(F.avg("value").alias("mean"))
    grid = nodes.select(*KEY).crossJoin(F.broadcast(features.select("feature_id")))
    return grid.join(m, [*KEY, "feature_id"], "left").select(*KEY, "feature_id", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.col("mean").isNotNull().alias("seen"))


def observed_marginals(means: DataFrame) -> DataFrame:
    """Node mean less the parent's on new data; 0 if either node is empty."""
    up = means.select("tree_id", F.col("node_id").alias("__up"), "feature_id", F.col("mean").alias("p"), F.col("seen").alias("p_seen"))
    j = means.where("node_id > 1").withColumn("__up", parent()).join(up, ["tree_id", "__up", "feature_id"])
    return j.select(*KEY, "feature_id", F.when(F.col("seen") & F.col("p_seen"), F.col("mean") - F.col("p")).otherwise(0.0).alias("marginal"))


def node_fractions(pop: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of the parent's samples; 1 at the root, 0 under an empty parent."""
    full = nodes.select(*KEY).join(pop, KEY, "left").fillna(0, ["pop"])
    up = full.select("tree_id", F.col("node_id").alias("__up"), F.col("pop").alias("p"))
    j = full.withColumn("__up", parent()).join(up, ["tree_id", "__up"], "left")
    return j.select(*KEY, F.when(F.col("node_id") == 1, 1.0).otherwise(ratio("pop", "p")).alias("fraction"))


def factor_errors(errors: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """(factor, feature): own and parent errors summed over the factor's nodes."""
    return errors.join(factor_nodes, KEY).groupBy("factor_id", "feature_id").agg(F.sum("own").alias("own"), F.sum("parent").alias("parent"))


def factor_mse(mse: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """Mean, variance and 5-95 % range of node errors."""
    j = mse.join(factor_nodes, KEY)
    return j.groupBy("factor_id").agg(F.avg("mse").alias("mean"), F.var_pop("mse").alias("variance"), (F.percentile("mse", F.lit(0.95)) - F.percentile("mse", F.lit(0.05))).alias("range"))


def jackknife_factor_mse(mse: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    return jackknife_variance(mse.join(factor_nodes, KEY).withColumn("root", F.sqrt("mse")), ["factor_id"], "root")


def sample_clusters(member: DataFrame, nodes: DataFrame, composition: DataFrame) -> DataFrame:
    """Predicted cluster: the greatest mean share over a sample's leaves; ties to the smaller id."""
    leaf = member.join(nodes.where("is_leaf").select(*KEY), KEY, "left_semi")
    share = leaf.join(composition, KEY).groupBy("sample_id", "cluster_id").agg(F.sum("fraction").alias("f"))
    return share.groupBy("sample_id").agg(F.max_by("cluster_id", F.struct(F.round("f", 9), -F.col("cluster_id"))).alias("cluster_id"))
