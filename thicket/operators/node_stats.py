"""Statistics of every node: grouped aggregates over the samples that pass it.

The base table has one row per (tree, node, feature) and comes from one
aggregation over the routed wide matrix; no join between membership and values
is needed.  Everything below works on that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dispersion import median
from ..functions.quantiles import exact_medians
from ..functions.stats import ratio
from .navigate import ancestry, parent, sister
from .routing import visits

KEY = ["tree_id", "node_id"]
#: Rows of a model's table up to which every task gets it whole.
SENT = 200_000


def node_values(routed: DataFrame, trees: list[int]) -> DataFrame:
    """(tree_id, node_id, sample_id, feature_id, value): the rows of each node's submatrix."""
    v = visits(routed, trees, ["x"])
    return v.select(*KEY, "sample_id", F.posexplode("x").alias("feature_id", "value"))


def node_stats(values: DataFrame, large: bool = False) -> DataFrame:
    """n, mean, median, srs (squared residuals about the mean) and ssme (about the median).

    ``large``: nodes hold more distinct values than fit in a task; medians are
    then found by narrowing brackets, still exactly.
    """
    v, m = F.col("value"), median()
    if large:
        keys = [*KEY, "feature_id"]
        s = values.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("srs"))
        gap = F.col("mean") - F.col("median")
        return s.join(exact_medians(values, keys), keys).select(*keys, "n", "mean", "median", "srs", (F.col("srs") + F.col("n") * gap * gap).alias("ssme"))
    return values.groupBy(*KEY, "feature_id").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), m.alias("median"), (F.var_pop(v) * F.count(v)).alias("srs"), (F.count(v) * m * m - 2 * m * F.sum(v) + F.sum(v * v)).alias("ssme")
    )


def beside(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of samples joined with a model's table, by a side that is stated.

    Spark guesses sizes from files, where a row of a matrix is one row; left to
    it, all rows of all nodes may be gathered in the driver and sent around.
    """
    small = table.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(table) if small else table.hint("merge"), keys)


def with_parent(stats: DataFrame) -> DataFrame:
    """Each row with its parent's: columns p_n, p_mean, p_median, p_srs; null at the root."""
    up = stats.select("tree_id", F.col("node_id").alias("__up"), "feature_id", *[F.col(c).alias(f"p_{c}") for c in ("n", "mean", "median", "srs", "ssme")])
    return stats.withColumn("__up", parent()).join(up, ["tree_id", "__up", "feature_id"], "left").drop("__up")


def residuals(values: DataFrame, stats: DataFrame, about: str = "mean") -> DataFrame:
    """Values less the node's mean or median."""
    return beside(values, stats.select(*KEY, "feature_id", F.col(about).alias("__c")), [*KEY, "feature_id"]).select(*KEY, "sample_id", "feature_id", (F.col("value") - F.col("__c")).alias("residual"))


def residual_doublets(values: DataFrame, stats: DataFrame) -> DataFrame:
    """Residuals about the own mean and about the parent's (0 at the root)."""
    p = with_parent(stats).select(*KEY, "feature_id", "mean", F.coalesce("p_mean", F.lit(0.0)).alias("p_mean"))
    j = beside(values, p, [*KEY, "feature_id"])
    return j.select(*KEY, "sample_id", "feature_id", (F.col("value") - F.col("mean")).alias("own"), (F.col("value") - F.col("p_mean")).alias("parent"))


def squared_doublets(stats: DataFrame) -> DataFrame:
    """Sums of squared residuals about the own and the parent's mean, in closed form."""
    p = with_parent(stats)
    gap = F.col("mean") - F.coalesce("p_mean", F.lit(0.0))
    return p.select(*KEY, "feature_id", "n", F.col("srs").alias("own"), (F.col("srs") + F.col("n") * gap * gap).alias("parent"))


def determination(stats: DataFrame) -> DataFrame:
    """(tree_id, node_id, cod): 1 - mean squared residual over the parent's; 0 at the root."""
    per = stats.groupBy(*KEY).agg(F.sum("srs").alias("srs"), F.max("n").alias("n")).withColumn("mse", ratio("srs", "n"))
    up = per.select("tree_id", F.col("node_id").alias("__up"), F.col("mse").alias("p_mse"))
    j = per.withColumn("__up", parent()).join(up, ["tree_id", "__up"], "left")
    return j.select(*KEY, F.when(F.col("node_id") == 1, 0.0).otherwise(1 - ratio("mse", "p_mse", None)).alias("cod"))


def node_dispersions(stats: DataFrame, about: str = "mean") -> DataFrame:
    """Mean squared residual about the mean or the median."""
    return stats.select(*KEY, "feature_id", ratio("srs" if about == "mean" else "ssme", "n").alias("dispersion"))


def error_ratios(stats: DataFrame) -> DataFrame:
    d = squared_doublets(stats)
    return d.select(*KEY, "feature_id", ((F.col("own") + 1) / (F.col("parent") + 1)).alias("error_ratio"))


def absolute_gains(stats: DataFrame, about: str = "mean") -> DataFrame:
    """The root's dispersion less the node's."""
    d = node_dispersions(stats, about)
    top = d.where("node_id = 1").select("tree_id", "feature_id", F.col("dispersion").alias("top"))
    return d.join(top, ["tree_id", "feature_id"]).select(*KEY, "feature_id", (F.col("top") - F.col("dispersion")).alias("gain"))


def local_gains(stats: DataFrame, about: str = "mean") -> DataFrame:
    """The parent's dispersion less the node's; 0 at the root."""
    d = node_dispersions(stats, about)
    up = d.select("tree_id", F.col("node_id").alias("__up"), "feature_id", F.col("dispersion").alias("p"))
    j = d.withColumn("__up", parent()).join(up, ["tree_id", "__up", "feature_id"], "left")
    return j.select(*KEY, "feature_id", F.coalesce(F.col("p") - F.col("dispersion"), F.lit(0.0)).alias("gain"))


def additive_gains(stats: DataFrame, about: str = "median") -> DataFrame:
    """Median (or mean) less the parent's; the root's own."""
    p = with_parent(stats)
    return p.select(*KEY, "feature_id", "n", (F.col(about) - F.coalesce(f"p_{about}", F.lit(0.0))).alias("gain"))


def feature(table: DataFrame, feature_id: int) -> DataFrame:
    """One feature of any table here; the filter reaches the scan when it is pushed below the aggregation."""
    return table.where(F.col("feature_id") == feature_id)


def partials(stats: DataFrame, nodes: DataFrame) -> DataFrame:
    """sign(g) * g^2 n / (g^2 n + sum of g^2 n over everything below the node and below its sister); leaves keep g.

    g is the additive mean gain.  The root has no sister: what is below it counts alone.
    """
    g = additive_gains(stats, "mean")
    power = g.select(*KEY, "feature_id", (F.col("gain") * F.col("gain") * F.col("n")).alias("w"))
    # A node's power counts for each proper ancestor and for that ancestor's sister.
    up = ancestry(nodes.select(*KEY)).where("distance > 0")
    below = power.join(up, KEY).groupBy("tree_id", F.col("ancestor_id").alias("node_id"), "feature_id").agg(F.sum("w").alias("below"))
    other = below.select("tree_id", sister().alias("node_id"), "feature_id", F.col("below").alias("across")).where("node_id is not null")
    j = g.join(nodes.select(*KEY, "is_leaf"), KEY).join(below, [*KEY, "feature_id"], "left").join(other, [*KEY, "feature_id"], "left")
    own = F.col("gain") * F.col("gain") * F.col("n")
    share = ratio(own, own + F.coalesce("below", F.lit(0.0)) + F.coalesce("across", F.lit(0.0)))
    return j.select(*KEY, "feature_id", F.when(F.col("is_leaf"), F.col("gain")).otherwise(F.signum("gain") * share).alias("partial"))


def explained(stats: DataFrame) -> DataFrame:
    """(tree_id, feature_id, explained): squared mean gains summed over the nodes below the root."""
    g = additive_gains(stats, "mean").where("node_id > 1")
    return g.groupBy("tree_id", "feature_id").agg(F.sum(F.col("gain") * F.col("gain")).alias("explained"))


def absolute_partials(stats: DataFrame) -> DataFrame:
    g = additive_gains(stats, "mean")
    j = g.join(explained(stats), ["tree_id", "feature_id"], "left")
    value = F.signum("gain") * ratio(F.col("gain") * F.col("gain"), "explained")
    return j.select(*KEY, "feature_id", F.when(F.col("node_id") == 1, 0.0).otherwise(value).alias("partial"))


def composition(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree_id, node_id, cluster_id, fraction) of a node's samples; every cluster of a node that has samples of it."""
    j = member.join(labels, "sample_id").groupBy(*KEY, "cluster_id").agg(F.count(F.lit(1)).alias("k"))
    total = member.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return j.join(total, KEY).select(*KEY, "cluster_id", ratio("k", "n").alias("fraction"))
