"""Clusters of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dispersion import median
from ..functions.stats import ratio

KEY = ["tree_id", "node_id"]


def cluster_features(long: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, feature_id, mean, median)."""
    return long.join(labels, "sample_id").groupBy("cluster_id", "feature_id").agg(F.avg("value").alias("mean"), median().alias("median"))


def feature_shift(long: DataFrame, labels: DataFrame, per_feature: bool = False) -> DataFrame:
    """A cluster's feature mean less the mean of the whole matrix, or of the feature."""
    means = cluster_features(long, labels).select("cluster_id", "feature_id", "mean")
    if per_feature:
        base = long.groupBy("feature_id").agg(F.avg("value").alias("base"))
        j = means.join(base, "feature_id")
    else:
        j = means.crossJoin(long.agg(F.avg("value").alias("base")))
    return j.select("cluster_id", "feature_id", (F.col("mean") - F.col("base")).alias("shift"))


def increased(shift: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy(F.desc("shift"), "feature_id")
    return shift.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def decreased(shift: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy(F.asc("shift"), "feature_id")
    return shift.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def logistic_features(long: DataFrame, labels: DataFrame, cluster_id: int, n: int = 50) -> DataFrame:
    """Features by the size of their coefficient in a logistic fit of membership on scaled values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    from ..functions.ml import feature_vectors

    rows = long.join(labels.select("sample_id", (F.col("cluster_id") == cluster_id).cast("double").alias("label")), "sample_id")
    vec = feature_vectors(rows, ["sample_id", "label"], "value")
    model = Pipeline(stages=[StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z", labelCol="label", regParam=1 / max(1, vec.count()))]).fit(vec)
    rows = [(i, float(c)) for i, c in enumerate(model.stages[-1].coefficients.toArray())]
    return vec.sparkSession.createDataFrame(rows, "feature_id int, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature_id").limit(n)


def leaf_counts(member: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, tree_id, node_id, count) over leaves."""
    leaf = member.join(nodes.where("is_leaf").select(*KEY), KEY, "left_semi")
    return leaf.join(labels, "sample_id").groupBy("cluster_id", *KEY).agg(F.count(F.lit(1)).alias("count"))


def leaf_cluster_frequencies(counts: DataFrame, leaf_labels: DataFrame) -> DataFrame:
    """(cluster_id, leaf_cluster, count)."""
    return counts.join(leaf_labels, KEY).groupBy("cluster_id", "leaf_cluster").agg(F.sum("count").alias("count"))


def by_leaf_cluster(member: DataFrame, leaf_labels: DataFrame) -> DataFrame:
    """Each sample's leaf cluster with the greatest share of its leaves holding it; the smaller id of equals."""
    size = leaf_labels.groupBy("leaf_cluster").agg(F.count(F.lit(1)).alias("size"))
    hit = member.join(leaf_labels, KEY).groupBy("sample_id", "leaf_cluster").agg(F.count(F.lit(1)).alias("k")).join(size, "leaf_cluster")
    share = ratio("k", "size")
    return hit.groupBy("sample_id").agg(F.max_by("leaf_cluster", F.struct(share, -F.col("leaf_cluster"))).alias("cluster_id"))


def by_factor(counts: DataFrame, leaf_factors: DataFrame) -> DataFrame:
    """Each sample's leaf factor of the consensus tree with the highest count."""
    hit = counts.join(leaf_factors.select("factor_id"), "factor_id", "left_semi")
    return hit.groupBy("sample_id").agg(F.max_by("factor_id", F.struct("count", -F.col("factor_id"))).alias("factor_id"))
