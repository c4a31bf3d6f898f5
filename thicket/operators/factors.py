"""Factors: clusters of nodes, their samples and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation, ratio
from .navigate import ancestry, parent, sister
from .node_stats import beside

KEY = ["tree_id", "node_id"]


def factor_sizes(factor_nodes: DataFrame) -> DataFrame:
    return factor_nodes.groupBy("factor_id").agg(F.count(F.lit(1)).alias("size"))


def propagate(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels of some nodes -> every node's: its own or its nearest labelled ancestor's."""
    a = ancestry(nodes.select(*KEY)).join(labels.select("tree_id", F.col("node_id").alias("ancestor_id"), "factor_id"), ["tree_id", "ancestor_id"])
    return a.groupBy(*KEY).agg(F.min_by("factor_id", "distance").alias("factor_id"))


def external_labels(labels: DataFrame, nodes: DataFrame, roots: bool = False) -> DataFrame:
    """Given labels as factors; without labels for the roots these become factor 0 and the rest move up by one."""
    if roots:
        return labels.select("factor_id", *KEY)
    shifted = labels.where("node_id > 1").select((F.col("factor_id") + 1).alias("factor_id"), *KEY)
    return shifted.union(nodes.where("node_id = 1").select(F.lit(0).alias("factor_id"), *KEY))


def sisters(factor_nodes: DataFrame) -> DataFrame:
    return factor_nodes.where("node_id > 1").select("factor_id", "tree_id", sister().alias("node_id"))


def parents(factor_nodes: DataFrame) -> DataFrame:
    return factor_nodes.where("node_id > 1").select("factor_id", "tree_id", parent().alias("node_id"))


def children(factor_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """All nodes below the factor's nodes, as a bag."""
    a = ancestry(nodes.select(*KEY)).where("distance > 0")
    return factor_nodes.withColumnRenamed("node_id", "ancestor_id").join(a, ["tree_id", "ancestor_id"]).select("factor_id", *KEY)


def ancestors(factor_nodes: DataFrame) -> DataFrame:
    return factor_nodes.select("factor_id", "tree_id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2(F.col("node_id").cast("double")) + F.lit(1e-9)).cast("int")))).alias("d"), "node_id").where("node_id > 1").select("factor_id", "tree_id", F.call_function("shiftright", F.col("node_id"), F.col("d")).alias("node_id"))


def sample_counts(member: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """(factor_id, sample_id, count): how many of a factor's nodes hold a sample; absent means 0."""
    return member.join(factor_nodes, KEY).groupBy("factor_id", "sample_id").agg(F.count(F.lit(1)).alias("count"))


def _all(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    return samples.select("sample_id").crossJoin(F.broadcast(sizes))  # factors are few: the result's own size


def sample_scores(member: DataFrame, factor_nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """count / (nodes + 1) for every factor and sample."""
    j = _all(samples, factor_sizes(factor_nodes)).join(sample_counts(member, factor_nodes), ["factor_id", "sample_id"], "left")
    return j.select("factor_id", "sample_id", ratio(F.coalesce("count", F.lit(0)), F.col("size") + 1).alias("score"))


def parent_scores(member: DataFrame, factor_nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """The same over the nodes' parents; a factor of roots alone keeps its own nodes."""
    p = parents(factor_nodes)
    alone = factor_nodes.join(p.select("factor_id").distinct(), "factor_id", "left_anti").select("factor_id", *KEY)
    return sample_scores(member, p.union(alone), samples)


def sister_scores(member: DataFrame, factor_nodes: DataFrame, samples: DataFrame, log_prior: float | None = None) -> DataFrame:
    """(own - sister) / nodes, in [-1, 1]; with a prior, ln((own + prior) / (sister + prior))."""
    signed = factor_nodes.select("factor_id", *KEY, F.lit(1).alias("own"), F.lit(0).alias("other")).union(sisters(factor_nodes).select("factor_id", *KEY, F.lit(0), F.lit(1)))
    s = beside(member, signed, KEY).groupBy("factor_id", "sample_id").agg(F.sum("own").alias("own"), F.sum("other").alias("other"))
    j = _all(samples, factor_sizes(factor_nodes)).join(s, ["factor_id", "sample_id"], "left").fillna(0, ["own", "other"])
    value = ratio(F.col("own") - F.col("other"), "size") if log_prior is None else F.ln((F.col("own") + log_prior) / (F.col("other") + log_prior))
    return j.select("factor_id", "sample_id", value.alias("score"))


def factor_features(table: DataFrame, factor_nodes: DataFrame, value: str, features: list[int] | None = None) -> DataFrame:
    """Mean over a factor's nodes of a node statistic: (factor_id, feature_id, value)."""
    t = table if features is None else table.where(F.col("feature_id").isin(features))
    return t.join(factor_nodes, KEY).groupBy("factor_id", "feature_id").agg(F.avg(value).alias("value"))


def factor_levels(nodes: DataFrame, factor_nodes: DataFrame, pop: DataFrame) -> DataFrame:
    j = factor_nodes.join(nodes.select(*KEY, "level"), KEY).join(pop, KEY)
    return j.groupBy("factor_id").agg(F.avg("level").alias("mean_level"), F.avg("pop").alias("mean_population"))


def change(stats: DataFrame, group1: DataFrame, group2: DataFrame, how: str = "absolute") -> DataFrame:
    """Per factor and feature, mean of node means in group 2 against group 1: difference, or log2 ratio where finite."""
    m1 = factor_features(stats, group1, "mean").withColumnRenamed("value", "m1")
    m2 = factor_features(stats, group2, "mean").withColumnRenamed("value", "m2")
    j = m1.join(m2, ["factor_id", "feature_id"])
    if how == "absolute":
        return j.select("factor_id", "feature_id", (F.col("m2") - F.col("m1")).alias("change"))
    r = ratio("m2", "m1", None)
    return j.where(r > 0).select("factor_id", "feature_id", F.log2(r).alias("change"))


def root_nodes(factor_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every factor against all roots."""
    return factor_nodes.select("factor_id").distinct().crossJoin(F.broadcast(nodes.where("node_id = 1").select(*KEY)))


def changed(stats: DataFrame, factor_nodes: DataFrame, nodes: DataFrame, versus: str = "sister", how: str = "absolute") -> DataFrame:
    other = {"sister": sisters, "parent": parents}.get(versus)
    base = other(factor_nodes) if other else root_nodes(factor_nodes, nodes)
    return change(stats, base, factor_nodes, how)


def top_and_bottom(table: DataFrame, keys: list[str], value: str, n: int, tie: str = "feature_id") -> DataFrame:
    """The n lowest and n highest rows of each group."""
    low = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc(value), F.asc(tie)))
    high = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.desc(tie)))
    return table.withColumns({"__l": low, "__h": high}).where((F.col("__l") <= n) | (F.col("__h") <= n)).drop("__l", "__h")


def logistic_change(stats: DataFrame, group1: DataFrame, group2: DataFrame, c: float = 1.0) -> DataFrame:
    """Coefficients of a logistic regression that tells the two groups' node means apart: (feature_id, coefficient)."""
    from pyspark.ml.classification import LogisticRegression

    from ..functions.ml import coefficients, feature_vectors

    rows = stats.join(group1.select(*KEY).withColumn("label", F.lit(0.0)).union(group2.select(*KEY).withColumn("label", F.lit(1.0))), KEY)
    vec = feature_vectors(rows, [*KEY, "label"], "mean")
    return coefficients(vec, LogisticRegression(featuresCol="x", labelCol="label", regParam=1 / (c * max(1, vec.count())), elasticNetParam=0.0))


def coordinates(scores: DataFrame, points: DataFrame) -> DataFrame:
    """Mean coordinates of each factor, weighted by squared scores: points (sample_id, c0, c1)."""
    w = F.col("score") * F.col("score")
    return scores.join(points, "sample_id").groupBy("factor_id").agg(ratio(F.sum(w * F.col("c0")), F.sum(w)).alias("c0"), ratio(F.sum(w * F.col("c1")), F.sum(w)).alias("c1"))


def error_ratio(long: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(sum s(v - m_s)^2 + 1) / (sum p(v - m_p)^2 + 1) with score-weighted means m: (factor_id, feature_id, error_ratio)."""

    def spread(scores: DataFrame, name: str) -> DataFrame:
        s, v = F.col("score"), F.col("value")
        w = scores.where("score > 0").join(long, "sample_id").groupBy("factor_id", "feature_id").agg(F.sum(s).alias("w"), F.sum(s * v).alias("wv"), F.sum(s * v * v).alias("wvv"))
        return w.select("factor_id", "feature_id", (F.col("wvv") - ratio(F.col("wv") * F.col("wv"), "w")).alias(name))

    j = spread(own, "a").join(spread(other, "b"), ["factor_id", "feature_id"])
    return j.select("factor_id", "feature_id", ((F.col("a") + 1) / (F.col("b") + 1)).alias("error_ratio"))


def strict_errors(doublets: DataFrame, factor_nodes: DataFrame) -> DataFrame:
    """Sums of node doublets: raw errors, strict ratio and fraction unexplained per feature."""
    s = doublets.join(factor_nodes, KEY).groupBy("factor_id", "feature_id").agg(F.sum("own").alias("own"), F.sum("parent").alias("parent"))
    return s.select("factor_id", "feature_id", "own", "parent", ((F.col("own") + 1) / (F.col("parent") + 1)).alias("error_ratio"))


def local_correlations(member: DataFrame, factor_nodes: DataFrame, long: DataFrame, factor_id: int) -> DataFrame:
    """Correlations weighted by how many of the factor's nodes hold a sample: (i, j, r)."""
    counts = sample_counts(member, factor_nodes.where(F.col("factor_id") == factor_id)).select("sample_id", F.col("count").cast("double").alias("weight"))
    return correlation(long.join(counts, "sample_id"), weight="weight")


def local_against_global(local: DataFrame, overall: DataFrame, n: int | None = None, corrected: bool = True) -> DataFrame:
    """Pairs i < j by |(local - global) * local|, or by |local - global|: (i, j, local, overall, difference)."""
    j = local.select("i", "j", F.col("r").alias("local")).join(overall.select("i", "j", F.col("r").alias("overall")), ["i", "j"]).where("i < j")
    d = F.col("local") - F.col("overall")
    j = j.withColumn("difference", d * F.col("local") if corrected else d)
    return j if n is None else j.orderBy(F.desc(F.abs("difference")), "i", "j").limit(n)


def cluster_frequencies(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(factor_id, cluster_id, count) of a factor's sample counts."""
    return counts.join(labels, "sample_id").groupBy("factor_id", "cluster_id").agg(F.sum("count").alias("count"))


def linear_regression(scores: DataFrame, long: DataFrame, factor_id: int) -> DataFrame:
    """Weighted linear fit of a factor's scores on the features: (feature_id, coefficient)."""
    from pyspark.ml.regression import LinearRegression

    from ..functions.ml import coefficients, feature_vectors

    s = scores.where(F.col("factor_id") == factor_id).select("sample_id", F.col("score").alias("label"), F.abs("score").alias("weight")).where("weight > 0")
    # Both sides have rows of samples: neither may be gathered and sent, small as their files may look.
    return coefficients(feature_vectors(long.join(s.hint("merge"), "sample_id"), ["sample_id", "label", "weight"], "value"), LinearRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-6))


def top_split_features(scores: DataFrame, long: DataFrame, factor_id: int, n: int = 10) -> DataFrame:
    return linear_regression(scores, long, factor_id).orderBy(F.desc(F.abs("coefficient")), "feature_id").limit(n)


def summaries(levels: DataFrame, top: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """One JSON object per factor: level, population, most changed features, parent."""
    feats = top.groupBy("factor_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", F.round("change", 3).alias("change")))).alias("features"))
    j = levels.join(feats, "factor_id", "left")
    if tree is not None:
        j = j.join(tree.select("factor_id", "parent_factor_id"), "factor_id", "left")
    return j.select("factor_id", F.to_json(F.struct(*[c for c in j.columns])).alias("summary"))
