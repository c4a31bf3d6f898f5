"""The forest: tables of a trained model and the questions they answer."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import community, compare, consensus, factors, knn, matrix, navigate, node_stats, predict, represent, routing, samples
from .operators.trainer import Parameters, grow

KEY = ["tree_id", "node_id"]
#: Samples beyond which node medians are not left to one task per node.
LARGE = 20_000_000


def _matrix(spark: SparkSession, data) -> DataFrame:
    """A wide DataFrame, or a NumPy array or nested list of rows."""
    if isinstance(data, DataFrame):
        return data if {"sample_id", "x"} <= set(data.columns) else matrix.wide(data, data.columns[0], data.columns[1:])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>")


def fit(spark: SparkSession, inputs, outputs=None, header: list[str] | None = None, **options) -> Forest:
    """Trains a forest.  Without outputs the inputs are judged too and the forest is unsupervised."""
    if outputs is None:
        options.setdefault("unsupervised", True)
    p = Parameters.of(**options)
    x = _matrix(spark, inputs)
    y = None if outputs is None else _matrix(spark, outputs)
    width = matrix.validate(x)
    out_width = width if y is None else matrix.validate(y)
    nodes, _ = grow(x, y, p)
    names = matrix.name_features(header if y is None or (header and len(header) == out_width) else None, out_width)
    return Forest(nodes, x, x if y is None else y, names)


class Forest:
    """nodes, the wide input and output matrices, and names of the output features."""

    def __init__(self, nodes: DataFrame, inputs: DataFrame, outputs: DataFrame, names: list[str] | None = None, factor_nodes: DataFrame | None = None):
        self.spark = nodes.sparkSession
        self.node_table, self.inputs, self.outputs = nodes, inputs, outputs
        self.names = names
        self.factor_nodes = factor_nodes
        self.sample_labels: DataFrame | None = None
        self.leaf_labels: DataFrame | None = None
        self.tree: DataFrame | None = None
        #: (sample_id, name), if samples are named.
        self.sample_names: DataFrame | None = None
        #: Names that were given to factors and sample clusters, by id.
        self.factor_names: dict[int, str] = {}
        self.cluster_names: dict[int, str] = {}

    # -- tables ------------------------------------------------------------------------------------------------------

    @cached_property
    def trees(self) -> list[int]:
        return sorted(r.tree_id for r in self.node_table.select("tree_id").distinct().collect())

    @cached_property
    def routed(self) -> DataFrame:
        """(sample_id, x, leaves) with x the outputs."""
        r = routing.route(self.inputs, self.node_table)
        return r if self.inputs is self.outputs else r.select("sample_id", "leaves").join(self.outputs.select("sample_id", "x"), "sample_id")

    @cached_property
    def member(self) -> DataFrame:
        return routing.visits(self.routed, self.trees)

    @cached_property
    def values(self) -> DataFrame:
        return node_stats.node_values(self.routed, self.trees)

    @cached_property
    def stats(self) -> DataFrame:
        large = self.outputs.count() > LARGE
        return node_stats.node_stats(self.values, large).persist()

    @cached_property
    def long(self) -> DataFrame:
        return matrix.to_long(self.outputs)

    @property
    def samples(self) -> DataFrame:
        return self.outputs.select("sample_id")

    @property
    def features(self) -> DataFrame:
        width = len(self.names) if self.names else self.outputs.select(F.max(F.size("x"))).first()[0]
        return self.spark.createDataFrame([(i, self.names[i] if self.names else str(i)) for i in range(width)], "feature_id int, name string")

    def reset_cache(self) -> None:
        if "stats" in self.__dict__:
            self.stats.unpersist()
        for k in ("stats", "values", "member", "routed", "long"):
            self.__dict__.pop(k, None)

    # -- names and labels --------------------------------------------------------------------------------------------

    def set_sample_names(self, names: DataFrame) -> None:
        """names: (sample_id, name); samples without one are called by their id."""
        self.sample_names = names.select("sample_id", "name")

    def named_samples(self, nodes: DataFrame | None = None) -> DataFrame:
        """(sample_id, name) of all samples, or (tree_id, node_id, sample_id, name) of those in some nodes."""
        own = self.samples if nodes is None else self.member.join(nodes.select(*KEY), KEY, "left_semi")
        if self.sample_names is None:
            return own.withColumn("name", F.col("sample_id").cast("string"))
        return own.join(self.sample_names, "sample_id", "left").select(*own.columns, F.coalesce("name", F.col("sample_id").cast("string")).alias("name"))

    def set_factor_name(self, factor_id: int, name: str) -> None:
        self.factor_names[factor_id] = name

    def set_cluster_name(self, cluster_id: int, name: str) -> None:
        self.cluster_names[cluster_id] = name

    def _named(self, ids: DataFrame, column: str, names: dict[int, str]) -> DataFrame:
        given = self.spark.createDataFrame(list(names.items()), f"{column} int, name string")
        found = ids.select(F.col(column).cast("int").alias(column)).distinct()
        return found.join(given, column, "left").select(column, F.coalesce("name", F.col(column).cast("string")).alias("name"))

    def named_factors(self) -> DataFrame:
        """(factor_id, name): the given names, else the ids."""
        return self._named(self.factor_nodes, "factor_id", self.factor_names)

    def named_clusters(self) -> DataFrame:
        """(cluster_id, name) of sample clusters."""
        return self._named(self.sample_labels, "cluster_id", self.cluster_names)

    def reset_split_clusters(self) -> None:
        """Factors, their tree and their names go."""
        self.factor_nodes, self.tree, self.factor_names = None, None, {}

    def reset_sample_clusters(self) -> None:
        self.sample_labels, self.cluster_names = None, {}

    def reset_leaf_clusters(self) -> None:
        self.leaf_labels = None

    # -- navigation --------------------------------------------------------------------------------------------------

    def nodes(self, root: bool = True, depth: int | None = None) -> DataFrame:
        return navigate.nodes(self.node_table, root, depth)

    def leaves(self, depth: int | None = None) -> DataFrame:
        return navigate.leaves(self.node_table, depth)

    def stems(self, depth: int | None = None) -> DataFrame:
        return navigate.stems(self.node_table, depth)

    def level(self, target: int) -> DataFrame:
        return navigate.at_level(self.node_table, target)

    def roots(self) -> DataFrame:
        return navigate.roots(self.node_table)

    def summary(self) -> DataFrame:
        return navigate.summary(self.node_table)

    def derive_samples(self, chosen: DataFrame) -> Forest:
        nodes, _ = routing.restrict(self.member, self.node_table, chosen)
        keep = lambda w: w.join(chosen.select("sample_id"), "sample_id", "left_semi")
        x = keep(self.inputs)
        return Forest(nodes, x, x if self.inputs is self.outputs else keep(self.outputs), self.names)

    def trim(self, limit: float) -> Forest:
        nodes, _ = routing.trim(self.member, self.node_table, node_stats.determination(self.stats), limit)
        return Forest(nodes, self.inputs, self.outputs, self.names)

    # -- features ----------------------------------------------------------------------------------------------------

    def add_output_feature(self, name: str, column: DataFrame, value: str) -> Forest:
        if name in (self.names or []):
            raise ValueError(f"there is a feature {name!r}")
        names = None if self.names is None else [*self.names, name]
        return Forest(self.node_table, self.inputs, matrix.add_feature(self.outputs, column, value), names, self.factor_nodes)

    def remove_output_feature(self, name: str) -> Forest:
        at = self.names.index(name)
        return Forest(self.node_table, self.inputs, matrix.remove_feature(self.outputs, at), [n for n in self.names if n != name], self.factor_nodes)

    # -- representations and factors ---------------------------------------------------------------------------------

    def node_representation(self, mode: str = "additive_mean", pca: int = 0) -> DataFrame:
        rep = represent.representation(mode, self.stats, self.node_table, self.member, self.factor_nodes)
        return represent.pca(represent.vectors(rep), pca) if pca else rep

    def interpret_splits(self, mode: str = "partial", metric: str = "cosine", pca: int = 0, relatives: bool = True, resolution: float = 1.0, k: int = 10, depth: int | None = None, seed: int = 0, method: str = "louvain") -> DataFrame:
        """Clusters similar splits into factors (roots are factor 0) and spans them by a tree."""
        chosen = navigate.nodes(self.node_table, False, depth).select(*KEY)
        vec = represent.vectors(represent.representation(mode, self.stats, self.node_table, self.member))
        vec = represent.pca(vec, pca) if pca else vec
        id_ = F.col("tree_id").cast("long") * F.lit(1 << 32) + F.col("node_id")
        points = vec.join(chosen, KEY).select(id_.alias("id"), "v")
        if relatives:
            other = vec.where("node_id > 1").select((F.col("tree_id").cast("long") * F.lit(1 << 32) + navigate.sister()).alias("id"), F.col("v").alias("v2"))
            points = points.join(other, "id")
        points = points.persist()
        n = points.count()
        near = knn.knn(points, max(1, min(k, n - 1)), metric)
        labels = community.communities(near.select(F.col("id").alias("src"), F.col("neighbour").alias("dst")), points.select("id"), resolution, seed, method)
        found = labels.select((F.col("label") + 1).cast("int").alias("factor_id"), F.shiftright("id", 32).cast("int").alias("tree_id"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).alias("node_id"))
        roots = self.roots().select(F.lit(0).alias("factor_id"), *KEY)
        direct = found.union(roots)
        spread = factors.propagate(direct, self.node_table)
        self.factor_nodes = spread.select("factor_id", *KEY).persist()
        points.unpersist()
        self.tree = self.maximum_spanning_tree()
        return self.factor_nodes

    def external_split_labels(self, labels: DataFrame, roots: bool = False) -> DataFrame:
        self.factor_nodes = factors.external_labels(labels, self.node_table, roots)
        return self.factor_nodes

    def factor_matrix(self) -> DataFrame:
        return factors.sister_scores(self.member, self.factor_nodes, self.samples)

    def maximum_spanning_tree(self, mode: str = "samples") -> DataFrame:
        own = parents = trans = odds = dep = feats = None
        if mode == "samples":
            own = factors.sample_scores(self.member, self.factor_nodes, self.samples)
            parents = factors.parent_scores(self.member, self.factor_nodes, self.samples)
        elif mode == "transitions":
            trans = consensus.transitions(self.factor_nodes, self.node_table)
        elif mode == "odds":
            odds = consensus.odds_ratios(self.factor_nodes, self.node_table)
        elif mode == "dependence":
            dep = consensus.partial_dependence(self.factor_matrix())
        elif mode == "means":
            feats = factors.factor_features(self.stats, self.factor_nodes, "mean")
        return consensus.maximum_spanning_tree(consensus.weights_of(mode, trans, odds, dep, feats, own, parents))

    def most_likely_tree(self) -> DataFrame:
        return consensus.most_likely_tree(consensus.transitions(self.factor_nodes, self.node_table))

    def report(self, n: int = 10, path: str | None = None) -> DataFrame:
        """One JSON object per factor: level, population, the n most changed features each way, parent; written as text if a path is given."""
        levels = factors.factor_levels(self.node_table, self.factor_nodes, navigate.populations(self.member))
        top = factors.top_and_bottom(factors.changed(self.stats, self.factor_nodes, self.node_table), ["factor_id"], "change", n)
        out = factors.summaries(levels, top, self.tree)
        if path:
            out.select("summary").write.mode("overwrite").text(path)
        return out

    # -- sample clusters ---------------------------------------------------------------------------------------------

    def cluster_samples_simple(self, k: int = 10, pca: int = 0, metric: str = "cosine", resolution: float = 1.0, seed: int = 0, method: str = "louvain") -> DataFrame:
        """Communities of the samples' nearest neighbours on the outputs."""
        return self._cluster(self.outputs.select(F.col("sample_id").alias("id"), F.col("x").alias("v")), k, metric, resolution, seed, method)

    def cluster_samples_encoding(self, k: int = 10, metric: str = "cosine", resolution: float = 1.0, seed: int = 0, method: str = "louvain") -> DataFrame:
        """The same on the samples' leaves as indicator vectors."""
        place = F.row_number().over(Window.orderBy(*KEY)) - 1  # the model's leaves, not rows of data
        leaf = self.leaves().select(*KEY, place.alias("place"))
        width = leaf.count()
        at = self.member.join(leaf, KEY).groupBy("sample_id").agg(F.array_sort(F.collect_set("place")).alias("hot"))
        # One pass over the places a sample has: zeros up to the next one, a one, and zeros to the end.
        ones = F.transform(F.col("hot"), lambda p, i: F.concat(F.array_repeat(F.lit(0.0), p - F.when(i > 0, F.get("hot", i - 1) + 1).otherwise(0)), F.array(F.lit(1.0))))
        v = F.concat(F.flatten(ones), F.array_repeat(F.lit(0.0), F.lit(width) - F.element_at("hot", -1) - 1))
        return self._cluster(at.select(F.col("sample_id").alias("id"), v.alias("v")), k, metric, resolution, seed, method)

    def _cluster(self, points, k, metric, resolution, seed, method):
        points = points.persist()
        near = knn.knn(points, max(1, min(k, points.count() - 1)), metric)
        found = community.communities(near.select(F.col("id").alias("src"), F.col("neighbour").alias("dst")), points.select("id"), resolution, seed, method)
        self.sample_labels = found.select(F.col("id").alias("sample_id"), F.col("label").alias("cluster_id"))
        points.unpersist()
        return self.sample_labels

    def set_sample_labels(self, labels: DataFrame) -> None:
        self.sample_labels = labels

    def set_leaf_labels(self, labels: DataFrame) -> None:
        self.leaf_labels = labels

    def cluster_samples_leaf_cluster(self) -> DataFrame:
        return samples.by_leaf_cluster(self.member, self.leaf_labels)

    def cluster_samples_by_split_clusters(self) -> DataFrame:
        return samples.by_factor(factors.sample_counts(self.member, self.factor_nodes), consensus.tree_leaves(self.tree))

    # -- prediction --------------------------------------------------------------------------------------------------

    def predict(self, data) -> Prediction:
        return Prediction(self, _matrix(self.spark, data))

    def coordinates(self, points: DataFrame | None = None) -> DataFrame:
        """Scaled coordinates (sample_id, c0, c1): given ones, or two principal components."""
        if points is None:
            vec = self.outputs.select(F.lit(0).alias("tree_id"), F.col("sample_id").alias("node_id"), F.col("x").alias("v"))
            points = represent.pca(vec, 2).select(F.col("node_id").alias("sample_id"), F.col("v")[0].alias("c0"), F.get("v", F.lit(1)).alias("c1"))
        s = points.agg(*[f(c).alias(f"{n}{c}") for c in ("c0", "c1") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scaled = [((F.col(c) - F.lit(s[f"m{c}"])) / F.lit(s[f"s{c}"] or 1.0)).alias(c) for c in ("c0", "c1")]
        return points.select("sample_id", *scaled)

    # -- storage -----------------------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        self.node_table.write.mode("overwrite").parquet(f"{path}/nodes")
        self.inputs.write.mode("overwrite").parquet(f"{path}/inputs")
        self.outputs.write.mode("overwrite").parquet(f"{path}/outputs")
        self.features.write.mode("overwrite").parquet(f"{path}/features")
        if self.factor_nodes is not None:
            self.factor_nodes.write.mode("overwrite").parquet(f"{path}/factor_nodes")
        if self.sample_names is not None:
            self.sample_names.write.mode("overwrite").parquet(f"{path}/sample_names")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        read = lambda n: spark.read.parquet(f"{path}/{n}")

        def optional(n):
            try:
                return read(n)
            except AnalysisException:  # saved without such a table
                return None

        names = [r.name for r in read("features").orderBy("feature_id").collect()]
        out = cls(read("nodes"), read("inputs"), read("outputs"), names, optional("factor_nodes"))
        out.sample_names = optional("sample_names")
        return out


class Prediction:
    """A forest applied to new data."""

    def __init__(self, forest: Forest, data: DataFrame):
        self.forest, self.data = forest, data

    @cached_property
    def routed(self) -> DataFrame:
        return routing.route(self.data, self.forest.node_table)

    @cached_property
    def member(self) -> DataFrame:
        return routing.visits(self.routed, self.forest.trees)

    @cached_property
    def values(self) -> DataFrame:
        return node_stats.node_values(self.routed, self.forest.trees)

    def node_sample_encoding(self, leaves: bool = False, depth: int | None = None) -> DataFrame:
        return routing.encoding(self.member, self.forest.node_table, leaves, depth)

    def prediction(self, mode: str = "additive_mean") -> DataFrame:
        return predict.predict(self.routed, self.forest.trees, predict.leaf_vectors(self.forest.stats, self.forest.node_table, mode))

    def residuals(self, truth: DataFrame | None = None, mode: str = "additive_mean") -> DataFrame:
        return predict.residuals(matrix.to_long(self.data if truth is None else truth), self.prediction(mode))

    def report(self, truth: DataFrame | None = None, mode: str = "additive_mean") -> DataFrame:
        return predict.report(self.residuals(truth, mode))

    def feature_errors(self, truth: DataFrame | None = None, mode: str = "additive_mean") -> DataFrame:
        return predict.feature_errors(self.residuals(truth, mode))

    def node_errors(self) -> DataFrame:
        return predict.node_feature_errors(self.values, self.forest.stats)

    def factor_matrix(self) -> DataFrame:
        """Sister scores on the new data; factor 0 is 1 everywhere."""
        s = factors.sister_scores(self.member, self.forest.factor_nodes, self.data.select("sample_id"))
        return s.withColumn("score", F.when(F.col("factor_id") == 0, 1.0).otherwise(F.col("score")))

    def sample_clusters(self) -> DataFrame:
        mix = node_stats.composition(self.forest.member, self.forest.sample_labels)
        return predict.sample_clusters(self.member, self.forest.node_table, mix)

    def compare_factors(self, other: Prediction, bins: int = 100) -> DataFrame:
        per_node = lambda p: p.node_errors().groupBy(*KEY).agg(F.sum("own").alias("own"), F.sum("parent").alias("parent"))
        return compare.all_factors(self.factor_matrix(), other.factor_matrix(), per_node(self), per_node(other), self.forest.factor_nodes, bins)

    def compare_features(self, other: Prediction) -> DataFrame:
        return compare.feature_residuals(self.residuals(), other.residuals())

    def compare_sample_clusters(self, other: Prediction) -> DataFrame:
        return compare.cluster_frequencies(self.sample_clusters(), other.sample_clusters())
