"""Tree navigation as arithmetic on heap numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parent(node="node_id") -> Column:
    return F.shiftright(_c(node), 1)


def sister(node="node_id") -> Column:
    """The other child of the parent; null for the root."""
    return F.when(_c(node) > 1, _c(node).bitwiseXOR(F.lit(1)))


def level(node="node_id") -> Column:
    return F.floor(F.log2(_c(node).cast("double")) + F.lit(1e-9)).cast("int")


def is_under(node: Column, ancestor: Column) -> Column:
    """Whether a node is the ancestor or below it."""
    return F.call_function("shiftright", node, F.greatest(level(node) - level(ancestor), F.lit(0))) == ancestor


def nodes(n: DataFrame, root: bool = True, depth: int | None = None) -> DataFrame:
    out = n if root else n.where("level > 0")
    return out if depth is None else out.where(F.col("level") <= depth)


def leaves(n: DataFrame, depth: int | None = None) -> DataFrame:
    """Leaves; with a depth, nodes of that level count as leaves and deeper ones go."""
    return n.where("is_leaf") if depth is None else n.where((F.col("level") == depth) | (F.col("is_leaf") & (F.col("level") < depth)))


def stems(n: DataFrame, depth: int | None = None) -> DataFrame:
    out = n.where("level > 0 and not is_leaf")
    return out if depth is None else out.where(F.col("level") <= depth)


def at_level(n: DataFrame, target: int) -> DataFrame:
    return n.where(F.col("level") == target)


def roots(n: DataFrame) -> DataFrame:
    return n.where("node_id = 1")


def ancestry(n: DataFrame) -> DataFrame:
    """(tree_id, node_id, ancestor_id, distance), each node being its own ancestor at distance 0."""
    lev = level("node_id")
    steps = n.select("tree_id", "node_id", F.explode(F.sequence(F.lit(0), lev)).alias("distance"))
    return steps.select("tree_id", "node_id", F.call_function("shiftright", F.col("node_id"), F.col("distance")).alias("ancestor_id"), "distance")


def descendants(n: DataFrame) -> DataFrame:
    """(tree_id, node_id, descendant_id), the node itself excluded."""
    return ancestry(n).where("distance > 0").select("tree_id", F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("descendant_id"))


def descend(n: DataFrame, by: int) -> DataFrame:
    """The frontier so many levels below every node, shallower leaves included: (tree_id, node_id, frontier_id)."""
    a = ancestry(n.select("tree_id", "node_id")).join(n.select("tree_id", "node_id", "is_leaf"), ["tree_id", "node_id"])
    return a.where((F.col("distance") == by) | (F.col("is_leaf") & (F.col("distance") < by))).select("tree_id", F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("frontier_id"))


def by_level(n: DataFrame) -> DataFrame:
    """(tree_id, level, node_ids): the level lists below the root."""
    return n.groupBy("tree_id", "level").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))


def depths(n: DataFrame) -> DataFrame:
    """(tree_id, node_id, depth): levels below each node."""
    return ancestry(n).groupBy("tree_id", F.col("ancestor_id").alias("node_id")).agg(F.max("distance").alias("depth"))


def populations(member: DataFrame) -> DataFrame:
    return member.groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("pop"))


def sample_lists(member: DataFrame, n: DataFrame) -> DataFrame:
    """Sorted samples of each leaf; inner nodes are unions of their leaves."""
    kept = member.join(n.where("is_leaf").select("tree_id", "node_id"), ["tree_id", "node_id"], "left_semi")
    return kept.groupBy("tree_id", "node_id").agg(F.sort_array(F.collect_list("sample_id")).alias("samples"))


def number(n: DataFrame) -> DataFrame:
    """node_index: children's subtrees first, the root of a tree last.

    The order is that of a walk that visits each node's two subtrees, then its
    two children, and the root at the end.
    """
    lev = level("node_id")
    # Bits of the path; the pair of children of a node follows everything below them.
    steps = F.transform(F.sequence(F.lit(1), lev), lambda k: F.call_function("shiftright", F.col("node_id"), lev - k).bitwiseAND(F.lit(1)))
    key = F.when(lev == 0, F.array(F.lit(9))).otherwise(F.concat(F.slice(steps, F.lit(1), F.greatest(lev - 1, F.lit(0))), F.array(F.lit(5).cast("long"), F.element_at(steps, -1).cast("long"))))
    return n.withColumn("node_index", F.row_number().over(Window.orderBy("tree_id", key)) - 1)


def summary(n: DataFrame) -> DataFrame:
    return n.groupBy("tree_id").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("is_leaf").cast("int")).alias("leaves"), F.max("level").alias("depth"))


def width_shares(pop: DataFrame) -> DataFrame:
    """Each node's share of its parent's children's samples; 1 for the root."""
    both = pop.where("node_id > 1").groupBy("tree_id", parent().alias("up")).agg(F.sum("pop").alias("all"))
    joined = pop.withColumn("up", parent()).join(both, ["tree_id", "up"], "left")
    return joined.select("tree_id", "node_id", F.coalesce(F.try_divide(F.col("pop").cast("double"), F.col("all").cast("double")), F.lit(1.0)).alias("share"))


def unrepresented(samples: DataFrame, member: DataFrame) -> DataFrame:
    """Samples that are in no leaf of any tree."""
    return samples.join(member.select("sample_id").distinct(), "sample_id", "left_anti")
