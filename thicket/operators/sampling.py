"""Seeded draws from hashes: the same in every run and engine.

Only BIGINT arithmetic is used, so SQL engines agree.  ids combine tree and node
as ``tree * 2^20 + node``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = 2147483647
#: Samples in a bucket of the position index, about: only buckets that a draw falls into are sorted.
BUCKET = 2_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def scramble(id_, k, seed: int = 0) -> Column:
    """A number in [0, M) from an id and a draw number."""
    x = (_c(id_) * F.lit(7919).cast("long") + _c(k) * F.lit(104729).cast("long") + F.lit(seed * 1299709 + 1).cast("long")) % F.lit(M)
    x = (x * x + F.lit(48271).cast("long") * x + 11) % F.lit(M)
    return (x * x + F.lit(16807).cast("long") * x + 7) % F.lit(M)


def position(id_, k, n, seed: int = 0) -> Column:
    """A draw with replacement from 0..n-1."""
    return scramble(id_, k, seed) % _c(n)


def node_draws(active: DataFrame, size: int, seed: int) -> DataFrame:
    """active (tree_id, node_id, pop) -> (tree_id, node_id, draw_no, position): ``size`` positions with replacement."""
    rows = active.select("tree_id", "node_id", "pop", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias("draw_no"))
    id_ = F.col("tree_id").cast("long") * F.lit(1 << 20) + F.col("node_id")
    return rows.select("tree_id", "node_id", "draw_no", position(id_, F.col("draw_no"), F.col("pop"), seed).alias("position"))


def drawn_samples(member: DataFrame, draws: DataFrame, total: int) -> DataFrame:
    """(tree_id, node_id, draw_no, sample_id): the sample at each drawn position of its node.

    A node's samples are numbered bucket by bucket (buckets by hash of the
    sample): one small table of bucket sizes gives each bucket its first
    position, and only rows inside a bucket are ever sorted together.  Draws find
    their bucket by an equality join on cells of the position range, each bucket
    touching a few cells.
    """
    buckets = max(1, math.ceil(total / BUCKET))
    key = ["tree_id", "node_id"]
    held = member.select(*key, "sample_id", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).alias("bucket"))
    sizes = held.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    width = F.greatest(F.lit(1), F.ceil(F.sum("n").over(whole) / F.lit(buckets)))
    first = sizes.withColumns({"first": F.coalesce(F.sum("n").over(upto), F.lit(0)), "width": width})
    cells = first.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / F.col("width")), F.floor((F.col("first") + F.col("n") - 1) / F.col("width")))))
    asked = draws.join(first.groupBy(*key).agg(F.first("width").alias("w")), key).withColumn("cell", F.floor(F.col("position") / F.col("w")))
    wanted = asked.join(cells, [*key, "cell"]).where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n"))).select(*key, "bucket", "draw_no", (F.col("position") - F.col("first") + 1).alias("place"))
    place = F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("sample_id"))
    numbered = held.join(wanted.select(*key, "bucket").distinct(), [*key, "bucket"], "left_semi").withColumn("place", place)
    return numbered.join(wanted, [*key, "bucket", "place"]).select(*key, "draw_no", "sample_id")


def feature_pools(tree: int, node: int, width: int, seed: int, unsupervised: bool) -> tuple[list[int], list[int]]:
    """Input and output pools: all features, or disjoint halves in a seeded order when unsupervised."""
    if not unsupervised:
        return list(range(width)), list(range(width))
    order = sorted(range(width), key=lambda f: (scrambled(tree * (1 << 20) + node, 1_000_003 + f, seed), f))
    half = width // 2
    return order[:half], order[half:]


def scrambled(id_: int, k: int, seed: int = 0) -> int:
    x = (id_ * 7919 + k * 104729 + seed * 1299709 + 1) % M
    x = (x * x + 48271 * x + 11) % M
    return (x * x + 16807 * x + 7) % M


def feature_draws(pool: list[int], tree: int, node: int, n: int, seed: int, which: int) -> list[int]:
    """n features of a pool with replacement."""
    return [pool[scrambled(tree * (1 << 20) + node, (2 + which) * 10_000_019 + k, seed) % len(pool)] for k in range(n)] if pool else []


def weighted_choice(df: DataFrame, u: DataFrame, weight: str, order: str) -> DataFrame:
    """For each u in [0, 1): the row where the running share of weight passes it.  Rows are items of a short list."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    t = df.withColumns({"__hi": F.sum(weight).over(w) / F.sum(weight).over(whole)}).withColumn("__lo", F.coalesce(F.lag("__hi").over(Window.orderBy(order)), F.lit(0.0)))
    return u.join(t, (F.col("u") >= F.col("__lo")) & (F.col("u") < F.col("__hi"))).drop("__lo", "__hi")
