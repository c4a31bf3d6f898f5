"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction.  Large: neighbours above u go to u's minimum; small: those below u, and u."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``(u, v)`` edges over any orderable key -> ``(u, root)``, root the smallest key reachable.

    Only nodes that are not their own root have a row.  Each round is written to
    the shared folder, so lineage stays short; nothing is collected but two
    numbers a round.  A hub's rows meet in joins that adaptive execution may
    split, and minima are taken before the shuffle.
    """
    now = ws.save(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    seen, k = None, 0
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    here = mark(now)
    while here[0] and here != seen:
        k += 1
        nxt = ws.save(_stars(_stars(now, True), False), f"{name}{k}")
        seen, here = here, mark(nxt)
        ws.drop(f"{name}{k - 1}")
        now = nxt
    return now.select("u", F.col("v").alias("root"))
