"""Exact medians of groups too large for one task.

``percentile`` holds the distinct values of a group in memory.  Here a group's
middle is enclosed instead: approximate quantiles a little below and above the
middle give a bracket, a counting pass tells how many values lie under it, and
only the bracket is looked at next, until it fits.  Every pass is one aggregation
with partial sums; what is joined back is one row per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a group that may be sorted in one task.
FITS = 1_000_000
#: Accuracy of the approximate quantiles that make the brackets.
ACCURACY = 2000


def exact_medians(df: DataFrame, keys: list[str], value: str = "value", fits: int = FITS, rounds: int = 12) -> DataFrame:
    """(keys, median).  Null values do not count; groups without values have a null median."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    # Ranks of the two middle values among the rows still looked at.
    want = size.select(*keys, "__n", ((F.col("__n") + 1) / 2).cast("long").alias("__a"), (F.floor(F.col("__n") / 2) + 1).alias("__b"), F.lit(float("-inf")).alias("__lo"), F.lit(float("inf")).alias("__hi"))
    for _ in range(rounds):
        want = want.persist()
        large = want.where(F.col("__n") > fits)
        if large.isEmpty():
            break
        inside = rows.join(large, keys).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
        share = F.least(F.lit(0.9), F.greatest(F.lit(0.1), F.col("__a") / F.col("__n")))
        cut = inside.groupBy(*keys).agg(F.first(share).alias("__s"), F.percentile_approx("__v", [i / 200 for i in range(1, 200)], ACCURACY).alias("__q"))
        step = F.floor(F.col("__s") * 200).cast("int")
        cut = cut.select(*keys, F.get("__q", F.greatest(F.lit(0), step - 3)).alias("__l"), F.get("__q", F.least(F.lit(198), step + 2)).alias("__h"))
        count = inside.join(cut, keys).groupBy(*keys).agg(F.sum((F.col("__v") < F.col("__l")).cast("long")).alias("__below"), F.sum(F.col("__v").between(F.col("__l"), F.col("__h")).cast("long")).alias("__in"), F.first("__l").alias("__l"), F.first("__h").alias("__h"))
        j = want.join(count, keys, "left")
        ok = F.col("__in").isNotNull() & (F.col("__a") > F.col("__below")) & (F.col("__b") <= F.col("__below") + F.col("__in")) & (F.col("__in") < F.col("__n"))
        pick = lambda new, old: F.when(ok, new).otherwise(F.col(old)).alias(old)
        nxt = j.select(*keys, pick(F.col("__in"), "__n"), pick(F.col("__a") - F.col("__below"), "__a"), pick(F.col("__b") - F.col("__below"), "__b"), pick(F.col("__l"), "__lo"), pick(F.col("__h"), "__hi"), ok.alias("__ok")).persist()
        moved = not nxt.where("__ok").isEmpty()
        want = nxt.drop("__ok")
        if not moved:  # the rest is one value over and over, or cannot be cut
            break
    inside = rows.join(want, keys).where((F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
    # Equal values are counted, so a bracket of one value is one row.
    kinds = inside.groupBy(*keys, "__v", "__a", "__b").agg(F.count(F.lit(1)).alias("__k"))
    upto = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = kinds.withColumn("__u", F.sum("__k").over(upto))
    hit = lambda r: F.max(F.when((F.col("__u") >= F.col(r)) & (F.col("__u") - F.col("__k") < F.col(r)), F.col("__v")))
    middle = ranked.groupBy(*keys).agg(((hit("__a") + hit("__b")) / 2).alias("median"))
    return df.select(*keys).distinct().join(middle, keys, "left")
