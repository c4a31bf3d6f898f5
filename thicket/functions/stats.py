"""Association, resampling and two-sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a, b, otherwise: float | None = 0.0) -> Column:
    """a / b, with a value for a zero divisor."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if otherwise is None else F.coalesce(out, F.lit(float(otherwise)))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each element occurs."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def stack_maps(df: DataFrame, column: str) -> DataFrame:
    """Maps of all rows -> one list of values per key (sorted, for a stable result)."""
    return df.select(F.explode(column)).groupBy("key").agg(F.sort_array(F.collect_list("value")).alias("values"))


def mutual_information(labels: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(a, b, n, information): n/N * ln(n*N / (n_a*n_b)) for every pair of classes; 0 where they do not meet."""
    total = labels.agg(F.count(F.lit(1)).alias("all"))
    pa = labels.groupBy(a).agg(F.count(F.lit(1)).alias("na"))
    pb = labels.groupBy(b).agg(F.count(F.lit(1)).alias("nb"))
    pairs = pa.crossJoin(pb).crossJoin(total)  # classes, not rows: as many as the result
    met = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(met, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inner = F.when(F.col("n") > 0, F.ln(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).otherwise(0.0)
    return joined.select(a, b, "n", (F.col("n") / F.col("all") * inner).alias("information"))


def pair_sums(long: DataFrame, sample: str = "sample_id", weight: str | None = None) -> DataFrame:
    """Weighted sums of all feature pairs i <= j from a long matrix: the pairs meet within a sample.

    Values are taken from their feature's mean, so that sums of squares keep their
    digits whatever the values' size; covariances do not change by it.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    means = long.groupBy("feature_id").agg(F.avg("value").alias("__m"))
    long = long.join(means, "feature_id").withColumn("value", F.col("value") - F.col("__m"))
    rows = long.groupBy(sample, *([weight] if weight else [])).agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("x"))
    pairs = rows.select(w.alias("w"), F.explode("x").alias("a"), "x").select("w", "a", F.explode(F.filter("x", lambda y: y["feature_id"] >= F.col("a.feature_id"))).alias("b"))
    x, y = F.col("a.value"), F.col("b.value")
    return pairs.groupBy(F.col("a.feature_id").alias("i"), F.col("b.feature_id").alias("j")).agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * x).alias("sx"), F.sum(F.col("w") * y).alias("sy"), F.sum(F.col("w") * x * x).alias("sxx"), F.sum(F.col("w") * y * y).alias("syy"), F.sum(F.col("w") * x * y).alias("sxy")
    )


def correlation(long: DataFrame, sample: str = "sample_id", weight: str | None = None) -> DataFrame:
    """(i, j, r): frequency-weighted Pearson correlation; 0 for a constant feature, 1 on the diagonal."""
    s = pair_sums(long, sample, weight)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("w")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("w"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("w")
    r = ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return s.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(r).alias("r"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns, 0 where undefined (``corr`` raises on a constant column)."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def jackknife_variance(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, estimate, variance: of the mean square when each value is left out in turn."""
    v2 = F.col(value) * F.col(value)
    sums = df.groupBy(*keys).agg(F.sum(v2).alias("__s"), F.count(F.lit(1)).alias("__n"))
    out = df.join(sums, keys) if keys else df.crossJoin(sums)
    out = out.withColumn("left_out", ratio(F.col("__s") - v2, F.col("__n") - 1))
    return out.groupBy(*keys).agg(F.avg("left_out").alias("estimate"), (F.var_pop("left_out") * (F.count(F.lit(1)) - 1)).alias("variance"))


def competition_rank(keys: list[str], value: str, highest: bool = False) -> Column:
    """Rank of a value in its group; equals share the lowest, or the highest, of their ranks."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) if highest else F.rank().over(w)


def average_rank(keys: list[str], value: str) -> Column:
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*keys, value)) - 1) / 2


def spearman(long: DataFrame, sample: str = "sample_id", highest: bool = True) -> DataFrame:
    """(i, j, r): Pearson correlation of the competition ranks of each feature."""
    return correlation(long.withColumn("value", competition_rank(["feature_id"], "value", highest).cast("double")), sample)


def value_counts(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Distinct values of each group with how often either side has them: what rank tests need."""
    return df.groupBy(*keys, value).agg(F.sum(F.when(F.col(side), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("b"))


def two_sample(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Per group: n_a, n_b, Mann-Whitney U of side a, its tie-corrected z, rank sum, and the Kolmogorov-Smirnov distance.

    Values are counted before ranks are taken, so the windows see each distinct
    value once.
    """
    counts = value_counts(df, keys, value, side)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = part.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    upto = part.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = counts.withColumns({"below_b": F.coalesce(F.sum("b").over(before), F.lit(0)), "ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto), "na": F.sum("a").over(part), "nb": F.sum("b").over(part)})
    gap = F.abs(ratio(F.col("ca"), F.col("na")) - ratio(F.col("cb"), F.col("nb")))
    k = F.col("a") + F.col("b")
    out = t.groupBy(*keys).agg(F.first("na").alias("n_a"), F.first("nb").alias("n_b"), F.sum(F.col("a") * (F.col("below_b") + F.col("b") / 2)).alias("u"), F.max(gap).alias("ks"), F.sum((k * k * k - k).cast("double")).alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    spread = F.sqrt(F.col("n_a") * F.col("n_b") / 12 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    return out.select(*keys, "n_a", "n_b", "u", (F.col("u") + F.col("n_a") * (F.col("n_a") + 1) / 2).alias("rank_sum"), ratio(F.col("u") - F.col("n_a") * F.col("n_b") / 2, spread).alias("z"), "ks")


def symmetric_kl(df: DataFrame, keys: list[str], value: str, side: str, bins: int = 100) -> DataFrame:
    """Symmetric Kullback-Leibler divergence of smoothed histograms of the two sides over [-1, 1).

    Edges go from -1 in steps of 2 / bins and the last edge stays below 1, so
    there are bins - 1 bins; values beyond them are dropped; every bin gets one
    more count.
    """
    width = 2 / bins
    b = F.floor((F.col(value) + 1) / F.lit(width) + F.lit(1e-9)).cast("int")
    last = (F.col(value) >= 1 - width - 1e-12) & (F.col(value) <= 1 - width + 1e-12)
    b = F.when(last, F.lit(bins - 2)).otherwise(b)
    counted = df.withColumn("bin", b).where((F.col("bin") >= 0) & (F.col("bin") <= bins - 2)).groupBy(*keys, "bin").agg(F.sum(F.when(F.col(side), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("b"))
    groups = df.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 2))).alias("bin"))
    full = grid.join(counted, [*keys, "bin"], "left").select(*keys, "bin", (F.coalesce("a", F.lit(0)) + 1).alias("a"), (F.coalesce("b", F.lit(0)) + 1).alias("b"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    p, q = F.col("a") / F.sum("a").over(part), F.col("b") / F.sum("b").over(part)
    return full.select(*keys, (p * F.ln(p / q) + q * F.ln(q / p)).alias("t")).groupBy(*keys).agg(F.sum("t").alias("symmetric_kl"))


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def ks_tail(d: float, n_a: int, n_b: int) -> float:
    """Asymptotic two-sided Kolmogorov tail."""
    if not n_a or not n_b or d <= 0:
        return 1.0
    t = d * math.sqrt(n_a * n_b / (n_a + n_b))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def t_density(t: float, dof: float) -> float:
    return math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + t * t / dof) ** (-(dof + 1) / 2)


def t_tail(t: float, dof: float) -> float:
    """Two-sided tail of Student's t, by the incomplete beta function's continued fraction."""
    x, a, b = dof / (dof + t * t), dof / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        a, b, x = b, a, 1 - x
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / (c if abs(c) > 1e-300 else 1e-300)
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    value = front * h / a
    return 1 - value if swap else value


def tails(df: DataFrame, z: str | None = None, ks: str | None = None) -> DataFrame:
    """Adds ``mwu_p`` and ``ks_p``.  One row per comparison comes here, so an Arrow function is fine."""
    import pandas as pd  # the functions below carry no annotations: names in them are not resolved lazily

    if z:
        normal = F.pandas_udf(lambda s: s.map(normal_tail), "double")
        df = df.withColumn("mwu_p", normal(F.col(z)))
    if ks:

        def tail(d, a, b):
            return pd.Series([ks_tail(*x) for x in zip(d, a, b)], dtype=float)

        df = df.withColumn("ks_p", F.pandas_udf(tail, "double")(F.col(ks), "n_a", "n_b"))
    return df
