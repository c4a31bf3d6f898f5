"""Order statistics and dispersion of the values of each group.

Medians of even-length groups are the mean of the two middle values.  The modes:

=========  =====================================================================
var        population variance
sse        sum of squared distances to the mean
mad        median of absolute distances to the median (0 below two values)
ssme       sum of squared distances to the median, in closed form
sme        sum of absolute distances to the median
entropy    n * sum p*log2(p) over three zones (no minus sign, so never above 0)
=========  =====================================================================
"""

from __future__ import annotations

from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import Frames


class Dispersion(str, Enum):
    VAR = "var"
    SSE = "sse"
    MAD = "mad"
    SSME = "ssme"
    SME = "sme"
    ENTROPY = "entropy"

    @classmethod
    def parse(cls, name: str) -> Dispersion:
        name = {"variance": "var"}.get(name.lower(), name.lower())
        if name in ("mix", "mixed"):
            raise ValueError("the mixed mode has no definition")
        return cls(name)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def median(value="value") -> Column:
    """Exact median; legal in ordered window frames, unlike ``median``."""
    return F.percentile(_c(value), F.lit(0.5))


def moments(value="value") -> dict[str, Column]:
    """The aggregates from which most modes follow without a second pass."""
    v = _c(value)
    return {"n": F.count(v), "total": F.sum(v), "squares": F.sum(v * v), "mean": F.avg(v), "variance": F.var_pop(v), "median": median(v)}


def aggregate_modes(value="value") -> dict[Dispersion, Column]:
    """Modes that one aggregation gives."""
    v = _c(value)
    m = median(v)
    return {Dispersion.VAR: F.var_pop(v), Dispersion.SSE: F.var_pop(v) * F.count(v), Dispersion.SSME: F.count(v) * m * m - 2 * m * F.sum(v) + F.sum(v * v)}


def centred(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """df with the group's ``median`` beside each value; the group table is joined, not a window."""
    return df.join(df.groupBy(*keys).agg(median(value).alias("median")), keys)


def zones(df: DataFrame, keys: list[str], value: str = "value", order: str | None = None) -> DataFrame:
    """Zone of each value: the k values farthest from the median are far left or far right, the rest centre.

    k = max(n // 2, 1) - (1 - n % 2); of equal distances the smaller value goes first.
    """
    rank = Window.partitionBy(*keys).orderBy(value, *([order] if order else []))
    far = Window.partitionBy(*keys).orderBy(F.desc("distance"), F.asc(value), *([order] if order else []))
    placed = centred(df, keys, value).withColumns({"distance": F.abs(F.col(value) - F.col("median")), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    placed = placed.withColumns({"rank": F.row_number().over(rank), "far": F.row_number().over(far)})
    k = F.greatest(F.floor(F.col("n") / 2), F.lit(1)) - (1 - F.col("n") % 2)
    side = F.when(F.col("rank") * 2 <= F.col("n"), "left").otherwise("right")
    return placed.withColumn("zone", F.when(F.col("far") <= k, side).otherwise("centre")).drop("rank", "far", "distance")


def dispersions(df: DataFrame, keys: list[str], mode: str | Dispersion, value: str = "value", order: str | None = None) -> DataFrame:
    """keys, n, median, dispersion."""
    mode = Dispersion.parse(mode) if isinstance(mode, str) else mode
    simple = aggregate_modes(value)
    if mode in simple:
        return df.groupBy(*keys).agg(F.count(value).alias("n"), median(value).alias("median"), simple[mode].alias("dispersion"))
    if mode is Dispersion.ENTROPY:
        counted = zones(df, keys, value, order).groupBy(*keys, "zone", "n", "median").agg(F.count(F.lit(1)).alias("k"))
        p = F.col("k") / F.col("n")
        return counted.groupBy(*keys, "n", "median").agg(F.when(F.col("n") < 2, 0.0).otherwise(F.col("n") * F.sum(p * F.log2(p))).alias("dispersion"))
    far = F.abs(F.col(value) - F.col("median"))
    value_of = F.sum(far) if mode is Dispersion.SME else F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(median(far))
    return centred(df, keys, value).groupBy(*keys).agg(F.count(value).alias("n"), F.first("median").alias("median"), value_of.alias("dispersion"))


def all_dispersions(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, n and a column for each mode but entropy, in two passes."""
    far = F.abs(F.col(value) - F.col("median"))
    one = aggregate_modes(value)
    return centred(df, keys, value).groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.first("median").alias("median"),
        one[Dispersion.VAR].alias("var"),
        one[Dispersion.SSE].alias("sse"),
        F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(median(far)).alias("mad"),
        F.sum(far * far).alias("ssme"),
        F.sum(far).alias("sme"),
    )


def nonzero_mad(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Median absolute distance of non-zero values to the median of the non-zero values."""
    return dispersions(df.where(F.col(value) != 0), keys, Dispersion.MAD, value)


def coefficient_of_variation(dispersion: Column, location: Column) -> Column:
    """Dispersion over location; 0 where undefined."""
    return F.coalesce(F.try_divide(dispersion, location), F.lit(0.0))


def draw_order(df: DataFrame, keys: list[str], value: str = "value", sample: str = "sample_id") -> DataFrame:
    """df with ``rank``: the ascending draw order of each group, ties by sample."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, sample)))


def suffix(keys: list[str], by: str = "rank") -> Window:
    """What remains while drawing: this value and all later ones."""
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.currentRow, Window.unboundedFollowing)


def prefix(keys: list[str], by: str = "rank") -> Window:
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _over_suffixes(df: DataFrame, keys: list[str], by: str, value: str, names: list[str], of) -> DataFrame:
    """df with the columns ``names`` that ``of`` makes from the frames of what remains; a group's rows are one task's."""

    def run(t):
        t = t.sort_by(by)
        column = t.column(value).combine_chunks()
        f = Frames.suffixes(column.cast(pa.float64()).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False))
        for name, x in zip(names, of(f)):
            t = t.append_column(name, x if isinstance(x, pa.Array) else pa.array(x, pa.int64() if x.dtype.kind == "i" else pa.float64(), mask=f.n == 0))
        return t

    fields = [T.StructField(x, T.LongType() if x == "n" else T.DoubleType()) for x in names]
    return df.groupBy(*keys).applyInArrow(run, T.StructType([*df.schema.fields, *fields]))


def running(df: DataFrame, keys: list[str], by: str = "rank", value: str = "value") -> DataFrame:
    """Statistics of what remains before each draw: n, mean, median, var, sse, ssme."""

    def of(f):
        med = f.median()
        return pa.array(f.n, pa.int64()), f.mean(), med, f.var(), f.sse(), f.ssme(med)

    return _over_suffixes(df, keys, by, value, ["n", "mean", "median", "var", "sse", "ssme"], of)


def running_mad(df: DataFrame, keys: list[str], by: str = "rank", value: str = "value") -> DataFrame:
    """Of what remains before each draw: median, MAD, SME, CoV and MAD gain."""

    def of(f):
        med = f.median()
        mad, empty = f.mad(med), f.n == 0
        cov = np.where((med == 0) | empty, 0.0, np.abs(mad / np.where(med == 0, 1.0, med)))
        return med, pa.array(mad), pa.array(np.where(empty, 0.0, f.sme())), pa.array(cov), pa.array(np.maximum(0.0, mad[:1] - mad))

    return _over_suffixes(df, keys, by, value, ["median", "mad", "sme", "cov", "mad_gain"], of)


def first_minimum(value: Column | str, place: Column | str) -> Column:
    """Place of the smallest value that is a number; the smallest place of equals."""
    v = _c(value)
    return F.min(F.when(~F.isnan(v), F.struct(v.alias("value"), _c(place).alias("place"))))


def first_maximum(value: Column | str, place: Column | str) -> Column:
    v = _c(value)
    return F.max_by(F.struct(v.alias("value"), _c(place).alias("place")), F.when(~F.isnan(v), F.struct(v, -_c(place))))
