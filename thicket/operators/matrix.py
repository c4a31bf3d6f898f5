"""Wide and long matrices, feature names, validation.

wide: (sample_id BIGINT, x ARRAY<DOUBLE>); long: (sample_id, feature_id INT, value DOUBLE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(df: DataFrame, sample: str, columns: list) -> DataFrame:
    """Numeric columns (names or expressions) -> one array per sample."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    return df.select(F.col(sample).cast("long").alias("sample_id"), F.array(*cols).alias("x"))


def to_long(w: DataFrame) -> DataFrame:
    return w.select("sample_id", F.posexplode("x").alias("feature_id", "value"))


def to_wide(long: DataFrame) -> DataFrame:
    """Features in order of their id."""
    pairs = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    return long.groupBy("sample_id").agg(F.transform(pairs, lambda p: p["value"]).alias("x"))


def validate(w: DataFrame) -> int:
    """Width of a matrix; ragged rows, nulls and NaN are errors.  Returns 0 for an empty matrix."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    low, high, broken = w.agg(F.min(F.size("x")), F.max(F.size("x")), F.sum(F.when(bad | F.col("x").isNull(), 1).otherwise(0))).first()
    if broken:
        raise ValueError(f"{broken} rows hold nulls or NaN")
    if low != high:
        raise ValueError(f"rows are between {low} and {high} wide")
    return low or 0


def name_features(names: list[str] | None, width: int) -> list[str]:
    """Given names with repeats numbered (a, a1, a2), or the column numbers."""
    if names is None:
        return [str(i) for i in range(width)]
    if len(names) != width:
        raise ValueError(f"{len(names)} names for {width} features")
    return number_repeats(names)


def number_repeats(names: list[str]) -> list[str]:
    taken, times, out = set(names), {}, []
    for n in names:
        times[n] = times.get(n, -1) + 1
        new = n
        if times[n]:
            k = times[n]
            while (new := f"{n}{k}") in taken:
                k += 1
            taken.add(new)
        out.append(new)
    return out


def select_features(long: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Rows of the named features; names are matched without surrounding quotes."""
    plain = F.regexp_replace("name", "^[\"']+|[\"']+$", "")
    ids = features.where(plain.isin([n.strip("\"'") for n in names])).select("feature_id")
    return long.join(ids, "feature_id", "left_semi")


def add_feature(w: DataFrame, column: DataFrame, value: str) -> DataFrame:
    """Appends one feature; column: (sample_id, value)."""
    return w.join(column.select("sample_id", F.col(value).cast("double").alias("__v")), "sample_id").select("sample_id", F.array_append("x", F.col("__v")).alias("x"))


def remove_feature(w: DataFrame, feature: int) -> DataFrame:
    return w.withColumn("x", F.filter("x", lambda v, i: i != feature))


def centre(long: DataFrame) -> DataFrame:
    """Values less their feature's mean; the few means are joined."""
    means = long.groupBy("feature_id").agg(F.avg("value").alias("mean"))
    return long.join(means, "feature_id").select("sample_id", "feature_id", (F.col("value") - F.col("mean")).alias("value"))


def derive(long: DataFrame, draws: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Bag of samples (and features): draws (draw_no, sample_id) with repeats, features (place, feature_id)."""
    out = long.join(draws, "sample_id")
    if features is None:
        return out.select("draw_no", "sample_id", "feature_id", "value")
    return out.join(features, "feature_id").select("draw_no", "sample_id", "place", "feature_id", "value")
