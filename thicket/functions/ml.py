"""Small adapters to MLlib estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_vectors(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and an MLlib vector ``x`` of the features in order."""
    from pyspark.ml.functions import array_to_vector

    pairs = F.array_sort(F.collect_list(F.struct("feature_id", F.col(value).cast("double").alias("value"))))
    return long.groupBy(*keys).agg(array_to_vector(F.transform(pairs, lambda p: p["value"])).alias("x"))


def coefficients(vectors: DataFrame, estimator) -> DataFrame:
    """Fits and returns (feature_id, coefficient)."""
    fitted = estimator.fit(vectors)
    rows = [(i, float(c)) for i, c in enumerate(fitted.coefficients.toArray())]
    return vectors.sparkSession.createDataFrame(rows, "feature_id int, coefficient double")
