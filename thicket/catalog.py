"""Registry of the library's own queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import basic, forest, literal, scale

#: Operators that are another query's operation under a second heading.
SAME = {
    "jon_01_feature_names": "flt_07_feature_by_name",
    "jon_03_closure": "nav_02_descendants",
    "jon_05_encoding_times_values": "prd_03_additive",
    "jon_06_threshold_routing": "flt_04_route",
    "jon_08_full_outer": "cmp_08_all_factors",
    "jon_09_anti": "src_12_unrepresented",
    "jon_10_top_k": "clu_01_knn_cosine",
    "nav_17_roots_only": "nav_07_roots",
    "flt_09_forest_restrict": "flt_08_restrict",
    "fac_28_odds_rows": "con_05_odds",
    "srt_05_first_acceptable": "trn_12_accept",
    "trn_15_crawl": "nav_02_descendants",
    "prd_01_transform": "prd_03_additive",
}


def _all() -> dict[str, tuple]:
    out = {**basic.Q, **forest.Q, **scale.Q}
    return out | {k: out[v] for k, v in SAME.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive prediction of the literal forest beside the truth, per sample and feature."""
    f = literal.forest(spark, sf_dir)
    return f.predict(f.inputs).residuals().select("sample_id", "feature_id", "value", F.round("residual", 4).alias("residual"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _all().items() if v[1]}
