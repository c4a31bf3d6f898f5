import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.quantiles import exact_medians
from thicket.operators import node_stats
from thicket.plans import literal


@pytest.mark.parametrize("fits", [5, 50, 10**6])
def test_against_numpy(spark, fits):
    rng = np.random.default_rng(1)
    groups = {"n": rng.standard_normal(3001), "e": rng.standard_normal(2000), "ties": rng.integers(0, 3, 1500).astype(float), "one": np.full(900, 7.0), "few": np.array([3.0, 1.0]), "skew": rng.exponential(size=2500) ** 4}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("null", None)]
    got = {r.k: r.median for r in exact_medians(spark.createDataFrame(rows, "k string, value double"), ["k"], fits=fits).collect()}
    assert got.pop("null") is None
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})


def test_node_statistics_agree(spark):
    f = literal.forest(spark, "/root/testdata/sf0.001")
    key = lambda t: sorted(map(tuple, t.select("tree_id", "node_id", "feature_id", "n", *[F.round(c, 4) for c in ("mean", "median", "srs", "ssme")]).collect()))
    a, b = key(node_stats.node_stats(f.values)), key(node_stats.node_stats(f.values, large=True))
    assert all(x == pytest.approx(y, abs=2e-3) for x, y in zip(a, b)) and len(a) == len(b)
