"""Cases of a review: queries on larger tables, and arguments that were left out."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket import catalog
from thicket.functions import ml
from thicket.functions.frames import Frames
from thicket.operators import factors
from thicket.plans import literal

D = "/root/testdata/sf0.001"


def test_draws_are_made_from_the_suppliers_of_the_given_tables(spark):
    n = spark.read.parquet(f"{D}/supplier.parquet").count()
    rows = catalog.queries()["trn_04_draws"](spark, D).collect()
    assert [r.draw_no for r in sorted(rows)] == list(range(40))
    assert all(1 <= r.sample_id <= n for r in rows)


def sends_rows(df):
    """Whether exploded rows of samples are gathered in the driver and sent to every task."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            for y in lines[i + 1 :]:
                if depth(y) <= depth(x) or "InMemoryRelation" in y or "Aggregate" in y:  # beyond are kept tables and sums
                    break
                if "Generate " in y:
                    return True
    return False


ERRORS = "prd_07_node_feature_error prd_11_node_mse prd_13_doublets prd_14_factor_errors prd_15_factor_mse prd_16_jackknife cmp_02_residual_z cmp_03_fvu cmp_08_all_factors jon_08_full_outer"


@pytest.mark.parametrize("name", [*ERRORS.split(), "nst_05_residual_doublet", "rep_14_sister_distance"])
def test_rows_of_samples_are_not_sent(spark, name):
    assert not sends_rows(catalog.queries()[name](spark, D))


def test_regression_rows_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(ml, "coefficients", lambda vectors, estimator: vectors)
    f = literal.forest(spark, D)
    assert not sends_rows(factors.linear_regression(f.factor_matrix(), f.long, 2))


@pytest.mark.parametrize("after", [None, 0, 1])
def test_frames_against_each_frame_alone(after):
    rng = np.random.default_rng(3)
    v, known = np.round(rng.uniform(-99, 9999, 90), 2), rng.random(90) > 0.1
    v[20:40] = v[20]
    f = Frames.prefixes(v, known) if after is None else Frames.suffixes(v, known, after)
    med = f.median()
    got = np.stack([f.n, med, f.mean(), f.var(), f.sse(), f.ssme(med), f.sme(), f.mad(med)])
    for i in range(90):
        x = (v[: i + 1])[known[: i + 1]] if after is None else (v[i + after :])[known[i + after :]]
        if len(x):
            m = np.median(x)
            far = np.abs(x - m)
            assert np.allclose(got[:, i], [len(x), m, x.mean(), x.var(), x.var() * len(x), (far * far).sum(), far.sum(), np.median(far) if len(x) > 1 else 0], rtol=1e-9, atol=1e-5)
        else:
            assert f.n[i] == 0


@pytest.mark.parametrize("name", ["dsp_21_running", "dsp_25_covs", "trn_08_scan_ssme", "trn_08_scan_sme", "trn_08_scan_mad", "trn_09_candidates", "trn_11_first_candidate"])
def test_frames_of_many_suppliers_end(spark, tmp_path, name):
    rng = np.random.default_rng(5)
    rows = [(k, float(v), int(n)) for k, (v, n) in enumerate(zip(rng.uniform(-999, 9999, 6000).round(2), rng.integers(0, 25, 6000)))]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    began = time.time()
    assert catalog.queries()[name](spark, str(tmp_path)).count() > 0
    assert time.time() - began < 20


def test_every_trusted_document_counts(spark):
    """More trusted documents than were once used, half of them of another kind: both kinds are kept, by either join."""
    from thicket.llm import quality_rules as Q

    assert not hasattr(Q, "TRUSTED")
    kinds = ("the river ran down to the sea and the hills were green in spring", "zwölf boxkämpfer jagen viktor quer über den großen sylter deich heute")
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, kinds[0]).otherwise(kinds[1]).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    a, b = Q.QualityModel(docs, labels), Q.QualityModel(docs, labels, sent=10)
    assert a.threshold == b.threshold
    assert np.array_equal(a.weights.value, b.weights.value)
    assert a.kept(docs).count() == b.kept(docs).count() == 400
