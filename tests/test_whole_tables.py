"""Queries see every row of tables with more rows, and higher ids, than the smallest test tables."""

import duckdb
import numpy as np
import pytest

from thicket import catalog
from thicket.operators import nipals, scan
from thicket.plans.literal import part_matrix

from .test_catalog import plain

SUPPLIER = (
    "dsp_03_draw_order dsp_04_ordered_values dsp_11_slow_mad dsp_15_entropy dsp_16_zones dsp_21_running dsp_22_ordered_variance dsp_23_ordered_sse dsp_24_mad_gains "
    "dsp_25_covs dsp_30_argmin_argmax dsp_32_total_ssme trn_08_scan_ssme trn_08_scan_sse trn_08_scan_sme trn_08_scan_mad trn_09_candidates trn_11_first_candidate"
).split()


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("suppliers"))
    rng = np.random.default_rng(5)
    rows = [(k, round(float(v), 2), int(n)) for k, v, n in zip(range(71, 131), rng.uniform(-999, 9999, 60), rng.integers(0, 25, 60))]
    spark.createDataFrame(rows, "s_suppkey long, s_acctbal double, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    return d


@pytest.mark.parametrize("name", SUPPLIER)
def test_all_suppliers_count(spark, suppliers, name):
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from read_parquet('{suppliers}/supplier.parquet/*.parquet')")
    rel = con.sql(catalog.oracle_sql()[name])
    cols = rel.columns
    got = sorted((tuple(plain(r[c]) for c in cols) for r in catalog.queries()[name](spark, suppliers).collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=str)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("parts"))
    rng = np.random.default_rng(6)
    rows = [(k, int(rng.integers(1, 51)), float(rng.uniform(900, 1000)), "n" * int(rng.integers(5, 30)), f"Brand#{rng.integers(11, 56)}") for k in range(361, 441)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double, p_name string, p_brand string").write.parquet(f"{d}/part.parquet")
    return d


@pytest.mark.parametrize("name", ["clu_12_cluster_samples", "clu_13_cluster_encoding"])
def test_all_samples_are_clustered(spark, parts, name):
    rows = catalog.queries()[name](spark, parts).collect()
    assert sorted(r.sample_id for r in rows) == list(range(361, 441))
    assert sorted({r.cluster_id for r in rows}) == list(range(max(r.cluster_id for r in rows) + 1))


def test_components_of_all_samples(spark, parts):
    got = [r.weights for r in sorted(catalog.queries()["trn_16_nipals"](spark, parts).collect(), key=lambda r: r.component)]
    want, _, _ = nipals.components(np.array([r.x for r in part_matrix(spark, parts).collect()]), 4)
    assert np.allclose(got, want, atol=2e-4)


def test_all_vectors_are_scanned(spark, tmp_path):
    x = np.random.default_rng(7).standard_normal((30, 4))
    rows = [(k + 285, v.tolist()) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.candidate, r.feature_id, r.threshold) for r in catalog.queries()["bench_embedding_scan"](spark, str(tmp_path)).collect()]
    want = [(i, c[0], round(c[2], 6)) for i, c in enumerate(scan.candidates(x, x, "ssme", 1, 1.0, True))]
    assert sorted(got) == want
