"""Neighbours and communities where rows repeat, cells are many and the edge list is too long to gather."""

import numpy as np
import pytest

from thicket import catalog
from thicket.operators import community
from thicket.operators import knn as K

from .test_whole_tables import parts  # noqa: F401


def brute(ids, stacks, k, metric):
    total = 0.0
    for x in stacks:
        x = K.coordinates(x, metric)
        total = total + (np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else np.abs(x[:, None] - x[None]).sum(2) if metric == "cityblock" else 1 - x @ x.T)
    d = np.round(total / len(stacks), 9) + 0.0
    np.fill_diagonal(d, np.inf)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, d[n]))[:k]]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("metric, two", [("euclidean", False), ("euclidean", True), ("cosine", False), ("correlation", True), ("cityblock", False)])
def test_copies_ties_and_many_cells(spark, monkeypatch, metric, two):
    monkeypatch.setattr(K, "CELL", 40)
    rng = np.random.default_rng(1)
    x, y = np.round(rng.normal(size=(500, 3)) * [1, 300, 5], 1), np.round(rng.normal(size=(500, 2)), 1)
    x[100:160], x[200:240], x[300:320], y[100:160] = x[5], 0, 2 * x[5], y[5]
    ids = rng.permutation(2500)[:500]
    df = spark.createDataFrame([(int(i), a.tolist(), b.tolist()) for i, a, b in zip(ids, x, y)], "id long, v array<double>, v2 array<double>")
    got = {}
    for r in sorted(K.knn(df if two else df.select("id", "v"), 8, metric, 64).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute(ids, [x, y] if two else [x], 8, metric)


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    assert K.knn(make([]), 3).collect() == [] and K.knn(make([(1, [1.0, 2.0])]), 3).collect() == []
    got = {(r.id, r.neighbour): r.distance for r in K.knn(make([(1, [1e3, 2e3]), (2, [1e3, 2e3]), (3, [float("nan"), 1.0])]), 3, "euclidean").collect()}
    assert got == {(1, 2): 0.0, (2, 1): 0.0}


def test_a_vector_visits_few_cells():
    x = np.random.default_rng(2).normal(size=(20_000, 2))
    cells = K.Cells(x, 400, 2)
    assert len(cells.low) == 400 and np.bincount(cells.homes(x)).max() <= 100
    rows, _ = cells.reached(x, np.full(len(x), 0.02), "euclidean", [2])
    assert len(rows) < 3 * len(x)


def test_rounds_are_the_same_in_the_driver_and_over_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(int(g * 30 + a), int(g * 30 + b)) for g in range(12) for a, b in rng.integers(0, 30, (90, 2)) if a != b] + [(int(a), int(b)) for a, b in rng.integers(0, 360, (60, 2)) if a != b]
    e, ids = spark.createDataFrame(edges, "src long, dst long"), spark.range(362)
    here = {r.id: r.label for r in community.communities(e, ids, method="louvain_rounds").collect()}
    other = community.communities(e, ids, method="louvain")
    monkeypatch.setattr(community, "HERE", 5)
    monkeypatch.setattr(community, "AT_ONCE", 50)
    found = community.communities(e, ids, method="louvain_rounds")
    assert here == {r.id: r.label for r in found.collect()} and len(here) == 362
    q, most = (community.modularity(e, x).first()[0] for x in (found, other))
    assert q > most - 0.01 and here[360] != here[361]
    assert community.communities(e.where("src < 0"), spark.range(0), method="louvain_rounds").collect() == []


@pytest.mark.parametrize("name", ["clu_12_cluster_samples", "clu_13_cluster_encoding"])
def test_samples_are_clustered_beyond_what_louvain_gathers(spark, parts, monkeypatch, name):  # noqa: F811
    monkeypatch.setattr(community, "GATHERED", 10)
    monkeypatch.setattr(community, "HERE", 10)
    assert sorted(r.sample_id for r in catalog.queries()[name](spark, parts).collect()) == list(range(361, 441))
