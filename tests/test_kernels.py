"""Array kernels and small functions against known values and naive versions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.functions import stats as S
from thicket.functions.dispersion import Dispersion
from thicket.operators import community, matrix, nipals, sampling, scan
from thicket.operators.trainer import Parameters

EIGHT = np.array([10, -3, 0, 5, -2, -1, 15, 20], float)


def order(values):
    return np.argsort(values, kind="stable")


def naive(values, mode):
    return scan._slow(values, mode)


def test_eight_values():
    assert order(EIGHT).tolist() == [1, 4, 5, 2, 3, 0, 6, 7]
    one = EIGHT[order(EIGHT)][:, None]
    std = np.ones(1)
    assert scan.two_sided(one, Dispersion.SSME, 1, 0.0, std) == pytest.approx([594, 460, 354, 252, 130, 92, 162, 364, 594])
    assert scan.two_sided(one, Dispersion.MAD, 1, 1.0, std) == pytest.approx([5, 5.25, 5.75, 3.5, 3, 2.5, 2.125, 2.625, 5])
    bags = {(0, 3, 6, 7): (125, 31.25), (0, 0, 3, 3, 6, 7): (175, 28.4722)}
    for bag, (ssme, var) in bags.items():
        v = EIGHT[list(bag)][:, None]
        assert naive(v, Dispersion.SSME)[0] == ssme and naive(v, Dispersion.VAR)[0] == pytest.approx(var, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 14), st.integers(1, 4), st.integers(1, 3), st.integers(0, 10**6), st.sampled_from(list(Dispersion)))
def test_remaining_against_naive(n, m, f, seed, mode):
    rng = np.random.default_rng(seed)
    outputs = rng.integers(-4, 5, (n, m)).astype(float) if seed % 2 else rng.standard_normal((n, m))
    orders = np.stack([rng.permutation(n) for _ in range(f)])
    got = scan._remaining(outputs, orders, mode)
    for i in range(f):
        for d in range(n):
            assert got[i, d] == pytest.approx(naive(outputs[orders[i, d:]], mode), abs=1e-9)
    assert (got[:, n] == 0).all()


def test_components_are_singular_vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 4)) @ np.diag([4.0, 2.0, 1.0, 0.3]) + [5.8, 3.1, 3.8, 1.2]
    w, t, means = nipals.components(x, 4)
    right = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2]
    assert np.abs(w) == pytest.approx(np.abs(right), abs=1e-4)
    assert t.shape == (4, 150) and means == pytest.approx(x.mean(axis=0))


def test_candidates_against_naive_scan():
    rng = np.random.default_rng(6)
    x = np.round(rng.standard_normal((60, 3)), 1)
    for mode in (Dispersion.SSME, Dispersion.SME, Dispersion.SSE):
        got = {c[0]: c[2:] for c in scan.candidates(x, x, mode, 1, 0.0)}
        for f in range(3):
            ranked = x[order(x[:, f])]
            d = [sum(naive(ranked[:i], mode)) + sum(naive(ranked[i:], mode)) for i in range(1, 61)]
            i = int(np.argmin(np.round(d, 9)))
            assert got[f] == pytest.approx((ranked[i, f], d[i]))


def test_degenerate_components():
    w, t, _ = nipals.components(np.array([[1.0, 1, 1], [2, 2, 2], [3, 3, 3]]), 3)
    assert np.allclose(np.abs(w[0]), 1 / math.sqrt(3)) and not w[1:].any() and not t[1:].any()


def test_names_and_parameters():
    assert matrix.number_repeats(["a", "a", "b", "a"]) == ["a", "a1", "b", "a2"]
    assert len(set(matrix.number_repeats(["a", "a", "a1", "a"]))) == 4
    p = Parameters.of(t=3, depth=4, leaves=2, ss=50, ifs=5, ofs=6, norm="l1", dm="variance", std="true", p=8)
    assert (p.trees, p.max_depth, p.min_leaf, p.samples, p.input_features, p.output_features, p.norm, p.standardize) == (3, 4, 2, 50, 5, 6, 1, True)
    with pytest.raises(TypeError):
        Parameters.of(nonsense=2)
    with pytest.raises(ValueError):
        Parameters.of(dm="mixed")


def test_draws():
    draws = [sampling.scrambled(7, k, 3) % 2000 for k in range(3000)]
    assert 1450 < len(set(draws)) < 1650 and min(draws) >= 0
    ins, outs = sampling.feature_pools(1, 5, 11, 0, True)
    assert len(ins) == 5 and sorted(ins + outs) == list(range(11))
    assert sampling.feature_pools(1, 5, 4, 0, False) == ([0, 1, 2, 3], [0, 1, 2, 3])


def test_louvain_finds_planted_groups():
    rng = np.random.default_rng(0)
    src, dst = [], []
    for g in range(4):
        for i in range(25):
            for j in rng.choice(25, 6, replace=False):
                if i != j:
                    src.append(g * 25 + i)
                    dst.append(g * 25 + j)
    src += [0, 30, 60]
    dst += [30, 60, 90]
    label = community.louvain(np.array(src), np.array(dst), 100)
    assert all(len(set(label[g * 25 : g * 25 + 25])) == 1 for g in range(4)) and len(set(label)) == 4


def test_tails():
    assert S.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert S.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    # Three degrees of freedom have a closed form.
    for t in (0.1, 1.0, 4.0):
        closed = 1 - 2 / math.pi * (t / (math.sqrt(3) * (1 + t * t / 3)) + math.atan(t / math.sqrt(3)))
        assert S.t_tail(t, 3) == pytest.approx(closed, abs=1e-9)
    assert S.t_density(0.0, 10) == pytest.approx(0.389108, abs=1e-6)
    assert S.ks_tail(0.5, 20, 20) == pytest.approx(0.0135, abs=1e-3)
