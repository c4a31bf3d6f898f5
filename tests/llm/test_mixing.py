import math
from collections import Counter, defaultdict

import pytest

from thicket.llm.mixing import WORDS, bisect_exponent, mix, plan
from thicket.llm.store import Workspace

from .brute import WORD

assert WORDS == WORD.pattern
SCHEMA = "doc_id long, text string, source string"


def corpus():
    rows = []
    for k, (source, n) in enumerate([("big", 300), ("mid", 60), ("small", 12), (None, 5)]):
        rows += [(1000 * k + i, "w " * (1 + (i * 7) % 23), source) for i in range(n)]
    return rows + [(9000, None, "small"), (9001, "", "mid"), (9002, "a b", "mid"), (9002, "a b", "mid")]


def tokens(rows):
    out = Counter()
    for _, t, s in rows:
        out[s] += max(1, len(WORD.findall(t or "")))
    return out


def exponent(total, entropy=None, repeats=None):
    """A fine grid instead of bisection."""
    all_tokens = sum(total.values())
    p = [v / all_tokens for v in total.values()]
    best = None
    for k in range(20001):
        t = k / 20000
        w = [x**t for x in p]
        w = [x / sum(w) for x in w]
        if entropy is not None:
            ok = -sum(x * math.log(x) for x in w) <= entropy
        else:
            r = [x / y for x, y in zip(w, p)]
            ok = max(r) / min(r) <= repeats
        if ok:
            best = t
            break
    return best if best is not None else 1.0


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"repeats": 6.0}, {"entropy": 0.9, "repeats": None}, {"entropy": 1.2, "repeats": None, "budget": 3000}, {"repeats": 3.0, "budget": 500}])
def test_budgets(spark, how):
    rows = corpus()
    total = tokens(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    t = exponent(total, how.get("entropy"), how.get("repeats"))
    p = {s: v / sum(total.values()) for s, v in total.items()}
    w = {s: x**t for s, x in p.items()}
    w = {s: x / sum(w.values()) for s, x in w.items()}
    budget = how.get("budget") or max(total[s] / w[s] for s in w)
    got = mix(df, **how).collect()
    used, copies = Counter(), defaultdict(Counter)
    for r in got:
        used[r.source] += r.n_tokens
        copies[r.source][r.doc_id] += 1
        assert r.mix_order >= 0
    for s in total:
        want = w[s] * budget
        longest = 23
        assert want - longest - 0.002 * want - 1 <= used[s] <= want * 1.002 + 1, (s, want, used[s])
        whole = int(want / total[s] + 1e-4)
        mult = Counter(d for d, _, x in rows if x == s)
        for d, m in mult.items():
            assert whole * m <= copies[s][d] <= (whole + 1) * m
    again = mix(df.repartition(5), **how)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))


def test_repeat_limit_and_nothing_lost(spark):
    rows = corpus()
    ws = Workspace(spark, "test")
    for r in plan(spark.createDataFrame(rows, SCHEMA), ws).collect():
        assert 1 - 1e-9 <= r.budget / r.tokens <= 2 + 1e-9
    assert {r.doc_id for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()} == {d for d, _, _ in rows}


def test_bisection_ends():
    one = lambda t: (1.0, 0.0, 1.0, 1.0)
    assert bisect_exponent(one, None, 2.0) == 0.0 and bisect_exponent(one, 1.0, None) == 0.0


def test_empty_and_clashing_columns(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "a b", "s", 7, "x", 1, 2, 3)], SCHEMA + ", n_tokens int, epoch string, blocks int, rest int, passes int")
    out = mix(df)
    assert out.columns[:8] == df.columns and [tuple(r)[:8] for r in out.collect()] == [(1, "a b", "s", 7, "x", 1, 2, 3)]


def test_columns_named_like_the_new_ones(spark):
    rows = [(i, "w " * (i % 9 + 1), "ab"[i % 3 == 0], i, "x", i, 0.5, i) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA + ", epoch int, block string, n_tokens int, mix_order double, __source int")
    out = mix(df)
    assert out.columns == [*df.columns, "mix_n_tokens", "mix_epoch", "mix_block", "mix_mix_order"]
    assert {tuple(r)[:8] for r in out.collect()} == set(rows)
    plain = mix(df.select("doc_id", "text", "source")).select("doc_id", "epoch", "mix_order")
    assert sorted(map(tuple, out.select("doc_id", "mix_epoch", "mix_mix_order").collect())) == sorted(map(tuple, plain.collect()))
