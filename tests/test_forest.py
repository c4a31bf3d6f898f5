"""Training, the model's methods, files and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions import dispersion as D
from thicket.model import Forest, fit
from thicket.operators import matrix, navigate, node_stats, routing
from thicket.plans import literal
from thicket.sources import text, trees

S1 = "/root/testdata/sf0.001"


def planted(n=400, seed=1):
    rng = np.random.default_rng(seed)
    group = rng.random(n) < 0.5
    a = np.where(group, 3.0, -3.0)
    return np.stack([a + rng.normal(0, 0.3, n), a * 2 + rng.normal(0, 0.3, n), -a + rng.normal(0, 0.3, n), rng.normal(0, 1, n)], axis=1)


OPTIONS = dict(trees=4, depth=3, leaves=8, ss=80, ifs=4, ofs=4, norm=1, std=True, seed=3)


def test_trained_forest_explains_planted_structure_and_not_noise(spark):
    # One split tells the planted groups apart in three features at once; shuffled columns share nothing.
    x = planted()
    one = OPTIONS | {"depth": 1}
    f = fit(spark, x, x, **one)
    shuffled = np.stack([np.random.default_rng(i).permutation(x[:, i]) for i in range(4)], axis=1)
    g = fit(spark, shuffled, shuffled, **one)
    real, null = (m.predict(m.inputs).report().first().squared for m in (f, g))
    assert real < 0.25 and null > 2 * real


def test_growth_keeps_its_promises(spark):
    x = planted()
    f = fit(spark, x, x, **OPTIONS)
    again = fit(spark, x, x, **OPTIONS)
    key = lambda m: sorted(map(tuple, m.node_table.select("tree_id", "node_id", "is_leaf", "split").collect()), key=str)
    assert key(f) == key(again)
    pop = {(r.tree_id, r.node_id): r["pop"] for r in navigate.populations(f.member).collect()}
    assert all(v > 8 for v in pop.values())
    leaf = {(r.tree_id, r.node_id) for r in f.leaves().collect()}
    for t in f.trees:
        assert sum(v for k, v in pop.items() if k[0] == t and k in leaf) == 400
    assert f.node_table.agg(F.max("level")).first()[0] <= 3
    # Gains along a path add up to the leaf's mean.
    g = {(r.tree_id, r.node_id, r.feature_id): r.gain for r in node_stats.additive_gains(f.stats, "mean").collect()}
    m = {(r.tree_id, r.node_id, r.feature_id): r["mean"] for r in f.stats.collect()}
    for t, n in leaf:
        assert sum(g[t, n >> k, 0] for k in range(n.bit_length())) == pytest.approx(m[t, n, 0])


def test_unsupervised_reduced_and_factors(spark):
    x = planted(300)
    f = fit(spark, x, header=["a", "b", "c", "d"], trees=3, depth=2, leaves=8, ss=60, ifs=2, ofs=2, reduce_input=True, reduction=1, seed=1)
    assert f.node_table.where("not is_leaf").count() > 0
    f.interpret_splits(mode="additive_mean", k=3)
    scores = f.factor_matrix().collect()
    assert all(-1 <= r.score <= 1 for r in scores) and {r.factor_id for r in scores} >= {0, 1}
    assert f.tree.where("factor_id = 0").first().parent_factor_id is None
    summary = f.report(1).collect()
    assert {r.factor_id for r in summary} == {r.factor_id for r in f.factor_nodes.select("factor_id").distinct().collect()} and '"features"' in summary[-1].summary
    by = f.trim(0.99)
    assert by.node_table.count() <= f.node_table.count()


def test_save_load_and_json(spark, tmp_path):
    f = literal.forest(spark, S1)
    f.save(str(tmp_path / "m"))
    g = Forest.load(spark, str(tmp_path / "m"))
    assert g.names == literal.NAMES and g.node_table.count() == f.node_table.count()
    leaf = routing.encoding(f.member, f.node_table, leaves=True)
    trees.write_json(trees.to_json(f.node_table, leaf, f.stats, f.names), str(tmp_path / "j"))
    nodes, member = trees.read_json(spark, str(tmp_path / "j" / "*" / "*"))
    back = lambda n: sorted((r.node_id, r.split) for r in n.collect() if r.split is not None)
    assert back(nodes) == back(f.node_table) and member.count() == leaf.count()


def test_empty_nodes_have_no_rows(spark):
    f = literal.forest(spark, S1)
    pop = {(r.tree_id, r.node_id): r["pop"] for r in navigate.populations(f.member).collect()}
    assert (1, 5) not in pop and (2, 3) not in pop and pop[1, 4] == 114
    p = f.predict(f.inputs.limit(0))
    assert p.prediction().collect() == [] and p.report().first().squared == 0.0


def test_compiled_and_batch_routing_agree(spark, monkeypatch):
    f = literal.forest(spark, S1)
    a = sorted(map(str, f.routed.collect()))
    monkeypatch.setattr(routing, "COMPILED", 0)
    assert sorted(map(str, routing.route(f.inputs, f.node_table).collect())) == a


def test_nan_and_null_go_right_in_every_path(spark, monkeypatch):
    from thicket.operators import trainer

    f = literal.forest(spark, S1)
    nan = float("nan")
    width = len(f.inputs.first().x)
    odd = [(1, [nan] * width), (2, [None] * width), (3, [nan, *[1.0] * (width - 1)]), (4, [1.0, None, *[2.0] * (width - 2)]), (5, [float("inf")] * width), (6, [float("-inf")] * width), (7, None)]
    df = spark.createDataFrame(odd, "sample_id long, x array<double>").union(f.inputs.select(F.col("sample_id") + 1000, "x"))
    trees, splits = routing.gather(f.node_table)
    paths = []
    for compiled in (256, 0):
        monkeypatch.setattr(routing, "COMPILED", compiled)
        paths.append({r.sample_id: tuple(r.leaves) for r in routing.route(df, f.node_table).collect()})
    assert paths[0] == paths[1] and len(paths[0]) == len(odd) + f.inputs.count()
    rightmost = {t: max(n for n in (s.node_id for s in splits if s.tree_id == t) if (n + 1) & n == 0) * 2 + 1 for t in trees if any(s.tree_id == t for s in splits)}
    assert all(paths[0][i][k] == rightmost.get(t, 1) for i in (1, 2, 7) for k, t in enumerate(trees))
    # The trainer counts the same sides: 3 right (NaN, null, above), 2 left.
    at = spark.createDataFrame([(0, 1, [v]) for v in (nan, None, 9.0, 1.0, 2.0)], "tree_id int, node_id long, x array<double>")
    found = spark.createDataFrame([(0, 1, 0, [0], [0.0], [1.0], 5.0, 0.0)], trainer.CANDIDATE)
    assert len(trainer._accept(at, found, 1)) == 1 and trainer._accept(at, found, 2) == []


def test_names_and_resets(spark):
    f = literal.forest(spark, S1)
    f.interpret_splits(mode="additive_mean", k=3)
    f.set_factor_name(1, "growth")
    assert {r.factor_id: r.name for r in f.named_factors().collect()}[1] == "growth" and f.named_factors().where("factor_id = 0").first().name == "0"
    f.cluster_samples_encoding(k=3)
    f.set_cluster_name(0, "main")
    assert {r.cluster_id: r.name for r in f.named_clusters().collect()}[0] == "main"
    assert f.named_samples().where("sample_id = 5").first().name == "5"
    f.reset_split_clusters()
    f.reset_sample_clusters()
    f.reset_leaf_clusters()
    assert f.factor_nodes is None and f.tree is None and f.sample_labels is None and f.leaf_labels is None and not f.factor_names and not f.cluster_names


def test_methods_of_communities_are_chosen_by_name(spark, monkeypatch):
    from thicket.operators import community

    groups = [range(0, 8), range(8, 16), range(16, 24)]
    edges = [(a, b) for g in groups for a in g for b in g if a < b] + [(0, 8), (8, 16)]
    e, ids = spark.createDataFrame(edges, "src long, dst long"), spark.range(24)

    def found(method):
        of = {}
        for r in community.communities(e, ids, method=method).collect():
            of.setdefault(r.label, set()).add(r.id)
        return sorted(map(sorted, of.values()))

    assert found("louvain") == found("label_propagation") == [list(g) for g in groups]
    monkeypatch.setattr(community, "GATHERED", 10)
    with pytest.raises(ValueError, match="label_propagation"):
        found("louvain")
    with pytest.raises(ValueError, match="no such method"):
        found("other")


def test_text_sources(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("10 5 -1 0\n\n -2\t10 -3  20 \n")
    assert [list(r.x) for r in text.read_matrix(spark, str(p)).orderBy("sample_id").collect()] == [[10, 5, -1, 0], [-2, 10, -3, 20]]
    p.write_text("1 x\n")
    assert text.read_matrix(spark, str(p), strict=False).first().x == [1.0, None]
    with pytest.raises(Exception, match="not a number"):
        text.read_matrix(spark, str(p)).collect()
    h = tmp_path / "h.txt"
    h.write_text("a\na\nb\na\n")
    assert [r.name for r in text.read_header(spark, str(h)).orderBy("feature_id").collect()] == ["a", "a1", "b", "a2"]
    h.write_text("")
    assert text.read_header(spark, str(h)).count() == 0 and text.read_matrix(spark, str(h)).count() == 0


def test_validation(spark):
    make = lambda rows: spark.createDataFrame(rows, "sample_id long, x array<double>")
    assert matrix.validate(make([])) == 0 and matrix.validate(make([(1, [1.0, 2.0])])) == 2
    for bad in ([(1, [1.0, float("nan")])], [(1, [None])], [(1, [1.0]), (2, [1.0, 2.0])]):
        with pytest.raises(ValueError):
            matrix.validate(make(bad))


def test_argmin_skips_nan(spark):
    nan = float("nan")
    cases = {"a": [1.0], "b": [1.0, 2.0], "c": [1.0, nan], "d": [nan, 1.0], "e": [nan, nan], "f": [1.0, 1.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in cases.items() for i, v in enumerate(vs)], "k string, i int, value double")
    got = {r.k: (r.lo, r.hi) for r in df.groupBy("k").agg(D.first_minimum("value", "i").alias("lo"), D.first_maximum("value", "i").alias("hi")).collect()}
    place = lambda x: None if x is None else x.place
    assert {k: (place(a), place(b)) for k, (a, b) in got.items()} == {"a": (0, 0), "b": (0, 1), "c": (0, 0), "d": (1, 1), "e": (None, None), "f": (0, 0)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 800
    assert len(e.queries()) > 180 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_draws_hit_every_position(spark, monkeypatch, bucket):
    from thicket.operators import sampling

    monkeypatch.setattr(sampling, "BUCKET", bucket)
    member = spark.createDataFrame([(t, n, s) for t in range(2) for n, k in ((1, 40), (2, 7)) for s in range(100, 100 + k)], "tree_id int, node_id long, sample_id long")
    draws = spark.createDataFrame([(t, n, p, p % k) for t in range(2) for n, k in ((1, 40), (2, 7)) for p in range(2 * k)], "tree_id int, node_id long, draw_no long, position long")
    got = sampling.drawn_samples(member, draws, 94).collect()
    assert len(got) == 2 * (80 + 14)
    for t in range(2):
        for n, k in ((1, 40), (2, 7)):
            mine = {r.draw_no: r.sample_id for r in got if (r.tree_id, r.node_id) == (t, n)}
            assert sorted(mine[i] for i in range(k)) == list(range(100, 100 + k)) and all(mine[i] == mine[i + k] for i in range(k))
