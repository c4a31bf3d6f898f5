"""Queries over the literal forest on ``part``: navigation, node statistics, representations, factors, predictions, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import compare, community, consensus, factors, knn, matrix, navigate, node_stats, predict, represent, routing, samples
from ..sources import trees as tree_files
from ..sources.scratch import scratch
from ..streaming.score import score_stream
from . import literal
from .basic import R, r
from .literal import forest as L
from .literal import sql, table

Q: dict[str, tuple] = {}
KEY = ["tree_id", "node_id"]


def query(name: str, tail: str | None = None):
    def put(f):
        Q[name] = (f, sql(tail) if tail else None)
        return f

    return put


def segments(spark, d):
    """Sample clusters: part size modulo 3."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") % 3).alias("cluster_id"))


SEG = "lab as (select p_partkey sid, p_size % 3 c from part)"


# -- model sources and sinks -----------------------------------------------------------------------------------------


@query("src_10_tree_json", "select t tree_id, count(*) n from mem join nd using (t, node) where is_leaf group by t")
def _(spark, d):
    f = L(spark, d)
    leaf = routing.encoding(f.member, f.node_table, leaves=True).where("sample_id <= 500").union(routing.encoding(f.member, f.node_table, leaves=True).where("sample_id > 500"))
    js = tree_files.to_json(f.node_table, leaf, f.stats, f.names)
    path = scratch(spark, "trees")
    tree_files.write_json(js, path)
    _, member = tree_files.read_json(spark, f"{path}/*/*")
    return member.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n")).select((F.col("tree_id") + 1).alias("tree_id"), "n")


@query("src_11_serial_nodes", "select t tree_id, node node_id, count(*) n, min(sid) lo, max(sid) hi from mem join nd using (t, node) where is_leaf group by all")
def _(spark, d):
    f = L(spark, d)
    return navigate.sample_lists(f.member, f.node_table).select(*KEY, F.size("samples").cast("long").alias("n"), F.array_min("samples").alias("lo"), F.array_max("samples").alias("hi"))


@query("src_12_unrepresented", "select p_partkey sample_id from part where p_partkey % 7 = 0")
def _(spark, d):
    f = L(spark, d)
    return navigate.unrepresented(f.samples, f.member.where("sample_id % 7 != 0"))


@query("src_13_flatten", "select t tree_id, node node_id, is_leaf from nd")
def _(spark, d):
    f = L(spark, d)
    leaf = routing.encoding(f.member, f.node_table, leaves=True)
    path = scratch(spark, "flat")
    tree_files.write_json(tree_files.to_json(f.node_table, leaf), path)
    nodes, _ = tree_files.read_json(spark, f"{path}/*/*")
    return nodes.select((F.col("tree_id") + 1).alias("tree_id"), "node_id", "is_leaf")


@query("src_14_save_load", f"select f feature_id, {R('sum(n * mean) / sum(n)')} m from ns where node = 1 group by f")
def _(spark, d):
    from ..model import Forest

    path = scratch(spark, "model")
    L(spark, d).save(path)
    f = Forest.load(spark, path)
    return f.stats.where("node_id = 1").groupBy("feature_id").agg(r(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"))


@query("src_16_mllib_import")
def _(spark, d):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    data = literal.part_matrix(spark, d).select(array_to_vector("x").alias("features"), F.col("x")[1].alias("label"))
    model = RandomForestRegressor(numTrees=2, maxDepth=3, seed=1).fit(data)
    return tree_files.from_mllib(model, spark, scratch(spark, "mllib")).select("tree_id", "node_id", "level", "is_leaf")


# -- scores, filters, routing ----------------------------------------------------------------------------------------


@query("trn_18_reduction_score", f"select sid sample_id, {R('(x[1] - 25) * 0.6::double + (x[2] - 950) * 0.08::double')} score from m")
def _(spark, d):
    n = literal.nodes(spark).where("tree_id = 3 and node_id = 1").select(F.struct("features", "means", "scores").alias("red"))
    return literal.part_matrix(spark, d).crossJoin(F.broadcast(n)).select("sample_id", r(routing.reduction_score("x", "red")).alias("score"))


@query("trn_19_filter", "select sid sample_id from m where x[2] > 950")
def _(spark, d):
    s = routing.Split(1, 2, (1,), (0.0,), (1.0,), 950.0)
    return literal.part_matrix(spark, d).where(routing.passes(routing.score(F.col("x"), s), F.lit(s.split), F.lit(True))).select("sample_id")


@query("trn_12_accept", "select x[1] <= 25 as low, count(*) n from m group by 1 having count(*) > 50")
def _(spark, d):
    from ..operators.trainer import CANDIDATE, _accept

    x = literal.part_matrix(spark, d)
    at = x.select(F.lit(1).alias("tree_id"), F.lit(1).cast("long").alias("node_id"), "x")
    cands = spark.createDataFrame([(1, 1, 0, [0], [0.0], [1.0], 1e9, 0.0), (1, 1, 1, [0], [0.0], [1.0], 25.0, 1.0), (1, 1, 2, [0], [0.0], [1.0], 10.0, 2.0)], CANDIDATE)
    won = _accept(at, cands, 50)[0]
    return x.groupBy((F.col("x")[won.features[0]] <= won.split).alias("low")).agg(F.count(F.lit(1)).alias("n"))


@query("trn_14_children", "select t tree_id, node node_id, count(*) n from mem where node >= 2 and node <= 3 group by all")
def _(spark, d):
    return navigate.populations(L(spark, d).member).where("node_id in (2, 3)").withColumnRenamed("pop", "n")


@query("flt_01_masks", "select t tree_id, node node_id, sid sample_id from mem where node in (1, 2, 3) and t = 2")
def _(spark, d):
    return L(spark, d).member.where("node_id <= 3 and tree_id = 2")


@query("flt_02_scores", f"select sid sample_id, {R('x[1]')} s1, {R('x[2]')} s2 from m")
def _(spark, d):
    a, b = (routing.Split(0, 1, (k,), (0.0,), (1.0,), 0.0) for k in (0, 1))
    return literal.part_matrix(spark, d).select("sample_id", r(routing.score(F.col("x"), a)).alias("s1"), r(routing.score(F.col("x"), b)).alias("s2"))


@query("flt_03_split_feature", "select * from (values (1,1,0),(1,2,1),(1,3,3),(2,1,1),(2,2,0),(2,3,0),(3,3,3)) z(tree_id, node_id, feature_id)")
def _(spark, d):
    return literal.nodes(spark).where("size(features) = 1").select(*KEY, F.col("features")[0].alias("feature_id"))


@query("flt_04_route", "select sid sample_id, t tree_id, leaf leaf_id from leaf")
def _(spark, d):
    f = L(spark, d)
    return f.routed.select("sample_id", F.posexplode("leaves").alias("k", "leaf_id")).select("sample_id", (F.col("k") + 1).alias("tree_id"), "leaf_id")


@query("flt_05_encoding", "select t tree_id, node node_id, count(*) n, sum(sid)::bigint total from mem group by all")
def _(spark, d):
    return L(spark, d).member.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("sample_id").alias("total"))


@query("flt_06_leaf_encoding", "select t tree_id, node node_id, sid sample_id from mem join nd using (t, node) where is_leaf and lev <= 2")
def _(spark, d):
    f = L(spark, d)
    return routing.encoding(f.member, f.node_table, leaves=True, depth=2)


@query("flt_07_feature_by_name", f"select sid sample_id, {R('v', 2)} as value from lng where f = 1")
def _(spark, d):
    f = L(spark, d)
    return matrix.select_features(f.long, f.features, ["'price'"]).select("sample_id", r("value", 2).alias("value"))


@query("flt_08_restrict", ", keep as (select * from mem where sid % 5 = 0), k as (select t, node, count(*) n from keep group by all), ch as (select nd.t, nd.node >> 1 p, min(coalesce(n, 0)) lo from nd left join k using (t, node) where nd.node > 1 group by 1, 2), gone as (select distinct anc.t, anc.node from anc join ch on ch.t = anc.t and ch.p = anc.a where d > 0 and lo = 0) select t tree_id, node node_id, count(*) n from keep anti join gone using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    _, member = routing.restrict(f.member, f.node_table, f.samples.where("sample_id % 5 = 0"))
    return navigate.populations(member).withColumnRenamed("pop", "n")


COD = ", pn as (select t, node, sum(srs) / max(n) mse from ns group by all), cod as (select a.t, a.node, case when a.node = 1 then 0 else 1 - a.mse / nullif(b.mse, 0) end cod from pn a left join pn b on b.t = a.t and b.node = a.node >> 1)"


@query("flt_10_trim", COD + ", gone as (select distinct anc.t, anc.node from anc join cod on cod.t = anc.t and cod.node = anc.a where d > 0 and cod < 0.16 and cod.node > 1) select nd.t tree_id, nd.node node_id, not exists (select 1 from (select * from nd anti join gone using (t, node)) c where c.t = nd.t and c.node >> 1 = nd.node) is_leaf from nd anti join gone using (t, node)")
def _(spark, d):
    return L(spark, d).trim(0.16).node_table.select(*KEY, "is_leaf")


# -- navigation ------------------------------------------------------------------------------------------------------


@query("nav_01_nodes", "select t tree_id, node node_id from nd where lev > 0 and lev <= 1")
def _(spark, d):
    return navigate.nodes(literal.nodes(spark), False, 1).select(*KEY)


@query("nav_02_descendants", "select t tree_id, a node_id, node descendant_id from anc where d > 0")
def _(spark, d):
    return navigate.descendants(literal.nodes(spark))


@query("nav_03_leaves", "select t tree_id, node node_id from nd where lev = 1 or (is_leaf and lev < 1)")
def _(spark, d):
    return navigate.leaves(literal.nodes(spark), 1).select(*KEY)


@query("nav_04_true_leaves", "select t tree_id, node node_id from nd where is_leaf")
def _(spark, d):
    return L(spark, d).leaves().select(*KEY)


@query("nav_05_stems", "select t tree_id, node node_id from nd where lev > 0 and not is_leaf")
def _(spark, d):
    return L(spark, d).stems().select(*KEY)


@query("nav_06_level", "select t tree_id, node node_id from nd where lev = 2")
def _(spark, d):
    return L(spark, d).level(2).select(*KEY)


@query("nav_07_roots", "select t tree_id, node node_id from nd where node = 1")
def _(spark, d):
    return L(spark, d).roots().select(*KEY)


@query("nav_08_sister", "select t tree_id, node node_id, xor(node, 1)::bigint sister_id from nd where node > 1")
def _(spark, d):
    return literal.nodes(spark).where("node_id > 1").select(*KEY, navigate.sister().alias("sister_id"))


@query("nav_09_ancestors", "select t tree_id, node node_id, a ancestor_id from anc where d > 0")
def _(spark, d):
    return navigate.ancestry(literal.nodes(spark)).where("distance > 0").select(*KEY, "ancestor_id")


@query("nav_10_frontier", "select t tree_id, a node_id, node frontier_id from anc where d = 1 or (is_leaf and d < 1)")
def _(spark, d):
    return navigate.descend(literal.nodes(spark), 1)


@query("nav_11_level_lists", "select t tree_id, lev as level, array_to_string(list(node order by node), ',') node_list from nd group by all")
def _(spark, d):
    return navigate.by_level(literal.nodes(spark)).select("tree_id", "level", F.concat_ws(",", F.col("node_ids").cast("array<string>")).alias("node_list"))


@query("nav_12_depth", "select t tree_id, a node_id, max(d) as depth from anc group by all")
def _(spark, d):
    return navigate.depths(literal.nodes(spark))


@query("nav_13_population", "select t tree_id, node node_id, pop from pop")
def _(spark, d):
    return navigate.populations(L(spark, d).member)


@query("nav_14_leaf_mask", "select t tree_id, node node_id, is_leaf from nd")
def _(spark, d):
    return literal.nodes(spark).select(*KEY, "is_leaf")


@query("nav_15_numbers", "select t tree_id, node node_id, row_number() over (order by t, case node when 4 then 1 when 5 then 2 when 6 then 3 when 7 then 4 when 2 then 5 when 3 then 6 else 7 end) - 1 node_index from nd")
def _(spark, d):
    return navigate.number(literal.nodes(spark)).select(*KEY, "node_index")


@query("nav_16_summary", "select t tree_id, count(*) nodes, sum(is_leaf::int)::bigint leaves, max(lev) as depth from nd group by t")
def _(spark, d):
    return navigate.summary(literal.nodes(spark))


@query("nav_18_widths", f"select t tree_id, node node_id, {R('case when node = 1 then 1.0 else pop / sum(pop) over (partition by t, node >> 1) end', 6)} as share from pop")
def _(spark, d):
    return navigate.width_shares(navigate.populations(L(spark, d).member)).select(*KEY, r("share", 6).alias("share"))


# -- node statistics -------------------------------------------------------------------------------------------------


@query("nst_01_node_counts", "select t tree_id, node node_id, f feature_id, count(*) n, " + R("sum(v) / count(*)") + " as mean from nv group by all")
def _(spark, d):
    return L(spark, d).values.groupBy(*KEY, "feature_id").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("nst_02_means_medians", f"select t tree_id, node node_id, f feature_id, {R('mean')} as mean, {R('med')} as median from ns")
def _(spark, d):
    return L(spark, d).stats.select(*KEY, "feature_id", r("mean").alias("mean"), r("median").alias("median"))


@query("nst_03_one_feature", f"select t tree_id, node node_id, {R('mean')} as mean, {R('med')} as median from ns where f = 1")
def _(spark, d):
    s = node_stats.node_stats(node_stats.feature(L(spark, d).values, 1))
    return s.select(*KEY, r("mean").alias("mean"), r("median").alias("median"))


@query("nst_04_residuals", f"select t tree_id, node node_id, f feature_id, {R('sum(abs(v - mean)) / count(*)')} mean_abs, {R('sum(abs(v - med)) / count(*)')} median_abs from nv join ns using (t, node, f) group by all")
def _(spark, d):
    f = L(spark, d)
    a = node_stats.residuals(f.values, f.stats).groupBy(*KEY, "feature_id").agg(r(F.avg(F.abs("residual"))).alias("mean_abs"))
    b = node_stats.residuals(f.values, f.stats, "median").groupBy(*KEY, "feature_id").agg(r(F.avg(F.abs("residual"))).alias("median_abs"))
    return a.join(b, [*KEY, "feature_id"])


@query("nst_05_residual_doublet", f"select t tree_id, node node_id, f feature_id, {R('sum(abs(v - mean)) / count(*)')} own, {R('sum(abs(v - coalesce(pmean, 0))) / count(*)')} parent from nv join np using (t, node, f) group by all")
def _(spark, d):
    f = L(spark, d)
    j = node_stats.residual_doublets(f.values, f.stats)
    return j.groupBy(*KEY, "feature_id").agg(r(F.avg(F.abs("own"))).alias("own"), r(F.avg(F.abs("parent"))).alias("parent"))


@query("nst_06_squared_residuals", f"select t tree_id, node node_id, f feature_id, {R('srs / n')} srs from ns")
def _(spark, d):
    return L(spark, d).stats.select(*KEY, "feature_id", r(F.col("srs") / F.col("n")).alias("srs"))


@query("nst_07_squared_doublet", f"select t tree_id, node node_id, f feature_id, {R('srs / n')} own, {R('(srs + n * power(mean - coalesce(pmean, 0), 2)) / n', 3)} parent from np")
def _(spark, d):
    j = node_stats.squared_doublets(L(spark, d).stats)
    return j.select(*KEY, "feature_id", r(F.col("own") / F.col("n")).alias("own"), r(F.col("parent") / F.col("n"), 3).alias("parent"))


@query("nst_08_determination", COD + f" select t tree_id, node node_id, {R('cod', 5)} as cod from cod")
def _(spark, d):
    return node_stats.determination(L(spark, d).stats).select(*KEY, r("cod", 5).alias("cod"))


@query("nst_09_dispersions", f"select t tree_id, node node_id, f feature_id, {R('srs / n', 6)} about_mean, {R('ssme / n', 6)} about_median from ns")
def _(spark, d):
    s = L(spark, d).stats
    a = node_stats.node_dispersions(s).select(*KEY, "feature_id", r("dispersion", 6).alias("about_mean"))
    return a.join(node_stats.node_dispersions(s, "median").select(*KEY, "feature_id", r("dispersion", 6).alias("about_median")), [*KEY, "feature_id"])


@query("nst_10_error_ratio", f"select t tree_id, node node_id, f feature_id, {R('(srs + 1) / (srs + n * power(mean - coalesce(pmean, 0), 2) + 1)', 6)} error_ratio from np")
def _(spark, d):
    return node_stats.error_ratios(L(spark, d).stats).select(*KEY, "feature_id", r("error_ratio", 6).alias("error_ratio"))


@query("nst_11_absolute_gain", f"select a.t tree_id, a.node node_id, a.f feature_id, {R('b.srs / b.n - a.srs / a.n')} gain from ns a join ns b on b.t = a.t and b.f = a.f and b.node = 1")
def _(spark, d):
    return node_stats.absolute_gains(L(spark, d).stats).select(*KEY, "feature_id", r("gain").alias("gain"))


@query("nst_12_local_gain", f"select t tree_id, node node_id, f feature_id, {R('coalesce(psrs / pn - srs / n, 0)')} gain from np")
def _(spark, d):
    return node_stats.local_gains(L(spark, d).stats).select(*KEY, "feature_id", r("gain").alias("gain"))


@query("nst_13_additive_gain", f"select t tree_id, node node_id, f feature_id, {R('med - coalesce(pmed, 0)')} gain from np")
def _(spark, d):
    return node_stats.additive_gains(L(spark, d).stats).select(*KEY, "feature_id", r("gain").alias("gain"))


@query("nst_14_additive_mean_gain", f"select t tree_id, node node_id, f feature_id, {R('g')} gain from gn")
def _(spark, d):
    return node_stats.additive_gains(L(spark, d).stats, "mean").select(*KEY, "feature_id", r("gain").alias("gain"))


@query("nst_15_additive_one_feature", f"select t tree_id, node node_id, {R('g')} gain from gn where f = 0")
def _(spark, d):
    return node_stats.feature(node_stats.additive_gains(L(spark, d).stats, "mean"), 0).select(*KEY, r("gain").alias("gain"))


PART = ", w as (select t, node, f, g * g * n w from gn), bel as (select anc.t, anc.a node, f, sum(w) b from w join anc on anc.t = w.t and anc.node = w.node and d > 0 group by all), par as (select gn.t, gn.node, gn.f, case when is_leaf then g else sign(g) * coalesce(g * g * n / nullif(g * g * n + coalesce(x.b, 0) + coalesce(y.b, 0), 0), 0) end p from gn join nd on nd.t = gn.t and nd.node = gn.node left join bel x on x.t = gn.t and x.node = gn.node and x.f = gn.f left join bel y on y.t = gn.t and y.node = xor(gn.node, 1) and y.f = gn.f and gn.node > 1)"


@query("nst_16_partials", PART + f" select t tree_id, node node_id, f feature_id, {R('p', 5)} as partial from par")
def _(spark, d):
    f = L(spark, d)
    return node_stats.partials(f.stats, f.node_table).select(*KEY, "feature_id", r("partial", 5).alias("partial"))


@query("nst_17_partial_one_feature", PART + f" select t tree_id, node node_id, {R('p', 5)} as partial from par where f = 2")
def _(spark, d):
    f = L(spark, d)
    return node_stats.feature(node_stats.partials(f.stats, f.node_table), 2).select(*KEY, r("partial", 5).alias("partial"))


@query("nst_18_explained", f"select t tree_id, f feature_id, {R('sum(g * g)', 3)} as explained from gn where node > 1 group by all")
def _(spark, d):
    return node_stats.explained(L(spark, d).stats).select("tree_id", "feature_id", r("explained", 3).alias("explained"))


@query("nst_19_absolute_partial", f", e as (select t, f, sum(g * g) e from gn where node > 1 group by all) select t tree_id, node node_id, f feature_id, {R('case when node = 1 then 0 else sign(g) * coalesce(g * g / nullif(e, 0), 0) end', 5)} as partial from gn join e using (t, f)")
def _(spark, d):
    return node_stats.absolute_partials(L(spark, d).stats).select(*KEY, "feature_id", r("partial", 5).alias("partial"))


@query("nst_20_composition", f", {SEG} select t tree_id, node node_id, c cluster_id, {R('count(*) / any_value(pop)', 6)} fraction from mem join lab using (sid) join pop using (t, node) group by t, node, c")
def _(spark, d):
    return node_stats.composition(L(spark, d).member, segments(spark, d)).select(*KEY, "cluster_id", r("fraction", 6).alias("fraction"))


# -- representations -------------------------------------------------------------------------------------------------


@query("rep_01_pca")
def _(spark, d):
    return L(spark, d).node_representation("additive_mean", pca=2).select(*KEY, F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@query("rep_02_sample", "select t tree_id, node node_id, sid item, 1.0::double as value from mem where node > 3")
def _(spark, d):
    return represent.sample_rows(L(spark, d).member).where("node_id > 3")


@query("rep_03_factor", "select t tree_id, node node_id, fac item, 1.0::double as value from fn")
def _(spark, d):
    return represent.factor_rows(L(spark, d).factor_nodes)


@query("rep_04_sister", "select t tree_id, node node_id, sid item, 1.0::double as value from mem where node < 4 union all select t, xor(node, 1)::bigint, sid, -1.0 from mem where node in (2, 3)")
def _(spark, d):
    return represent.sister_rows(L(spark, d).member).where("node_id < 4")


def _rep(name, mode, expr, digits=4, extra=""):
    source = "par" if "par as" in extra else "np"

    @query(name, f"{extra} select t tree_id, node node_id, f item, {R(expr, digits)} as value from {source}")
    def f(spark, d):
        return L(spark, d).node_representation(mode).select(*KEY, "item", r("value", digits).alias("value"))


_rep("rep_06_gain", "gain", "coalesce(psrs / pn - srs / n, 0)")
_rep("rep_07_error_ratio", "error_ratio", "(srs + 1) / (srs + n * power(mean - coalesce(pmean, 0), 2) + 1)", 6)
_rep("rep_08_additive", "additive", "med - coalesce(pmed, 0)")
_rep("rep_09_additive_mean", "additive_mean", "mean - coalesce(pmean, 0)")
_rep("rep_10_mean", "mean", "mean")
_rep("rep_10_median", "median", "med")
_rep("rep_11_partial", "partial", "p", 5, PART)


@query("rep_05_absolute_gain", f"select a.t tree_id, a.node node_id, a.f item, {R('b.srs / b.n - a.srs / a.n')} as value from ns a join ns b on b.t = a.t and b.f = a.f and b.node = 1")
def _(spark, d):
    return L(spark, d).node_representation("absolute_gain").select(*KEY, "item", r("value").alias("value"))


@query("rep_12_weights", "select t tree_id, node node_id, f feature_id, 1.0::double weight from nd, (select unnest([0, 1, 2, 3]) f)")
def _(spark, d):
    f = L(spark, d)
    return represent.weights(f.node_table, f.features)


@query("rep_13_leaf_order")
def _(spark, d):
    v = represent.vectors(L(spark, d).node_representation("mean")).orderBy(*KEY).collect()
    order = represent.leaf_order([list(x.v) for x in v])
    return spark.createDataFrame([(i, v[k].tree_id, v[k].node_id) for i, k in enumerate(order)], "place int, tree_id int, node_id long")


@query("rep_14_sister_distance", ", sr as (select t, node, sid, 1 x from mem union all select t, xor(node, 1)::bigint, sid, -1 from mem where node > 1), sz as (select t, node, count(*) s from sr group by all), dt as (select a.t ta, a.node na, b.t tb, b.node nb, sum(a.x * b.x) dot from sr a join sr b on a.sid = b.sid and (a.t, a.node) < (b.t, b.node) group by all) select ta tree_a, na node_a, tb tree_b, nb node_b, " + R("1 - (dot + least(x.s, y.s)) / (2.0::double * greatest(x.s, y.s))", 6) + " distance from dt join sz x on x.t = ta and x.node = na join sz y on y.t = tb and y.node = nb")
def _(spark, d):
    return represent.sister_distances(represent.sister_rows(L(spark, d).member)).select("tree_a", "node_a", "tree_b", "node_b", r("distance", 6).alias("distance"))


@query("rep_15_cosine", ", v as (select t, node, list(mean order by f) v from ns group by all) select a.t tree_a, a.node node_a, b.t tree_b, b.node node_b, " + R("1 - list_cosine_similarity(a.v, b.v)", 6) + " distance from v a, v b where (a.t, a.node) < (b.t, b.node)")
def _(spark, d):
    v = represent.vectors(L(spark, d).node_representation("mean"))
    return represent.pair_distances(v).select("tree_a", "node_a", "tree_b", "node_b", r("distance", 6).alias("distance"))


@query("rep_15_euclidean", ", v as (select t, node, list(mean order by f) v from ns group by all) select a.t tree_a, a.node node_a, b.t tree_b, b.node node_b, " + R("list_distance(a.v, b.v)", 3) + " distance from v a, v b where (a.t, a.node) < (b.t, b.node)")
def _(spark, d):
    v = represent.vectors(L(spark, d).node_representation("mean"))
    return represent.pair_distances(v, "euclidean").select("tree_a", "node_a", "tree_b", "node_b", r("distance", 3).alias("distance"))


# -- implicit joins --------------------------------------------------------------------------------------------------


@query("jon_02_parent", "select a.t tree_id, a.node node_id, b.node parent_id from nd a join nd b on b.t = a.t and b.node = a.node >> 1")
def _(spark, d):
    n = literal.nodes(spark)
    up = n.select("tree_id", F.col("node_id").alias("parent_id"))
    return n.withColumn("parent_id", navigate.parent()).join(up, ["tree_id", "parent_id"]).select(*KEY, "parent_id")


@query("jon_04_gather", f"select t tree_id, node node_id, f feature_id, {R('sum(v) / count(*)')} mean from nv where node >= 4 group by all")
def _(spark, d):
    f = L(spark, d)
    j = f.member.where("node_id >= 4").join(f.long, "sample_id")
    return j.groupBy(*KEY, "feature_id").agg(r(F.avg("value")).alias("mean"))


@query("jon_07_bag", "select t tree_id, node node_id, count(*) n from mem join (select (p_partkey * 7919 + 13 * p_partkey * p_partkey) % (select count(*) from part) + 1 sid from part) using (sid) group by all")
def _(spark, d):
    f = L(spark, d)
    # As many draws as samples, with replacement, from all of them: keys run from 1.
    n = f.samples.count()
    bag = f.samples.select(F.pmod(F.expr("sample_id * 7919 + 13 * sample_id * sample_id"), F.lit(n)).alias("k")).select((F.col("k") + 1).alias("sample_id"))
    return navigate.populations(f.member.join(bag, "sample_id")).withColumnRenamed("pop", "n")


# -- clustering ------------------------------------------------------------------------------------------------------


@query("clu_01_knn_cosine", "select id, neighbour, rank from (select a.vec_id id, b.vec_id neighbour, row_number() over (partition by a.vec_id order by round(1 - list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id != b.vec_id) where rank <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return knn.knn(e, 10).select("id", "neighbour", "rank")


@query("clu_02_double_knn", "select id, neighbour, rank from (select a.vec_id id, b.vec_id neighbour, row_number() over (partition by a.vec_id order by round((list_distance(a.embedding[1:32]::double[], b.embedding[1:32]::double[]) + list_distance(a.embedding[33:64]::double[], b.embedding[33:64]::double[])) / 2, 9), b.vec_id) as rank from embeddings a, embeddings b where a.vec_id != b.vec_id) where rank <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    return knn.knn(e.select("id", F.slice("e", 1, 32).alias("v"), F.slice("e", 33, 32).alias("v2")), 10, "euclidean").select("id", "neighbour", "rank")


@query("clu_03_modularity", ", e as (select vec_id src, (vec_id * 7 + 3) % (select count(*) from embeddings) dst from embeddings), l as (select vec_id id, label from embeddings), j as (select a.label ls, b.label ld from e join l a on a.id = src join l b on b.id = dst), dg as (select lab, count(*) d from (select ls lab from j union all select ld from j) group by lab) select " + R("(select sum((ls = ld)::int) / count(*) from j) - 1.0 * sum(d * d) / (4.0::double * power((select count(*) from j), 2))", 6) + " modularity from dg")
def _(spark, d):
    e = table(spark, d, "embeddings")
    n = e.count()
    edges = e.select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % n).alias("dst"))
    return community.modularity(edges, e.select(F.col("vec_id").alias("id"), "label")).select(r("modularity", 6).alias("modularity"))


@query("clu_03_communities")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = knn.knn(e, 10).select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    return community.communities(near, e.select("id"))


@query("clu_04_interpret_splits")
def _(spark, d):
    return L(spark, d).interpret_splits(mode="additive_mean", k=4)


@query("clu_05_propagate", ", l as (select t, node, 10 + node fac from nd where node in (1, 3)) select anc.t tree_id, anc.node node_id, arg_min(fac, d) factor_id from anc join l on l.t = anc.t and l.node = anc.a group by all")
def _(spark, d):
    n = literal.nodes(spark)
    return factors.propagate(n.where("node_id in (1, 3)").select(*KEY, (F.col("node_id") + 10).alias("factor_id")), n)


@query("clu_06_external", "select case when node = 1 then 0 else node % 2 + 1 end::int factor_id, t tree_id, node node_id from nd")
def _(spark, d):
    n = literal.nodes(spark)
    return factors.external_labels(n.select(*KEY, (F.col("node_id") % 2).cast("int").alias("factor_id")), n)


@query("clu_07_root_factor", "select 0 factor_id, t tree_id, node node_id from nd where node = 1")
def _(spark, d):
    return literal.nodes(spark).where("node_id = 1").select(F.lit(0).alias("factor_id"), *KEY)


@query("clu_09_split_labels", "select t tree_id, node node_id, fac factor_id from fn where lev <= 1")
def _(spark, d):
    f = L(spark, d)
    return f.factor_nodes.join(navigate.nodes(f.node_table, True, 1).select(*KEY), KEY, "left_semi").select(*KEY, "factor_id")


@query("clu_11_sample_labels", f", {SEG} select c cluster_id, count(*) n from lab group by c")
def _(spark, d):
    f = L(spark, d)
    f.set_sample_labels(segments(spark, d))
    return f.sample_labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("clu_12_cluster_samples")
def _(spark, d):
    return L(spark, d).cluster_samples_simple(k=8, metric="euclidean", method="louvain_rounds")


@query("clu_13_cluster_encoding")
def _(spark, d):
    return L(spark, d).cluster_samples_encoding(k=8, method="louvain_rounds")


LEAFL = "ll as (select t, node, (t + node) % 3 lc from nd where is_leaf)"


def leaf_labels(spark):
    return literal.nodes(spark).where("is_leaf").select(*KEY, ((F.col("tree_id") + F.col("node_id")) % 3).alias("leaf_cluster"))


@query("clu_08_leaf_labels", f", {LEAFL} select lc leaf_cluster, count(*) n from ll group by lc")
def _(spark, d):
    return leaf_labels(spark).groupBy("leaf_cluster").agg(F.count(F.lit(1)).alias("n"))


@query("clu_14_by_leaf_cluster", f", {LEAFL}, sz as (select lc, count(*) s from ll group by lc), h as (select sid, lc, count(*) k from mem join ll using (t, node) group by all) select sid sample_id, arg_max(lc, struct_pack(a := k::double / s, b := -lc)) cluster_id from h join sz using (lc) group by sid")
def _(spark, d):
    return samples.by_leaf_cluster(L(spark, d).member, leaf_labels(spark))


@query("clu_15_by_factor", ", h as (select sid, fac, count(*) k from mem join fn using (t, node) where fac in (2, 3) group by all) select sid sample_id, arg_max(fac, struct_pack(a := k, b := -fac)) factor_id from h group by sid")
def _(spark, d):
    f = L(spark, d)
    leaf = spark.createDataFrame([(2,), (3,)], "factor_id int")
    return samples.by_factor(factors.sample_counts(f.member, f.factor_nodes), leaf)


@query("clu_16_features", f"select f feature_id, {R('avg(v)')} as mean from (select sid, case f when 1 then 0 when 2 then 1 when 3 then 2 end f, v from lng where f > 0 union all select sid, 3, x[1] * 2 from m) group by f")
def _(spark, d):
    f = L(spark, d)
    g = f.add_output_feature("twice", f.outputs.select("sample_id", (F.col("x")[0] * 2).alias("v")), "v").remove_output_feature("size")
    return g.long.groupBy("feature_id").agg(r(F.avg("value")).alias("mean"))


# -- factors ---------------------------------------------------------------------------------------------------------

OWN = ", sz as (select fac, count(*) s from fn group by fac), ow as (select fac, sid, count(*) k from mem join fn using (t, node) group by all), sis as (select fac, t, xor(node, 1)::bigint node from fn where node > 1), si as (select fac, sid, count(*) k from mem join sis using (t, node) group by all), grid as (select fac, sid, s from sz, m), fs as (select fac, sid, s, coalesce(ow.k, 0) o, coalesce(si.k, 0) i from grid left join ow using (fac, sid) left join si using (fac, sid))"


@query("fac_02_encoding", "select fac factor_id, t tree_id, node node_id, count(*) n from mem join fn using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    return f.member.join(f.factor_nodes, KEY).groupBy("factor_id", *KEY).agg(F.count(F.lit(1)).alias("n"))


@query("fac_03_relatives", "select 'sister' kind, fac factor_id, t tree_id, xor(node, 1)::bigint node_id from fn where node > 1 union all select 'parent', fac, t, node >> 1 from fn where node > 1 union all select 'child', fn.fac, anc.t, anc.node from fn join anc on anc.t = fn.t and anc.a = fn.node where d > 0 union all select 'ancestor', fn.fac, anc.t, anc.a from fn join anc on anc.t = fn.t and anc.node = fn.node where d > 0")
def _(spark, d):
    f = L(spark, d)
    kinds = {"sister": factors.sisters(f.factor_nodes), "parent": factors.parents(f.factor_nodes), "child": factors.children(f.factor_nodes, f.node_table), "ancestor": factors.ancestors(f.factor_nodes)}
    out = None
    for k, t in kinds.items():
        t = t.select(F.lit(k).alias("kind"), "factor_id", *KEY)
        out = t if out is None else out.union(t)
    return out


@query("fac_04_sample_score", OWN + f" select fac factor_id, sid sample_id, {R('o::double / (s + 1)', 6)} score from fs")
def _(spark, d):
    f = L(spark, d)
    return factors.sample_scores(f.member, f.factor_nodes, f.samples).select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("fac_05_parent_score", ", pn as (select fac, t, node >> 1 node from fn where node > 1 union all select fac, t, node from fn where node = 1), sz as (select fac, count(*) s from pn group by fac), k as (select fac, sid, count(*) k from mem join pn using (t, node) group by all) select fac factor_id, sid sample_id, " + R("coalesce(k, 0)::double / (s + 1)", 6) + " score from sz cross join m left join k using (fac, sid)")
def _(spark, d):
    f = L(spark, d)
    return factors.parent_scores(f.member, f.factor_nodes, f.samples).select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("fac_06_sample_count", OWN + " select fac factor_id, sid sample_id, k as count from ow")
def _(spark, d):
    f = L(spark, d)
    return factors.sample_counts(f.member, f.factor_nodes)


@query("fac_07_sister_score", OWN + f" select fac factor_id, sid sample_id, {R('(o - i)::double / s', 6)} score from fs")
def _(spark, d):
    f = L(spark, d)
    return factors.sister_scores(f.member, f.factor_nodes, f.samples).select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("fac_08_log_sister_score", OWN + f" select fac factor_id, sid sample_id, {R('ln((o + 1)::double / (i + 1))', 6)} score from fs")
def _(spark, d):
    f = L(spark, d)
    return factors.sister_scores(f.member, f.factor_nodes, f.samples, 1.0).select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("fac_09_predicted_sister_score", OWN + f" select fac factor_id, sid sample_id, {R('(o - i)::double / s', 6)} score from fs where sid % 2 = 1")
def _(spark, d):
    f = L(spark, d)
    p = f.predict(literal.cohorts(spark, d)[1])
    return factors.sister_scores(p.member, f.factor_nodes, p.data.select("sample_id")).select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("fac_10_factor_matrix", OWN + f" select fac factor_id, {R('sum(((o - i)::double / s) * ((o - i)::double / s)) / count(*)', 6)} power from fs group by fac")
def _(spark, d):
    return L(spark, d).factor_matrix().groupBy("factor_id").agg(r(F.avg(F.col("score") * F.col("score")), 6).alias("power"))


@query("fac_11_factor_features", PART + f" select fac factor_id, f feature_id, {R('avg(p)', 5)} as value from par join fn using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    return factors.factor_features(node_stats.partials(f.stats, f.node_table), f.factor_nodes, "partial").select("factor_id", "feature_id", r("value", 5).alias("value"))


@query("fac_11_factor_means", f"select fac factor_id, f feature_id, {R('avg(mean)')} as value from ns join fn using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    return factors.factor_features(f.stats, f.factor_nodes, "mean").select("factor_id", "feature_id", r("value").alias("value"))


@query("fac_12_one_feature", f"select fac factor_id, {R('avg(g)')} as value from gn join fn using (t, node) where f = 1 group by fac")
def _(spark, d):
    f = L(spark, d)
    return factors.factor_features(node_stats.additive_gains(f.stats, "mean"), f.factor_nodes, "gain", [1]).select("factor_id", r("value").alias("value"))


@query("fac_13_levels", f"select fac factor_id, {R('avg(lev)')} mean_level, {R('avg(pop)', 3)} mean_population from fn join pop using (t, node) group by fac")
def _(spark, d):
    f = L(spark, d)
    return factors.factor_levels(f.node_table, f.factor_nodes, navigate.populations(f.member)).select("factor_id", r("mean_level").alias("mean_level"), r("mean_population", 3).alias("mean_population"))


CHG = ", a as (select fac, f, avg(mean) m from ns join fn using (t, node) group by all), s as (select fac, t, xor(node, 1)::bigint node from fn where node > 1), b as (select fac, f, avg(mean) m from ns join s using (t, node) group by all), pr as (select fac, t, node >> 1 node from fn where node > 1), c as (select fac, f, avg(mean) m from ns join pr using (t, node) group by all), rt as (select distinct fac, nd.t, nd.node from fn, nd where nd.node = 1), e as (select fac, f, avg(mean) m from ns join rt using (t, node) group by all)"


@query("fac_14_absolute_change", CHG + f" select fac factor_id, f feature_id, {R('a.m - b.m')} change from a join b using (fac, f)")
def _(spark, d):
    f = L(spark, d)
    return factors.changed(f.stats, f.factor_nodes, f.node_table).select("factor_id", "feature_id", r("change").alias("change"))


@query("fac_15_log_fold", CHG + f" select fac factor_id, f feature_id, {R('log2(a.m / b.m)', 6)} change from a join b using (fac, f)")
def _(spark, d):
    f = L(spark, d)
    return factors.changed(f.stats, f.factor_nodes, f.node_table, how="log").select("factor_id", "feature_id", r("change", 6).alias("change"))


@query("fac_16_logistic_change")
def _(spark, d):
    f = L(spark, d)
    a, b = (f.factor_nodes.where(F.col("factor_id") == k) for k in (2, 3))
    return factors.logistic_change(f.stats, a, b)


@query("fac_17_changed_root_parent", CHG + f" select 'root' versus, fac factor_id, f feature_id, {R('a.m - e.m')} change from a join e using (fac, f) union all select 'parent', fac, f, {R('a.m - c.m')} from a join c using (fac, f)")
def _(spark, d):
    f = L(spark, d)
    out = [factors.changed(f.stats, f.factor_nodes, f.node_table, v).select(F.lit(v).alias("versus"), "factor_id", "feature_id", r("change").alias("change")) for v in ("root", "parent")]
    return out[0].union(out[1])


@query("srt_01_sorted_change", CHG + f" select f feature_id, row_number() over (order by a.m - b.m, f) as rank, {R('a.m - b.m')} change from a join b using (fac, f) where fac = 2")
def _(spark, d):
    from pyspark.sql import Window

    f = L(spark, d)
    c = factors.changed(f.stats, f.factor_nodes, f.node_table).where("factor_id = 2")
    return c.select("feature_id", F.row_number().over(Window.orderBy("change", "feature_id")).alias("rank"), r("change").alias("change"))


@query("fac_18_coordinates", OWN + f", sc as (select fac, sid, (o - i)::double / s z from fs) select fac factor_id, {R('sum(z * z * x[1]) / nullif(sum(z * z), 0)')} c0, {R('sum(z * z * x[4]) / nullif(sum(z * z), 0)')} c1 from sc join m using (sid) group by fac")
def _(spark, d):
    f = L(spark, d)
    pts = f.outputs.select("sample_id", F.col("x")[0].alias("c0"), F.col("x")[3].alias("c1"))
    return factors.coordinates(f.factor_matrix(), pts).select("factor_id", r("c0").alias("c0"), r("c1").alias("c1"))


@query("fac_19_regression")
def _(spark, d):
    f = L(spark, d)
    return factors.linear_regression(f.factor_matrix(), f.long, 2).select("feature_id", r("coefficient", 3).alias("coefficient"))


@query("fac_20_top_split_features")
def _(spark, d):
    f = L(spark, d)
    return factors.top_split_features(f.factor_matrix(), f.long, 2, 2).select("feature_id")


@query("fac_21_error_ratio", ", ow as (select fac, sid, count(*) k from mem join fn using (t, node) group by all), pn as (select fac, t, node >> 1 node from fn where node > 1 union all select fac, t, node from fn where node = 1), pw as (select fac, sid, count(*) k from mem join pn using (t, node) group by all), sz as (select fac, count(*) s from fn group by fac), a as (select fac, f, sum(k * v * v / (s + 1.0::double)) - power(sum(k * v / (s + 1.0::double)), 2) / sum(k / (s + 1.0::double)) e from ow join sz using (fac) join lng using (sid) group by all), b as (select fac, f, sum(k * v * v / (s + 1.0::double)) - power(sum(k * v / (s + 1.0::double)), 2) / sum(k / (s + 1.0::double)) e from pw join sz using (fac) join lng using (sid) group by all) select fac factor_id, f feature_id, " + R("(a.e + 1) / (b.e + 1)", 5) + " error_ratio from a join b using (fac, f)")
def _(spark, d):
    f = L(spark, d)
    own, up = (g(f.member, f.factor_nodes, f.samples) for g in (factors.sample_scores, factors.parent_scores))
    return factors.error_ratio(f.long, own, up).select("factor_id", "feature_id", r("error_ratio", 5).alias("error_ratio"))


@query("fac_22_strict_errors", f"select fac factor_id, f feature_id, {R('(sum(srs) + 1) / (sum(srs + n * power(mean - coalesce(pmean, 0), 2)) + 1)', 6)} error_ratio from np join fn using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    return factors.strict_errors(node_stats.squared_doublets(f.stats), f.factor_nodes).select("factor_id", "feature_id", r("error_ratio", 6).alias("error_ratio"))


@query("fac_23_important", CHG + ", z as (select fac, f, a.m - b.m c from a join b using (fac, f)), k as (select *, row_number() over (partition by fac order by c, f) lo, row_number() over (partition by fac order by c desc, f desc) hi from z) select fac factor_id, f feature_id from k where lo <= 1 or hi <= 1")
def _(spark, d):
    f = L(spark, d)
    return factors.top_and_bottom(factors.changed(f.stats, f.factor_nodes, f.node_table), ["factor_id"], "change", 1).select("factor_id", "feature_id")


LOC = ", c as (select sid, count(*) w from mem join fn using (t, node) where fac = 2 group by sid), p as (select sid, i, j, x[i + 1] a, x[j + 1] b from m, (select unnest([0,1,2,3]) i), (select unnest([0,1,2,3]) j) where i <= j), lw as (select i, j, sum(w) w, sum(w*a) sa, sum(w*b) sb, sum(w*a*a) saa, sum(w*b*b) sbb, sum(w*a*b) sab from p join c using (sid) group by i, j), lc as (select i, j, case when i = j then 1 else coalesce((sab - sa*sb/w) / nullif(sqrt((saa - sa*sa/w) * (sbb - sb*sb/w)), 0), 0) end r from lw), gc as (select i, j, case when i = j then 1 else coalesce(corr(a, b), 0) end r from p group by i, j)"


@query("fac_24_local_correlation", LOC + f" select i, j, {R('r', 5)} as r from lc")
def _(spark, d):
    f = L(spark, d)
    return factors.local_correlations(f.member, f.factor_nodes, f.long, 2).select("i", "j", r("r", 5).alias("r"))


@query("fac_25_local_pairs", LOC + f" select i, j, {R('(lc.r - gc.r) * lc.r', 5)} difference from lc join gc using (i, j) where i < j")
def _(spark, d):
    f = L(spark, d)
    local = factors.local_correlations(f.member, f.factor_nodes, f.long, 2)
    return factors.local_against_global(local, S.correlation(f.long)).select("i", "j", r("difference", 5).alias("difference"))


@query("srt_03_top_pairs", LOC + " select i, j from lc join gc using (i, j) where i < j order by abs((lc.r - gc.r) * lc.r) desc limit 3")
def _(spark, d):
    f = L(spark, d)
    local = factors.local_correlations(f.member, f.factor_nodes, f.long, 2)
    return factors.local_against_global(local, S.correlation(f.long), 3).select("i", "j")


@query("fac_26_tables", LOC + f" select i, j, {R('lc.r', 3)} as local, {R('gc.r', 3)} as overall from lc join gc using (i, j) where i < j")
def _(spark, d):
    f = L(spark, d)
    local = factors.local_correlations(f.member, f.factor_nodes, f.long, 2)
    return factors.local_against_global(local, S.correlation(f.long)).select("i", "j", r("local", 3).alias("local"), r("overall", 3).alias("overall"))


@query("fac_27_cluster_frequency", f", {SEG} select fac factor_id, c cluster_id, count(*) as count from mem join fn using (t, node) join lab using (sid) group by all")
def _(spark, d):
    f = L(spark, d)
    return factors.cluster_frequencies(factors.sample_counts(f.member, f.factor_nodes), segments(spark, d))


@query("fac_29_summary", f"select fac factor_id, {R('avg(lev)')} mean_level from fn join pop using (t, node) group by fac")
def _(spark, d):
    f = L(spark, d)
    levels = factors.factor_levels(f.node_table, f.factor_nodes, navigate.populations(f.member))
    js = factors.summaries(levels, factors.changed(f.stats, f.factor_nodes, f.node_table))
    return js.select("factor_id", r(F.get_json_object("summary", "$.mean_level").cast("double")).alias("mean_level"))


# -- sample clusters -------------------------------------------------------------------------------------------------


@query("smp_02_cluster_features", f", {SEG} select c cluster_id, f feature_id, {R('avg(v)')} mean, {R('median(v)')} median from lng join lab using (sid) group by all")
def _(spark, d):
    return samples.cluster_features(L(spark, d).long, segments(spark, d)).select("cluster_id", "feature_id", r("mean").alias("mean"), r("median").alias("median"))


@query("smp_01_mask", f", {SEG} select sid sample_id from lab where c = 1")
def _(spark, d):
    return segments(spark, d).where("cluster_id = 1").select("sample_id")


@query("smp_03_shift", f", {SEG} select c cluster_id, f feature_id, {R('avg(v) - (select avg(v) from lng)')} as shift from lng join lab using (sid) group by all")
def _(spark, d):
    return samples.feature_shift(L(spark, d).long, segments(spark, d)).select("cluster_id", "feature_id", r("shift").alias("shift"))


@query("smp_04_logistic")
def _(spark, d):
    return samples.logistic_features(L(spark, d).long, segments(spark, d), 1, 4).select("feature_id")


@query("smp_05_leaf_counts", f", {SEG} select c cluster_id, t tree_id, node node_id, count(*) as count from mem join nd using (t, node) join lab using (sid) where is_leaf group by all")
def _(spark, d):
    f = L(spark, d)
    return samples.leaf_counts(f.member, f.node_table, segments(spark, d))


@query("smp_05_leaf_cluster_frequency", f", {SEG}, {LEAFL} select c cluster_id, lc leaf_cluster, count(*)::bigint as count from mem join ll using (t, node) join lab using (sid) group by all")
def _(spark, d):
    f = L(spark, d)
    return samples.leaf_cluster_frequencies(samples.leaf_counts(f.member, f.node_table, segments(spark, d)), leaf_labels(spark))


@query("smp_06_cluster_matrix", f", {SEG} select c cluster_id, f feature_id, {R('avg(v)')} mean from lng join lab using (sid) where f in (0, 3) group by all")
def _(spark, d):
    return samples.cluster_features(L(spark, d).long.where("feature_id in (0, 3)"), segments(spark, d)).select("cluster_id", "feature_id", r("mean").alias("mean"))


# -- consensus -------------------------------------------------------------------------------------------------------

TRN = ", tr as (select a.fac::int as source, b.fac::int target, count(*) as count from fn a join fn b on b.t = a.t and b.node >> 1 = a.node group by all union all select fac, null, count(*) from fn where is_leaf group by fac union all select null, fac, count(*) from fn where node = 1 group by fac)"


@query("con_01_transitions", TRN + " select * from tr")
def _(spark, d):
    f = L(spark, d)
    return consensus.transitions(f.factor_nodes, f.node_table)


@query("con_02_co_occurrence", "select u.fac upstream, w.fac downstream, count(*) as count from anc join fn u on u.t = anc.t and u.node = anc.a join fn w on w.t = anc.t and w.node = anc.node where anc.d > 0 group by all")
def _(spark, d):
    f = L(spark, d)
    return consensus.co_occurrence(f.factor_nodes, f.node_table)


@query("con_03_paths", "select fac factor_id, t tree_id, node node_id from fn")
def _(spark, d):
    return L(spark, d).factor_nodes


@query("con_04_partial_dependence")
def _(spark, d):
    return consensus.partial_dependence(L(spark, d).factor_matrix()).select("i", "j", r("value").alias("value"))


@query("con_05_odds", ", un as (select anc.t, anc.a, anc.d, fn.fac other from anc join fn on fn.t = anc.t and fn.node = anc.node), b as (select fn.fac, other, count(*) d from un join fn on fn.t = un.t and fn.node = un.a where un.d > 0 group by all), s as (select fn.fac, other, count(*) s from un join fn on fn.t = un.t and xor(fn.node, 1) = un.a and fn.node > 1 group by all), nb as (select fac, sum(d) d from b group by fac), nn as (select fac, sum(s) s from s group by fac), ids as (select distinct fac from fn) select i.fac factor_id, o.fac other, " + R("case when i.fac = 0 then 1 else ((coalesce(b.d, 0) + 1)::double / (coalesce(nb.d, 0) + 1)) / ((coalesce(s.s, 0) + 1)::double / (coalesce(nn.s, 0) + 1)) end", 6) + " odds from ids i cross join ids o left join b on b.fac = i.fac and b.other = o.fac left join s on s.fac = i.fac and s.other = o.fac left join nb on nb.fac = i.fac left join nn on nn.fac = i.fac")
def _(spark, d):
    f = L(spark, d)
    return consensus.odds_ratios(f.factor_nodes, f.node_table).select("factor_id", "other", r("odds", 6).alias("odds"))


@query("con_07_most_likely_tree", TRN + " select target factor_id, arg_max(source, struct_pack(a := count, b := -source)) parent_factor_id from tr where source is not null and target is not null and source != target and target != 0 group by target")
def _(spark, d):
    return L(spark, d).most_likely_tree()


SIM = OWN + ", pn as (select fac, t, node >> 1 node from fn where node > 1 union all select fac, t, node from fn where node = 1), psz as (select fac, count(*) s from pn group by fac), pk as (select fac, sid, count(*) k from mem join pn using (t, node) group by all), a as (select fac, sid, o::double / (s + 1) z from fs), b as (select fac, sid, coalesce(k, 0)::double / (s + 1) z from psz cross join m left join pk using (fac, sid)), az as (select fac, sid, z / nullif(sum(z) over (partition by sid), 0) z from a), bz as (select fac, sid, z / nullif(sum(z) over (partition by sid), 0) z from b), we as (select x.fac i, y.fac j, sum(x.z * y.z) / (sqrt(sum(x.z * x.z)) * sqrt(sum(y.z * y.z))) w from az x join bz y using (sid) where x.fac != y.fac group by x.fac, y.fac)"


@query("con_08_edge_weights", SIM + f" select i, j, {R('w', 5)} weight from we where w > 0")
def _(spark, d):
    f = L(spark, d)
    own, up = (g(f.member, f.factor_nodes, f.samples) for g in (factors.sample_scores, factors.parent_scores))
    return consensus.sample_similarity(own, up).where("weight > 0").select("i", "j", r("weight", 5).alias("weight"))


@query("con_08_spanning_tree")
def _(spark, d):
    return L(spark, d).maximum_spanning_tree()


_TREE = [(0, None), (1, 0), (2, 0), (3, 1)]


def _tree(spark):
    return spark.createDataFrame(_TREE, "factor_id int, parent_factor_id int")


@query("con_06_root_paths", ", recursive_dummy as (select 1) select * from (values (0, '0'), (1, '1,0'), (2, '2,0'), (3, '3,1,0')) z(factor_id, path)")
def _(spark, d):
    return consensus.paths(_tree(spark)).select("factor_id", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query("con_09_relatives", "select * from (values (0, null, '1,2', ''), (1, 0, '3', '2'), (2, 0, '', '1'), (3, 1, '', '')) z(factor_id, parent, children, siblings)")
def _(spark, d):
    j = consensus.relatives(_tree(spark))
    return j.select("factor_id", "parent", *[F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("children", "siblings")])


@query("con_10_leaf_factors", "select * from (values (2), (3)) z(factor_id)")
def _(spark, d):
    return consensus.tree_leaves(_tree(spark))


@query("con_11_layout", "select * from (values (0, 0.5::double, 0.0::double), (1, 0.0, -1.0), (2, 1.0, -1.0), (3, 0.0, -2.0)) z(factor_id, x, y)")
def _(spark, d):
    return consensus.layout(_tree(spark))


# -- predictions -----------------------------------------------------------------------------------------------------

LM = ", lm as (select sid, f, avg(mean) p, avg(med) q from leaf join ns on ns.t = leaf.t and ns.node = leaf.leaf group by all)"


@query("prd_02_encodings", f"select t tree_id, node node_id, f feature_id, {R('mean')} mean, {R('med')} median, {R('mean - coalesce(pmean, 0)')} additive from np")
def _(spark, d):
    f = L(spark, d)
    g = node_stats.additive_gains(f.stats, "mean").select(*KEY, "feature_id", r("gain").alias("additive"))
    return f.stats.select(*KEY, "feature_id", r("mean").alias("mean"), r("median").alias("median")).join(g, [*KEY, "feature_id"])


@query("prd_03_additive", LM + f" select sid sample_id, f feature_id, {R('p', 3)} prediction from lm")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).prediction().select("sample_id", "feature_id", r("prediction", 3).alias("prediction"))


@query("prd_04_mean_median", LM + f" select sid sample_id, f feature_id, {R('p', 3)} mean, {R('q', 3)} median from lm")
def _(spark, d):
    f = L(spark, d)
    p = f.predict(f.inputs)
    a = p.prediction("mean").select("sample_id", "feature_id", r("prediction", 3).alias("mean"))
    return a.join(p.prediction("median").select("sample_id", "feature_id", r("prediction", 3).alias("median")), ["sample_id", "feature_id"])


@query("prd_04_masked_mean", f"select sid sample_id, f feature_id, {R('avg(mean)', 3)} prediction from mem join ns using (t, node) where node in (2, 3) group by all")
def _(spark, d):
    f = L(spark, d)
    return predict.node_average(f.member, f.stats, "mean", f.node_table.where("node_id in (2, 3)")).select("sample_id", "feature_id", r("prediction", 3).alias("prediction"))


@query("prd_05_modes", LM + ", md as (select sid, f, sum(s) / 3 p from (select leaf.sid, leaf.t, np.f, sum(np.med - coalesce(np.pmed, 0)) s from leaf join anc on anc.t = leaf.t and anc.node = leaf.leaf join np on np.t = anc.t and np.node = anc.a group by all) group by all) select sid sample_id, f feature_id, " + R("p", 3) + " prediction from md")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).prediction("additive").select("sample_id", "feature_id", r("prediction", 3).alias("prediction"))


@query("prd_06_node_sample_error", f"select t tree_id, node node_id, sid sample_id, {R('sum((v - mean) * (v - mean))', 2)} as error from nv join ns using (t, node, f) where node > 3 group by all")
def _(spark, d):
    f = L(spark, d)
    return predict.node_sample_errors(f.values.where("node_id > 3"), f.stats).select(*KEY, "sample_id", r("error", 2).alias("error"))


ODD = ", ov as (select * from nv where sid % 2 = 1), oe as (select t, node, f, count(*) n, sum((v - mean) * (v - mean)) own, sum((v - coalesce(pmean, 0)) * (v - coalesce(pmean, 0))) parent from ov join np using (t, node, f) group by all)"


@query("prd_07_node_feature_error", ODD + f" select t tree_id, node node_id, f feature_id, n, {R('own / n', 3)} own from oe")
def _(spark, d):
    p = L(spark, d).predict(literal.cohorts(spark, d)[1])
    return p.node_errors().select(*KEY, "feature_id", "n", r(F.col("own") / F.col("n"), 3).alias("own"))


OM = ODD + ", om as (select nd.t, nd.node, z.f, avg(v) mean from nd cross join (select unnest([0,1,2,3]) f) z left join ov on ov.t = nd.t and ov.node = nd.node and ov.f = z.f group by all)"


@query("prd_08_observed_means", OM + f" select t tree_id, node node_id, f feature_id, {R('coalesce(mean, 0)')} as mean from om")
def _(spark, d):
    f = L(spark, d)
    p = f.predict(literal.cohorts(spark, d)[1])
    return predict.observed_means(p.values, f.node_table, f.features).select(*KEY, "feature_id", r("mean").alias("mean"))


@query("prd_09_observed_marginals", OM + f" select a.t tree_id, a.node node_id, a.f feature_id, {R('coalesce(a.mean - b.mean, 0)')} marginal from om a join om b on b.t = a.t and b.node = a.node >> 1 and b.f = a.f")
def _(spark, d):
    f = L(spark, d)
    p = f.predict(literal.cohorts(spark, d)[1])
    return predict.observed_marginals(predict.observed_means(p.values, f.node_table, f.features)).select(*KEY, "feature_id", r("marginal").alias("marginal"))


RES = LM + ", rs as (select sid, f, v, v - p e from lng join lm using (sid, f))"


@query("prd_10_residuals", RES + f" select sid sample_id, f feature_id, {R('e', 3)} residual from rs")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).residuals().select("sample_id", "feature_id", r("residual", 3).alias("residual"))


@query("prd_11_node_mse", ODD + f" select t tree_id, node node_id, {R('sum(own) / sum(n)', 3)} mse from oe group by all")
def _(spark, d):
    p = L(spark, d).predict(literal.cohorts(spark, d)[1])
    return predict.node_mse(p.node_errors()).select(*KEY, r("mse", 3).alias("mse"))


@query("prd_12_fractions", ", k as (select nd.t, nd.node, count(sid) k from nd left join (select * from mem where sid % 2 = 1) z on z.t = nd.t and z.node = nd.node group by all) select a.t tree_id, a.node node_id, " + R("case when a.node = 1 then 1 else coalesce(a.k::double / nullif(b.k, 0), 0) end", 6) + " fraction from k a left join k b on b.t = a.t and b.node = a.node >> 1")
def _(spark, d):
    f = L(spark, d)
    p = f.predict(literal.cohorts(spark, d)[1])
    return predict.node_fractions(navigate.populations(p.member), f.node_table).select(*KEY, r("fraction", 6).alias("fraction"))


@query("prd_13_doublets", ODD + f" select t tree_id, node node_id, {R('sum(own) / sum(parent)', 5)} as ratio from oe group by all")
def _(spark, d):
    e = L(spark, d).predict(literal.cohorts(spark, d)[1]).node_errors()
    return e.groupBy(*KEY).agg(r(F.sum("own") / F.sum("parent"), 5).alias("ratio"))


@query("prd_14_factor_errors", ODD + f" select fac factor_id, f feature_id, {R('sum(own) / sum(parent)', 5)} as ratio from oe join fn using (t, node) group by all")
def _(spark, d):
    f = L(spark, d)
    e = predict.factor_errors(f.predict(literal.cohorts(spark, d)[1]).node_errors(), f.factor_nodes)
    return e.select("factor_id", "feature_id", r(F.col("own") / F.col("parent"), 5).alias("ratio"))


NM = ODD + ", nm as (select t, node, sum(own) / sum(n) mse from oe group by all)"


@query("prd_15_factor_mse", NM + f" select fac factor_id, {R('avg(mse)', 3)} mean, {R('var_pop(mse)', 1)} variance, {R('quantile_cont(mse, 0.95) - quantile_cont(mse, 0.05)', 3)} as range from nm join fn using (t, node) group by fac")
def _(spark, d):
    f = L(spark, d)
    m = predict.node_mse(f.predict(literal.cohorts(spark, d)[1]).node_errors())
    return predict.factor_mse(m, f.factor_nodes).select("factor_id", r("mean", 3).alias("mean"), r("variance", 1).alias("variance"), r("range", 3).alias("range"))


@query("prd_16_jackknife", NM + f", j as (select fac, coalesce((sum(mse) over (partition by fac) - mse) / nullif(count(*) over (partition by fac) - 1, 0), 0) l from nm join fn using (t, node)) select fac factor_id, {R('avg(l)', 3)} estimate, {R('var_pop(l) * (count(*) - 1)', 2)} variance from j group by fac")
def _(spark, d):
    f = L(spark, d)
    m = predict.node_mse(f.predict(literal.cohorts(spark, d)[1]).node_errors())
    return predict.jackknife_factor_mse(m, f.factor_nodes).select("factor_id", r("estimate", 3).alias("estimate"), r("variance", 2).alias("variance"))


@query("prd_17_sample_clusters", f", {SEG}, cm as (select t, node, c, count(*)::double / any_value(pop) f from mem join lab using (sid) join pop using (t, node) group by t, node, c), sh as (select sid, c, round(sum(f), 9) s from leaf join cm on cm.t = leaf.t and cm.node = leaf.leaf group by all) select sid sample_id, arg_max(c, struct_pack(a := s, b := -c)) cluster_id from sh group by sid")
def _(spark, d):
    f = L(spark, d)
    f.set_sample_labels(segments(spark, d))
    return f.predict(f.inputs).sample_clusters()


@query("prd_18_factor_matrix", OWN + f" select fac factor_id, sid sample_id, {R('case when fac = 0 then 1 else (o - i)::double / s end', 6)} score from fs")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).factor_matrix().select("factor_id", "sample_id", r("score", 6).alias("score"))


@query("prd_19_report", RES + f", g as (select *, v - avg(v) over (partition by f) z from rs) select {R('sum(e * e) / sum(z * z)', 6)} squared, {R('sum(abs(e)) / sum(abs(z))', 6)} absolute from g")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).report().select(r("squared", 6).alias("squared"), r("absolute", 6).alias("absolute"))


@query("prd_19_by_feature", RES + f", g as (select *, v - avg(v) over (partition by f) z from rs) select f feature_id, {R('(sum(e * e) + 1) / (sum(z * z) + 1)', 6)} as ratio from g group by f")
def _(spark, d):
    f = L(spark, d)
    return predict.report_by(f.predict(f.inputs).residuals(), "feature_id").select("feature_id", r("ratio", 6).alias("ratio"))


@query("prd_20_feature_mse", RES + f", j as (select f, e, (sum(e * e) over (partition by f) - e * e) / (count(*) over (partition by f) - 1) l from rs) select f feature_id, {R('avg(e * e)', 3)} mse, {R('avg(l)', 3)} estimate from j group by f")
def _(spark, d):
    f = L(spark, d)
    res = f.predict(f.inputs).residuals()
    a = predict.feature_errors(res).select("feature_id", r("mse", 3).alias("mse"))
    return a.join(predict.feature_mse_jackknife(res).select("feature_id", r("estimate", 3).alias("estimate")), "feature_id")


@query("prd_21_determination", RES + f" select f feature_id, {R('sum(e * e) / (var_pop(v) * count(*))', 6)} remaining, {R('1 - sum(e * e) / (var_pop(v) * count(*))', 6)} cod from rs group by f")
def _(spark, d):
    f = L(spark, d)
    return f.predict(f.inputs).feature_errors().select("feature_id", r("remaining", 6).alias("remaining"), r("cod", 6).alias("cod"))


@query("prd_streaming", LM + f" select sid sample_id, {R('max(case when f = 0 then p end)', 3)} p0, {R('max(case when f = 1 then p end)', 3)} p1 from lm group by sid")
def _(spark, d):
    """The same scoring as a stream over files, run to its end."""
    f = L(spark, d)
    source = scratch(spark, "stream")
    f.inputs.write.parquet(f"{source}/in")
    stream = spark.readStream.schema("sample_id long, x array<double>").parquet(f"{source}/in")
    done = score_stream(f, stream).writeStream.format("parquet").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start(f"{source}/out")
    done.awaitTermination()
    return spark.read.parquet(f"{source}/out").select("sample_id", r(F.col("prediction")[0], 3).alias("p0"), r(F.col("prediction")[1], 3).alias("p1"))


# -- comparisons -----------------------------------------------------------------------------------------------------

TWO = ", two as (select t, node, f, sid % 2 = 0 a, v from nv), mn as (select t, node, a, sum((v - mean) * (v - mean)) own, sum((v - coalesce(pmean, 0)) * (v - coalesce(pmean, 0))) parent from two join np using (t, node, f) group by all)"


def _u(src: str, key: str, val: str) -> str:
    """Mann-Whitney U of side a and the Kolmogorov-Smirnov distance, by comparing all pairs."""
    return f"un as (select x.{key} k, sum(case when y.{val} < x.{val} then 1.0::double when y.{val} = x.{val} then 0.5 else 0 end) u from {src} x join {src} y on x.{key} = y.{key} and x.a and not y.a group by x.{key})"


def _pair(spark, d):
    f = L(spark, d)
    a, b = literal.cohorts(spark, d)
    return f, f.predict(a), f.predict(b)


@query("cmp_01_fractions", ", k as (select nd.t, nd.node, z.a, count(sid) k from nd cross join (select unnest([true, false]) a) z left join (select t, node, sid, sid % 2 = 0 a from mem) w on w.t = nd.t and w.node = nd.node and w.a = z.a group by all), fr as (select x.t, x.node, x.a, case when x.node = 1 then 1 else coalesce(x.k::double / nullif(y.k, 0), 0) end fr from k x left join k y on y.t = x.t and y.node = x.node >> 1 and y.a = x.a), ff as (select fac, a, fr from fr join fn using (t, node)), " + _u("ff", "fac", "fr") + f" select fac factor_id, {R('avg(fr) filter (a)', 5)} mean_a, {R('avg(fr) filter (not a)', 5)} mean_b, {R('any_value(u)', 2)} u from ff join un on un.k = fac group by fac")
def _(spark, d):
    f, p, q = _pair(spark, d)
    fr = [predict.node_fractions(navigate.populations(x.member), f.node_table) for x in (p, q)]
    return compare.factor_fractions(*fr, f.factor_nodes).select("factor_id", r("mean_a", 5).alias("mean_a"), r("mean_b", 5).alias("mean_b"), r("u", 2).alias("u"))


JK = ", oe2 as (select t, node, sid % 2 = 0 a, sum((v - mean) * (v - mean)) / count(*) mse from nv join ns using (t, node, f) group by all), j as (select fac, a, coalesce((sum(mse) over (partition by fac, a) - mse) / nullif(count(*) over (partition by fac, a) - 1, 0), 0) l from oe2 join fn using (t, node)), jk as (select fac, a, avg(l) e, var_pop(l) * (count(*) - 1) v from j group by all)"


@query("cmp_02_residual_z", JK + f" select x.fac factor_id, {R('x.e', 3)} estimate, case when x.v > 1e-9 then {R('(x.e - y.e) / sqrt(x.v)', 4)} end z from jk x join jk y on x.fac = y.fac and x.a and not y.a")
def _(spark, d):
    f, p, q = _pair(spark, d)
    a, b = (predict.jackknife_factor_mse(predict.node_mse(x.node_errors()), f.factor_nodes) for x in (p, q))
    return compare.factor_residuals(a, b).select("factor_id", r("estimate", 3).alias("estimate"), r("z").alias("z"))


def _per_node(x):
    return x.node_errors().groupBy(*KEY).agg(F.sum("own").alias("own"), F.sum("parent").alias("parent"))


@query("cmp_03_fvu", TWO + ", ff as (select fac, a, own, parent, round(1 - own / parent, 9) cod from mn join fn using (t, node)), " + _u("ff", "fac", "cod") + f" select fac factor_id, {R('sum(own) filter (a) / sum(parent) filter (a)', 5)} fvu_a, {R('sum(own) filter (not a) / sum(parent) filter (not a)', 5)} fvu_b, {R('any_value(u)', 2)} u from ff join un on un.k = fac group by fac")
def _(spark, d):
    f, p, q = _pair(spark, d)
    return compare.factor_fvu(_per_node(p), _per_node(q), f.factor_nodes).select("factor_id", r("fvu_a", 5).alias("fvu_a"), r("fvu_b", 5).alias("fvu_b"), r("u", 2).alias("u"))


VAL = OWN + ", sv as (select fac, sid % 2 = 0 a, case when fac = 0 then 1 else (o - i)::double / s end z from fs)"
KL = ", hb as (select fac, a, floor((z + 1) / 0.02 + 1e-9)::int b from sv), hc as (select z.fac, z.b, count(h.b) filter (h.a) + 1 ca, count(h.b) filter (not h.a) + 1 cb from (select fac, b from (select distinct fac from sv), (select unnest(range(0, 99)) b)) z left join hb h on h.fac = z.fac and h.b = z.b group by all), pq as (select fac, ca::double / sum(ca) over (partition by fac) p, cb::double / sum(cb) over (partition by fac) q from hc), kl as (select fac, sum(p * ln(p / q) + q * ln(q / p)) kl from pq group by fac)"


@query("cmp_04_values", VAL + KL + f", cu as (select distinct fac, z, (select avg((w.z <= v.z)::int) from sv w where w.fac = v.fac and w.a) fa, (select avg((w.z <= v.z)::int) from sv w where w.fac = v.fac and not w.a) fb from (select distinct fac, z from sv) v) select fac factor_id, {R('any_value(kl)', 5)} symmetric_kl, {R('max(abs(fa - fb))', 5)} ks from cu join kl using (fac) group by fac")
def _(spark, d):
    f, p, q = _pair(spark, d)
    return compare.factor_values(p.factor_matrix(), q.factor_matrix()).select("factor_id", r("symmetric_kl", 5).alias("symmetric_kl"), r("ks", 5).alias("ks"))


@query("cmp_05_marginals")
def _(spark, d):
    f, p, q = _pair(spark, d)
    m = [predict.observed_marginals(predict.observed_means(x.values, f.node_table, f.features)) for x in (p, q)]
    return compare.factor_vectors(*m, f.factor_nodes, "marginal").select("factor_id", r("own", 5).alias("own"), r("other", 5).alias("other"), r("rank").alias("rank"))


@query("cmp_06_cluster_frequencies", f", {SEG}, cm as (select t, node, c, count(*)::double / any_value(pop) f from mem join lab using (sid) join pop using (t, node) group by t, node, c), sh as (select sid, c, round(sum(f), 9) s from leaf join cm on cm.t = leaf.t and cm.node = leaf.leaf group by all), pc as (select sid, arg_max(c, struct_pack(a := s, b := -c)) c from sh group by sid) select c cluster_id, sum((sid % 2 = 0)::int)::bigint count_a, sum((sid % 2 = 1)::int)::bigint count_b from pc group by c")
def _(spark, d):
    f, p, q = _pair(spark, d)
    f.set_sample_labels(segments(spark, d))
    return p.compare_sample_clusters(q)


ME = ", om as (select t, node, f, sid % 2 = 0 a, avg(v) m from nv group by all), fm as (select fac, a, f, avg(m) m from om join fn using (t, node) group by all), fv as (select fac, a, list(m order by f) v from fm group by all), nvv as (select fac, t, node, list(m order by f) v from om join fn using (t, node) where a group by all), ds as (select n.fac, round(1 - list_cosine_similarity(n.v, x.v), 9) own, round(1 - list_cosine_similarity(y.v, x.v), 9) other from nvv n join fv x on x.fac = n.fac and x.a join fv y on y.fac = n.fac and not y.a)"


@query("cmp_07_means", ME + f" select fac factor_id, {R('avg(own)', 6)} own, {R('any_value(other)', 6)} other, {R('avg((own < other)::int)')} as rank from ds group by fac")
def _(spark, d):
    f, p, q = _pair(spark, d)
    m = [node_stats.node_stats(x.values).select(*KEY, "feature_id", "mean") for x in (p, q)]
    return compare.factor_vectors(*m, f.factor_nodes, "mean").select("factor_id", r("own", 6).alias("own"), r("other", 6).alias("other"), r("rank").alias("rank"))


@query("cmp_08_all_factors", TWO + VAL + KL + f", fv2 as (select fac, sum(own) filter (not a) / sum(parent) filter (not a) - sum(own) filter (a) / sum(parent) filter (a) d from mn join fn using (t, node) group by fac) select fac factor_id, {R('kl', 5)} symmetric_kl, {R('d', 5)} fvu_delta from kl full join fv2 using (fac)")
def _(spark, d):
    f, p, q = _pair(spark, d)
    return p.compare_factors(q).select("factor_id", r("symmetric_kl", 5).alias("symmetric_kl"), r("fvu_delta", 5).alias("fvu_delta"))


FR = RES + ", w as (select f, sid % 2 = 0 a, v, round(e, 9) e from rs), lv as (select f, e, sum(a::int) ca, sum((not a)::int) cb from w group by all), cu as (select f, e, ca, cb, coalesce(sum(cb) over (partition by f order by e rows between unbounded preceding and 1 preceding), 0) bb, sum(ca) over (partition by f order by e) ua, sum(cb) over (partition by f order by e) ub, sum(ca) over (partition by f) na, sum(cb) over (partition by f) nb from lv)"


@query("cmp_09_feature_residuals", FR + f", us as (select f, sum(ca * (bb + cb / 2.0::double)) u, max(abs(ua::double / na - ub::double / nb)) ks from cu group by f), er as (select f, a, avg(e * e) mse from w group by all) select f feature_id, {R('u', 1)} u, {R('ks', 5)} ks, {R('y.mse - x.mse', 3)} mse_delta from us join er x using (f) join er y using (f) where x.a and not y.a")
def _(spark, d):
    f, p, q = _pair(spark, d)
    return p.compare_features(q).select("feature_id", r("u", 1).alias("u"), r("ks", 5).alias("ks"), r("mse_delta", 3).alias("mse_delta"))


@query("cmp_tails")
def _(spark, d):
    f, p, q = _pair(spark, d)
    t = S.tails(p.compare_features(q), z="z", ks="ks")
    return compare.with_t(t, "z", 30.0).select("feature_id", *[F.round(c, 6).alias(c) for c in ("mwu_p", "ks_p", "t_density", "t_tail")])


# -- coordinates -----------------------------------------------------------------------------------------------------


@query("emb_01_pca")
def _(spark, d):
    f = L(spark, d)
    return f.coordinates().select("sample_id", r(F.abs("c0"), 3).alias("c0"))


@query("emb_04_scaled", f"select sid sample_id, {R('(x[1] - avg(x[1]) over ()) / stddev_pop(x[1]) over ()')} c0, {R('(x[4] - avg(x[4]) over ()) / stddev_pop(x[4]) over ()')} c1 from m")
def _(spark, d):
    f = L(spark, d)
    pts = f.outputs.select("sample_id", F.col("x")[0].alias("c0"), F.col("x")[3].alias("c1"))
    return f.coordinates(pts).select("sample_id", r("c0").alias("c0"), r("c1").alias("c1"))


@query("emb_05_centroids", f", {SEG} select c cluster_id, {R('avg(x[1])')} c0, {R('avg(x[4])')} c1 from m join lab using (sid) group by c")
def _(spark, d):
    f = L(spark, d)
    j = f.outputs.join(segments(spark, d), "sample_id")
    return j.groupBy("cluster_id").agg(r(F.avg(F.col("x")[0])).alias("c0"), r(F.avg(F.col("x")[3])).alias("c1"))


# -- training --------------------------------------------------------------------------------------------------------


def _fit(spark, d, **more):
    from ..model import fit

    x = literal.part_matrix(spark, d)
    return fit(spark, x, x, trees=3, depth=2, leaves=10, ss=60, ifs=3, ofs=3, dm="ssme", norm=1, std=True, seed=5, **more)


@query("trn_03_grow")
def _(spark, d):
    return _fit(spark, d).node_table.select(*KEY, "level", "is_leaf", "features", F.round("split", 4).alias("split"))


@query("trn_13_grow_reduced")
def _(spark, d):
    return _fit(spark, d, reduce_input=True, reduce_output=True, reduction=2).node_table.select(*KEY, "level", "is_leaf", F.round("split", 4).alias("split"))


@query("src_08_fit_unsupervised")
def _(spark, d):
    from ..model import fit

    x = literal.part_matrix(spark, d)
    return fit(spark, x, trees=2, depth=2, leaves=10, ss=60, ifs=2, ofs=2, seed=9).node_table.select(*KEY, "is_leaf")
