"""Queries over plain tables: sources, order statistics, aggregates, windows, sorts, scans.

Each entry is name -> (query, SQL or None).  Doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dispersion as D
from ..functions import stats as S
from ..operators import matrix, nipals, sampling, scan
from ..sources import text
from ..sources.scratch import scratch
from .literal import part_matrix, table

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def r(c, n: int = 4):
    """Rounded, with minus zero made zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def R(e: str, n: int = 4) -> str:
    return f"round({e}, {n}) + 0.0"


def line_values(spark: SparkSession, d: str):
    """Quantities and prices of lineitem by return flag."""
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("value"))


LV = "with t as (select l_returnflag flag, l_quantity::double v from lineitem), g as (select *, median(v) over (partition by flag) med from t)"


def supplier_long(spark: SparkSession, d: str):
    """Balances and nations of all suppliers, as a long matrix."""
    return matrix.to_long(matrix.wide(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]))


SL = "with m as (select s_suppkey sid, 0 f, s_acctbal::double v from supplier union all select s_suppkey, 1, s_nationkey::double from supplier)"


# -- sources ---------------------------------------------------------------------------------------------------------


@query("src_01_text_matrix", f"select row_number() over (order by s_suppkey) - 1 sample_id, {R('s_acctbal', 2)} a, s_nationkey::double b from supplier")
def _(spark, d):
    t = table(spark, d, "supplier").orderBy("s_suppkey").select(F.concat_ws(" \t ", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string")).alias("value"))
    path = scratch(spark, "matrix")
    t.coalesce(1).write.mode("overwrite").text(path)
    m = text.read_matrix(spark, path)
    return m.select("sample_id", r(F.col("x")[0], 2).alias("a"), F.col("x")[1].alias("b"))


@query("src_02_width", "select 4 as low, 4 as high, count(*) n from part")
def _(spark, d):
    return part_matrix(spark, d).agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high"), F.count(F.lit(1)).alias("n"))


@query("src_03_matrices", f"select p_partkey sample_id, {R('p_size + p_retailprice', 2)} s from part")
def _(spark, d):
    return part_matrix(spark, d).select("sample_id", r(F.col("x")[0] + F.col("x")[1], 2).alias("s"))


@query("src_04_header", "with k as (select p_partkey, p_type, row_number() over (partition by p_type order by p_partkey) - 1 k from part) select p_partkey feature_id, case when k > 0 then p_type || k else p_type end as name from k")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_type").alias("name"))
    return text.number_repeats(t, "feature_id")


@query("src_06_lenient_matrix", "select row_number() over (order by p_partkey) - 1 sample_id, p_size::double a, null::double b from part")
def _(spark, d):
    t = table(spark, d, "part").orderBy("p_partkey").select(F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand").alias("value"))
    path = scratch(spark, "lenient")
    t.coalesce(1).write.mode("overwrite").text(path)
    m = text.read_matrix(spark, path, strict=False)
    return m.select("sample_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query("src_17_tsv", "select p_partkey sample_id, concat_ws(chr(9), p_size::varchar, length(p_name)::varchar) as value from part")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("sample_id"), F.array(F.col("p_size"), F.length("p_name")).alias("x"))
    return text.tsv(t)


# -- order statistics and dispersion ---------------------------------------------------------------------------------


@query("dsp_01_argsort", "select s_suppkey sid, row_number() over (order by s_acctbal, s_suppkey) as place from supplier")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.lit(0).alias("feature_id"), F.col("s_suppkey").alias("sample_id"), F.col("s_acctbal").alias("value"))
    return D.draw_order(t, ["feature_id"]).select(F.col("sample_id").alias("sid"), F.col("rank").alias("place"))


@query("dsp_03_draw_order", SL + " select f feature_id, sid sample_id, row_number() over (partition by f order by v, sid) as rank from m")
def _(spark, d):
    return D.draw_order(supplier_long(spark, d), ["feature_id"]).select("feature_id", "sample_id", "rank")


@query("dsp_04_ordered_values", SL + " select f feature_id, array_to_string(list(floor(v)::bigint order by v), ',') as ordered from m group by f")
def _(spark, d):
    return supplier_long(spark, d).withColumn("w", F.floor("value")).groupBy("feature_id").agg(F.concat_ws(",", F.array_sort(F.collect_list("w")).cast("array<string>")).alias("ordered"))


def _mode(name: str, mode: str, sql: str, digits: int = 2):
    @query(name, LV + f" select flag, count(*) n, {R('any_value(med)')} median, {R(sql, digits)} dispersion from g group by flag")
    def f(spark, d):
        return D.dispersions(line_values(spark, d), ["flag"], mode).select("flag", "n", r("median").alias("median"), r("dispersion", digits).alias("dispersion"))


_mode("dsp_08_variance", "var", "var_pop(v)", 4)
_mode("dsp_09_sse", "sse", "var_pop(v) * count(*)", 1)
_mode("dsp_10_mad", "mad", "median(abs(v - med))", 4)
_mode("dsp_12_ssme", "ssme", "sum((v - med) * (v - med))", 1)
_mode("dsp_14_sme", "sme", "sum(abs(v - med))", 1)


@query("dsp_05_median", LV + f" select flag, {R('median(v)')} as med from t group by flag")
def _(spark, d):
    return line_values(spark, d).groupBy("flag").agg(r(D.median()).alias("med"))


@query("dsp_06_mean", LV + f" select flag, {R('avg(v)')} as mean from t group by flag")
def _(spark, d):
    return line_values(spark, d).groupBy("flag").agg(r(D.moments()["mean"]).alias("mean"))


@query("dsp_07_sums", LV + f" select flag, {R('sum(v)', 1)} as total, {R('sum(v * v)', 1)} as squares from t group by flag")
def _(spark, d):
    m = D.moments()
    return line_values(spark, d).groupBy("flag").agg(r(m["total"], 1).alias("total"), r(m["squares"], 1).alias("squares"))


@query("dsp_11_slow_mad", SL + ", g as (select f, v, median(v) over (partition by f) med from m) select f feature_id, " + R("median(abs(v - med))") + " as mad from g group by f")
def _(spark, d):
    return D.dispersions(supplier_long(spark, d), ["feature_id"], "mad").select("feature_id", r("dispersion").alias("mad"))


@query("dsp_13_explicit_ssme", LV + f" select flag, {R('sum((v - med) * (v - med))', 1)} as ssme from g group by flag")
def _(spark, d):
    return D.centred(line_values(spark, d), ["flag"]).groupBy("flag").agg(r(F.sum((F.col("value") - F.col("median")) ** 2), 1).alias("ssme"))


_ZONES = ", g as (select f, sid, v, median(v) over (partition by f) med, count(*) over (partition by f) n from m), h as (select *, row_number() over (partition by f order by v, sid) rk, row_number() over (partition by f order by abs(v - med) desc, v, sid) far from g), z as (select *, case when far <= greatest(n // 2, 1) - (1 - n % 2) then case when rk * 2 <= n then 'left' else 'right' end else 'centre' end zone from h)"


@query("dsp_15_entropy", SL + _ZONES + f", c as (select f, n, zone, count(*) k from z group by all) select f feature_id, {R('n * sum((k / n) * log2(k / n))')} as entropy from c group by f, n")
def _(spark, d):
    return D.dispersions(supplier_long(spark, d), ["feature_id"], "entropy", order="sample_id").select("feature_id", r("dispersion").alias("entropy"))


@query("dsp_16_zones", SL + _ZONES + " select f feature_id, sid sample_id, zone from z")
def _(spark, d):
    return D.zones(supplier_long(spark, d), ["feature_id"], order="sample_id").select("feature_id", "sample_id", "zone")


@query("dsp_18_dispatch", LV + f" select flag, 'ssme' as mode, {R('sum((v - med) * (v - med))', 1)} as dispersion from g group by flag union all select flag, 'sme', {R('sum(abs(v - med))', 1)} from g group by flag union all select flag, 'mad', {R('median(abs(v - med))', 1)} from g group by flag")
def _(spark, d):
    v = line_values(spark, d)
    parts = [D.dispersions(v, ["flag"], m).select("flag", F.lit(m).alias("mode"), r("dispersion", 1).alias("dispersion")) for m in ("ssme", "sme", "mad")]
    return parts[0].union(parts[1]).union(parts[2])


@query("dsp_19_all", LV + f" select flag, count(*) n, {R('avg(v)')} mean, {R('any_value(med)')} median, {R('var_pop(v)')} var, {R('median(abs(v - med))')} mad, {R('sum(abs(v - med))', 1)} sme from g group by flag")
def _(spark, d):
    return D.all_dispersions(line_values(spark, d), ["flag"]).select("flag", "n", *[r(c).alias(c) for c in ("mean", "median", "var", "mad")], r("sme", 1).alias("sme"))


@query("dsp_20_cov", LV + f" select flag, {R('coalesce(median(abs(v - med)) / nullif(any_value(med), 0), 0)')} as cov from g group by flag")
def _(spark, d):
    return D.dispersions(line_values(spark, d), ["flag"], "mad").select("flag", r(D.coefficient_of_variation(F.col("dispersion"), F.col("median"))).alias("cov"))


_RUN = SL + ", o as (select f, sid, v, row_number() over (partition by f order by v, sid) rk from m)"


@query("dsp_21_running", _RUN + f" select f feature_id, rk as rank, count(*) over w n, {R('median(v) over w')} median, {R('avg(v) over w', 2)} mean from o window w as (partition by f order by rk rows between current row and unbounded following)")
def _(spark, d):
    t = D.running(D.draw_order(supplier_long(spark, d), ["feature_id"]), ["feature_id"])
    return t.select("feature_id", "rank", "n", r("median").alias("median"), r("mean", 2).alias("mean"))


@query("dsp_22_ordered_variance", _RUN + f" select f feature_id, rk as rank, {R('var_pop(v) over (partition by f order by rk rows between current row and unbounded following)', 3)} as var from o")
def _(spark, d):
    return D.running(D.draw_order(supplier_long(spark, d), ["feature_id"]), ["feature_id"]).select("feature_id", "rank", r("var", 3).alias("var"))


@query("dsp_23_ordered_sse", _RUN + f" select f feature_id, rk as rank, {R('var_pop(v) over w * count(*) over w / 997.3::double', 3)} as sse from o window w as (partition by f order by rk rows between current row and unbounded following)")
def _(spark, d):
    return D.running(D.draw_order(supplier_long(spark, d), ["feature_id"]), ["feature_id"]).select("feature_id", "rank", r(F.col("sse") / 997.3, 3).alias("sse"))


_MADS = _RUN + ", q as (select a.f, a.rk, median(b.v) med from o a join o b on a.f = b.f and b.rk >= a.rk group by a.f, a.rk), w as (select q.f, q.rk, any_value(med) med, case when count(*) < 2 then 0 else median(abs(b.v - med)) end mad from q join o b on b.f = q.f and b.rk >= q.rk group by q.f, q.rk)"


@query("dsp_24_mad_gains", _MADS + f" select f feature_id, rk as rank, {R('greatest(0, first_value(mad) over (partition by f order by rk) - mad)')} as gain from w")
def _(spark, d):
    return D.running_mad(D.draw_order(supplier_long(spark, d), ["feature_id"]), ["feature_id"]).select("feature_id", "rank", r("mad_gain").alias("gain"))


@query("dsp_25_covs", _MADS + f" select f feature_id, rk as rank, {R('coalesce(abs(mad / nullif(med, 0)), 0)')} as cov from w")
def _(spark, d):
    return D.running_mad(D.draw_order(supplier_long(spark, d), ["feature_id"]), ["feature_id"]).select("feature_id", "rank", r("cov").alias("cov"))


def _draws(spark, d):
    """40 draws with replacement from all suppliers, whose keys run from 1."""
    n = table(spark, d, "supplier").count()
    return spark.range(40).select(F.col("id").alias("draw_no"), (sampling.position(3, F.col("id"), n, 7) + 1).alias("sample_id"))


_DRAW = "d0 as (select k, (3 * 7919 + k * 104729 + 7 * 1299709 + 1) % 2147483647 x from range(40) z(k)), d1 as (select k, (x * x + 48271 * x + 11) % 2147483647 x from d0), d2 as (select k draw_no, ((x * x + 16807 * x + 7) % 2147483647) % (select count(*) from supplier) + 1 sid from d1)"


@query("dsp_26_bag", SL + ", " + _DRAW + f" select f feature_id, count(*) n, {R('median(v)')} med, {R('var_pop(v)', 2)} var from d2 join m using (sid) group by f")
def _(spark, d):
    t = matrix.derive(supplier_long(spark, d), _draws(spark, d))
    return t.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"), r(D.median()).alias("med"), r(F.var_pop("value"), 2).alias("var"))


@query("dsp_27_matrix_bag", SL + ", " + _DRAW + f", fs as (select * from (values (0, 1), (1, 0), (2, 1)) z(place, f)) select place, count(*) n, {R('sum(v)', 2)} total from d2 join m using (sid) join fs using (f) group by place")
def _(spark, d):
    t = matrix.derive(supplier_long(spark, d), _draws(spark, d), spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "place int, feature_id int"))
    return t.groupBy("place").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("dsp_28_split_mask", "select p_partkey sample_id, not (p_size <= 25) as above from part")
def _(spark, d):
    return part_matrix(spark, d).select("sample_id", (~(F.col("x")[0] <= 25)).alias("above"))


@query("dsp_29_lookup", "select max(case when p_partkey = 7 then p_size end)::double as at7, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) as lowest, arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) as highest from part")
def _(spark, d):
    price = F.struct(F.col("x")[1], "sample_id")
    return part_matrix(spark, d).agg(F.max(F.when(F.col("sample_id") == 7, F.col("x")[0])).alias("at7"), F.min_by("sample_id", price).alias("lowest"), F.max_by("sample_id", price).alias("highest"))


@query("dsp_30_argmin_argmax", SL + f" select f feature_id, arg_min(sid, struct_pack(a := v, b := sid)) lowest, {R('min(v)')} low, arg_max(sid, struct_pack(a := v, b := -sid)) highest, {R('max(v)')} high from m group by f")
def _(spark, d):
    t = supplier_long(spark, d).groupBy("feature_id").agg(D.first_minimum("value", "sample_id").alias("a"), D.first_maximum("value", "sample_id").alias("b"))
    return t.select("feature_id", F.col("a.place").alias("lowest"), r("a.value").alias("low"), F.col("b.place").alias("highest"), r("b.value").alias("high"))


@query("dsp_31_nonzero_mad", f"with t as (select l_returnflag flag, l_discount::double v from lineitem where l_discount != 0), g as (select *, median(v) over (partition by flag) med from t) select flag, {R('median(abs(v - med))')} as mad from g group by flag")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_discount").cast("double").alias("value"))
    return D.nonzero_mad(t, ["flag"]).select("flag", r("dispersion").alias("mad"))


@query("dsp_32_total_ssme", SL + f", g as (select f, v, median(v) over (partition by f) med from m) select {R('sum((v - med) * (v - med)) / 1000', 2)} as ssme from g")
def _(spark, d):
    return D.dispersions(supplier_long(spark, d), ["feature_id"], "ssme").agg(r(F.sum("dispersion") / 1000, 2).alias("ssme"))


# -- training pieces -------------------------------------------------------------------------------------------------


@query("trn_04_draws", "with " + _DRAW + " select draw_no, sid sample_id from d2")
def _(spark, d):
    return _draws(spark, d)


def _scan(name, mode, term, digits=2, scale=1000):
    sides = SL + (
        ", d as (select f fi, v thr, sid, row_number() over (partition by f order by v, sid) r from m), j as (select d.fi, d.thr, d.r, m.f fo, m.v from d join m using (sid)),"
        " a as (select x.fi, x.fo, x.r, any_value(x.thr) thr, 'p' side, list(y.v) l from j x join j y on x.fi = y.fi and x.fo = y.fo and y.r <= x.r group by x.fi, x.fo, x.r union all"
        " select x.fi, x.fo, x.r, any_value(x.thr), 'q', list(y.v) from j x join j y on x.fi = y.fi and x.fo = y.fo and y.r > x.r group by x.fi, x.fo, x.r),"
        " u as (select fi, fo, r, thr, side, unnest(l) v from a), c as (select *, median(v) over (partition by fi, fo, r, side) med from u),"
        f" s as (select fi, fo, r, any_value(thr) thr, side, {term} d from c group by fi, fo, r, side)"
    )

    @query(name, sides + f" select fi feature_id, r as position, {R('any_value(thr)', 2)} threshold, {R(f'sum(d) / {scale}', digits)} d from s group by fi, r")
    def f(spark, d):
        t = scan.scan_windows(supplier_long(spark, d), mode)
        return t.select("feature_id", "position", r("threshold", 2).alias("threshold"), r(F.col("d") / scale, digits).alias("d"))


_scan("trn_08_scan_ssme", "ssme", "sum((v - med) * (v - med))")
_scan("trn_08_scan_sse", "sse", "var_pop(v) * count(*)")
_scan("trn_08_scan_sme", "sme", "sum(abs(v - med))")
_scan("trn_08_scan_mad", "mad", "case when count(*) < 2 then 0 else median(abs(v - med)) end")

_SPLITS = SL + (
    ", d as (select f fi, v thr, sid, row_number() over (partition by f order by v, sid) r from m), j as (select d.fi, d.thr, d.r, m.f fo, m.v from d join m using (sid)),"
    " s as (select fi, thr, r, fo, count(*) over p np, sum(v) over p sp, sum(v*v) over p qp, median(v) over p mp, count(*) over q nq, sum(v) over q sq, sum(v*v) over q qq, median(v) over q mq from j"
    " window p as (partition by fi, fo order by r rows between unbounded preceding and current row), q as (partition by fi, fo order by r rows between 1 following and unbounded following)),"
    " t as (select fi, thr, r, sum(mp*mp*np - 2*mp*sp + qp + case when nq = 0 then 0 else mq*mq*nq - 2*mq*sq + qq end) d from s group by fi, thr, r),"
    " b as (select *, row_number() over (partition by fi order by round(d, 9), r) k from t)"
)


@query("trn_09_candidates", _SPLITS + f" select fi feature_id, r as position, {R('thr', 2)} threshold, row_number() over (order by d, fi) as candidate from b where k = 1")
def _(spark, d):
    b = scan.best_splits(scan.scan_windows(supplier_long(spark, d)))
    return b.select("feature_id", "position", r("threshold", 2).alias("threshold"), "candidate")


@query("trn_11_first_candidate", _SPLITS + f" select fi feature_id, {R('thr', 2)} threshold from b where k = 1 order by d, fi limit 1")
def _(spark, d):
    return scan.best_splits(scan.scan_windows(supplier_long(spark, d))).where("candidate = 1").select("feature_id", r("threshold", 2).alias("threshold"))


@query("trn_16_nipals")
def _(spark, d):
    """Components of the whole part matrix, from its distributed sums."""
    w = nipals.weights(part_matrix(spark, d), 4)
    return spark.createDataFrame([(k, x.round(4).tolist()) for k, x in enumerate(w)], "component int, weights array<double>")


@query("trn_17_centring", "with m as (select p_partkey sid, 0 f, p_size::double v from part union all select p_partkey, 1, p_retailprice from part) select sid sample_id, f feature_id, " + R("v - avg(v) over (partition by f)", 3) + " as value from m")
def _(spark, d):
    long = matrix.to_long(part_matrix(spark, d)).where("feature_id <= 1")
    return matrix.centre(long).select("sample_id", "feature_id", r("value", 3).alias("value"))


@query("trn_20_weighted_choice", "with w as (select s_suppkey k, sum(s_suppkey) over (order by s_suppkey)::double / sum(s_suppkey) over () hi, (sum(s_suppkey) over (order by s_suppkey) - s_suppkey)::double / sum(s_suppkey) over () lo from supplier), u as (select i, i / 97.0::double u from range(97) z(i)) select i, k chosen from u join w on u.u >= lo and u.u < hi")
def _(spark, d):
    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chosen"))
    u = spark.range(97).select(F.col("id").alias("i"), (F.col("id") / 97.0).alias("u"))
    return sampling.weighted_choice(items, u, "chosen", "chosen").select("i", "chosen")


# -- aggregates ------------------------------------------------------------------------------------------------------


@query("agg_01_histogram", "select event_type, count(*) n from events group by event_type")
def _(spark, d):
    return S.histogram(table(spark, d, "events"), "event_type")


@query("agg_02_stack_maps", "select json_extract_string(props, '$.k')::int as v, 'k' as key from events")
def _(spark, d):
    t = table(spark, d, "events").select(F.from_json("props", "map<string,int>").alias("p"))
    return S.stack_maps(t, "p").select(F.explode("values").alias("v"), "key")


@query("agg_03_mutual_information", "with l as (select event_type a, user_id % 4 b from events), n as (select count(*) al from l), pa as (select a, count(*) na from l group by a), pb as (select b, count(*) nb from l group by b), c as (select a, b, count(*) k from l group by a, b) select a, b, coalesce(k, 0) n, " + R("coalesce(k / al * ln(k * al / (na * nb)), 0)", 6) + " as information from pa cross join pb cross join n left join c using (a, b)")
def _(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("event_type").alias("a"), (F.col("user_id") % 4).alias("b"))
    return S.mutual_information(t, "event_id", "a", "b").select("a", "b", "n", r("information", 6).alias("information"))


_CORR = "with m as (select p_partkey sid, [p_size::double, p_retailprice::double, length(p_name)::double, regexp_extract(p_brand, '[0-9]+')::double] x from part), p as (select sid, i, j, x[i + 1] a, x[j + 1] b from m, (select unnest([0,1,2,3]) i), (select unnest([0,1,2,3]) j) where i <= j)"


@query("agg_04_weighted_correlation", _CORR + ", w as (select *, (sid % 3)::double w from p where sid % 3 > 0), s as (select i, j, sum(w) w, sum(w*a) sa, sum(w*b) sb, sum(w*a*a) saa, sum(w*b*b) sbb, sum(w*a*b) sab from w group by i, j) select i, j, case when i = j then 1.0 else " + R("coalesce((sab - sa*sb/w) / nullif(sqrt((saa - sa*sa/w) * (sbb - sb*sb/w)), 0), 0)", 6) + " end as r from s")
def _(spark, d):
    long = matrix.to_long(part_matrix(spark, d)).withColumn("w", (F.col("sample_id") % 3).cast("double")).where("w > 0")
    return S.correlation(long, weight="w").select("i", "j", r("r", 6).alias("r"))


@query("agg_05_jackknife", f"with s as (select s_nationkey k, s_acctbal / 1000 v from supplier), t as (select k, (sum(v*v) over (partition by k) - v*v) / nullif(count(*) over (partition by k) - 1, 0) l from s) select k as nation, {R('avg(coalesce(l, 0))')} estimate, {R('var_pop(coalesce(l, 0)) * (count(*) - 1)')} variance from t group by k")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") / 1000).alias("v"))
    return S.jackknife_variance(t, ["nation"], "v").select("nation", r("estimate").alias("estimate"), r("variance").alias("variance"))


@query("agg_06_global_correlation", _CORR + " select i, j, case when i = j then 1.0 else " + R("coalesce(corr(a, b), 0)", 6) + " end as r from p group by i, j")
def _(spark, d):
    return S.correlation(matrix.to_long(part_matrix(spark, d))).select("i", "j", r("r", 6).alias("r"))


@query("agg_07_pearson", f"select l_returnflag flag, {R('coalesce(corr(l_quantity, l_extendedprice), 0)', 6)} as r from lineitem group by l_returnflag")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    return t.groupBy("flag").agg(r(S.pearson("q", "p"), 6).alias("r"))


@query("agg_08_covariance", _CORR + f" select i, j, {R('covar_pop(a, b)', 8)} as cov from p group by i, j")
def _(spark, d):
    # At 4 places some of these covariances are exact ties (0.77215), which the last digit of a sum decides; 8 places hold them whole.
    s = S.pair_sums(matrix.to_long(part_matrix(spark, d)))
    return s.select("i", "j", r((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("w")) / F.col("w"), 8).alias("cov"))


@query("agg_09_spearman", "with m as (select p_partkey sid, [p_size::double, p_retailprice::double, length(p_name)::double, regexp_extract(p_brand, '[0-9]+')::double] x from part), l as (select sid, f, x[f + 1] v from m, (select unnest([0,1,2,3]) f)), k as (select sid, f, count(*) over (partition by f order by v range between unbounded preceding and current row)::double v from l), p as (select a.f i, b.f j, a.v a, b.v b from k a join k b on a.sid = b.sid and a.f <= b.f) select i, j, case when i = j then 1.0 else " + R("coalesce(corr(a, b), 0)", 6) + " end as r from p group by i, j")
def _(spark, d):
    return S.spearman(matrix.to_long(part_matrix(spark, d))).select("i", "j", r("r", 6).alias("r"))


# -- windows ---------------------------------------------------------------------------------------------------------


@query("win_01_rank", "select p_partkey sample_id, row_number() over (partition by p_brand order by p_retailprice, p_partkey) as rank from part")
def _(spark, d):
    t = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("sample_id"), F.col("p_retailprice").alias("value"))
    return D.draw_order(t, ["p_brand"]).select("sample_id", "rank")


def _frame(name, w, frame):
    @query(name, f"with t as (select s_nationkey k, s_suppkey s, s_acctbal v, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) r from supplier) select k, s, {R('sum(v) over (partition by k order by r rows between ' + frame + ')', 2)} as total from t")
    def f(spark, d):
        t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("v"))
        return D.draw_order(t, ["k"], "v", "s").select("k", "s", r(F.sum("v").over(w(["k"])), 2).alias("total"))


_frame("win_02_suffix", D.suffix, "current row and unbounded following")
_frame("win_03_prefix", D.prefix, "unbounded preceding and current row")


@query("win_04_running_median", f"with t as (select s_nationkey k, s_suppkey s, s_acctbal v, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) r from supplier) select k, s, {R('median(v) over (partition by k order by r rows between current row and unbounded following)', 3)} as med from t")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("v"))
    return D.draw_order(t, ["k"], "v", "s").select("k", "s", r(D.median("v").over(D.suffix(["k"])), 3).alias("med"))


@query("win_05_running_variance", f"with t as (select s_nationkey k, s_suppkey s, s_acctbal / 100 v, row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey) r from supplier) select k, s, {R('var_pop(v) over (partition by k order by r rows between unbounded preceding and current row)', 3)} as var from t")
def _(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"), (F.col("s_acctbal") / 100).alias("v"))
    return D.draw_order(t, ["k"], "v", "s").select("k", "s", r(F.var_pop("v").over(D.prefix(["k"])), 3).alias("var"))


@query("win_06_leave_one_out", f"select s_suppkey s, {R('sum(s_acctbal) over (partition by s_nationkey) - s_acctbal', 2)} as rest from supplier")
def _(spark, d):
    from ..operators.compare import leave_one_out

    return leave_one_out(table(spark, d, "supplier"), ["s_nationkey"], "s_acctbal").select(F.col("s_suppkey").alias("s"), r("rest", 2).alias("rest"))


@query("win_07_rank_among", f"select s_nationkey k, {R('avg((s_acctbal < 5000)::int)')} as rank from supplier group by s_nationkey")
def _(spark, d):
    from ..operators.compare import rank_among

    t = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_acctbal", F.lit(5000.0).alias("o"))
    return rank_among(t, ["k"], "s_acctbal", "o").select("k", r("rank").alias("rank"))


@query("win_08_cumulative", "select s_suppkey s, sum(s_suppkey) over (partition by s_nationkey order by s_suppkey)::bigint as total from supplier")
def _(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.sum("s_suppkey").over(w).alias("total"))


# -- sorts, limits, sets ---------------------------------------------------------------------------------------------


@query("srt_02_top_bottom", "with t as (select p_brand k, p_partkey s, p_retailprice v from part), x as (select *, row_number() over (partition by k order by v, s) lo, row_number() over (partition by k order by v desc, s desc) hi from t) select k, s from x where lo <= 3 or hi <= 3")
def _(spark, d):
    from ..operators.factors import top_and_bottom

    t = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("s"), F.col("p_retailprice").alias("v"))
    return top_and_bottom(t, ["k"], "v", 3, "s").select("k", "s")


@query("srt_04_k_smallest", "select k, s from (select p_brand k, p_partkey s, row_number() over (partition by p_brand order by p_retailprice, p_partkey) r from part) where r <= 5")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("k"), F.col("p_partkey").alias("s"), F.col("p_retailprice").alias("v"))
    return D.draw_order(t, ["k"], "v", "s").where("rank <= 5").select("k", "s")


@query("srt_06_shuffle", "with d0 as (select p_partkey k, (p_partkey * 7919 + 104729 + 1) % 2147483647 x from part), d1 as (select k, (x * x + 48271 * x + 11) % 2147483647 x from d0), d2 as (select k, (x * x + 16807 * x + 7) % 2147483647 x from d1) select k, row_number() over (order by x, k) as place from d2")
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_partkey").alias("k"), sampling.scramble(F.col("p_partkey"), 1).alias("x"))
    return t.select("k", F.row_number().over(Window.orderBy("x", "k")).alias("place"))


@query("srt_07_union", "select c_custkey k from customer where c_nationkey = 1 union all select c_custkey from customer where c_mktsegment = 'BUILDING'")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.where("c_nationkey = 1").select(F.col("c_custkey").alias("k")).unionAll(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("srt_08_difference", "select c_custkey k from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("srt_09_intersection", "select s_nationkey k from supplier intersect select c_nationkey from customer")
def _(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("srt_10_labels", "select distinct label from embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("label").distinct()
