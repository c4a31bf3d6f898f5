"""A fixed three-tree forest over ``part``, as tables here and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Forest
from ..operators.matrix import wide
from ..operators.trainer import NODE_SCHEMA

#: The literal forest, as (tree, node, features, means, scores, split).
SPLITS = [
    (1, 1, [0], [0.0], [1.0], 25.0),
    (1, 2, [1], [0.0], [1.0], 950.0),
    (1, 3, [3], [0.0], [1.0], 12.0),
    (2, 1, [1], [0.0], [1.0], 940.0),
    (2, 2, [0], [0.0], [1.0], 20.0),
    (2, 3, [0], [0.0], [1.0], 30.0),
    (3, 1, [0, 1], [25.0, 950.0], [0.6, 0.08], 0.0),
    (3, 3, [3], [0.0], [1.0], 15.0),
]
NAMES = ["size", "price", "name_length", "brand"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.regexp_extract("p_brand", "[0-9]+", 0)
    return wide(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice", F.length("p_name"), brand])


def nodes(spark: SparkSession) -> DataFrame:
    rows = {(t, n): (f, m, s, c) for t, n, f, m, s, c in SPLITS}
    for t, n in list(rows):
        for child in (2 * n, 2 * n + 1):
            rows.setdefault((t, child), None)
    return spark.createDataFrame([(t, n, n.bit_length() - 1, v is None, *(v or (None,) * 4)) for (t, n), v in sorted(rows.items())], NODE_SCHEMA)


def factor_of(node="node_id"):
    """Literal factor labels: 0 for roots, else 1 + node mod 3."""
    n = F.col(node)
    return F.when(n == 1, 0).otherwise((1 + n % 3).cast("int"))


def forest(spark: SparkSession, sf_dir: str) -> Forest:
    n, x = nodes(spark), part_matrix(spark, sf_dir)
    return Forest(n, x, x, NAMES, n.select(factor_of().cast("int").alias("factor_id"), "tree_id", "node_id"))


def cohorts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = part_matrix(spark, sf_dir)
    return x.where("sample_id % 2 = 0"), x.where("sample_id % 2 = 1")


SQL = """
m as (select p_partkey sid, [p_size::double, p_retailprice::double, length(p_name)::double, regexp_extract(p_brand, '[0-9]+')::double] x from part),
lng as (select sid, f, x[f + 1] v from m, (select unnest([0, 1, 2, 3]) f)),
leaf as (
  select sid, x, 1 t, case when x[1] <= 25 then case when x[2] <= 950 then 4 else 5 end else case when x[4] <= 12 then 6 else 7 end end leaf from m
  union all select sid, x, 2, case when x[2] <= 940 then case when x[1] <= 20 then 4 else 5 end else case when x[1] <= 30 then 6 else 7 end end from m
  union all select sid, x, 3, case when 0.0::double + (x[1] - 25) * 0.6::double + (x[2] - 950) * 0.08::double <= 0 then 2 when x[4] <= 15 then 6 else 7 end from m),
nd as (select * from (values (1,1,0,false),(1,2,1,false),(1,3,1,false),(1,4,2,true),(1,5,2,true),(1,6,2,true),(1,7,2,true),
  (2,1,0,false),(2,2,1,false),(2,3,1,false),(2,4,2,true),(2,5,2,true),(2,6,2,true),(2,7,2,true),
  (3,1,0,false),(3,2,1,true),(3,3,1,false),(3,6,2,true),(3,7,2,true)) z(t, node, lev, is_leaf)),
mem as (select t, (leaf >> k)::bigint node, sid, x from leaf, (select unnest([0, 1, 2]) k) where leaf >> k > 0),
nv as (select t, node, sid, f, x[f + 1] v from mem, (select unnest([0, 1, 2, 3]) f)),
ns as (select t, node, f, count(*) n, avg(v) mean, median(v) med, var_pop(v) * count(*) srs, count(*) * median(v) * median(v) - 2 * median(v) * sum(v) + sum(v * v) ssme from nv group by all),
np as (select a.*, b.n pn, b.mean pmean, b.med pmed, b.srs psrs, b.ssme pssme from ns a left join ns b on b.t = a.t and b.node = a.node >> 1 and b.f = a.f),
pop as (select t, node, count(*) pop from mem group by all),
anc as (select t, node, (node >> k)::bigint a, k d, lev, is_leaf from nd, (select unnest([0, 1, 2]) k) where node >> k > 0),
fn as (select case when node = 1 then 0 else 1 + node % 3 end fac, t, node, lev, is_leaf from nd),
gn as (select t, node, f, n, mean - coalesce(pmean, 0) g from np)
"""


def sql(tail: str) -> str:
    """The tail after the common table expressions above; more of them may come first as ``, name as (...) select``."""
    return f"with {SQL.strip()}{'' if tail.lstrip().startswith(',') else ''}\n{tail.strip()}"
