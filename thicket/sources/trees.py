"""Trees as nested JSON, and as Parquet tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trainer import NODE_SCHEMA

#: Leaf rows a JSON export may gather on the driver; larger models use Parquet.
JSON_ROWS = 10_000_000


def flatten(tree: dict, tree_id: int) -> tuple[list[tuple], list[tuple]]:
    """One nested tree -> node rows and (tree_id, node_id, sample_id) rows of its leaves."""
    nodes, member, todo = [], [], [(tree, 1)]
    while todo:
        node, at = todo.pop()
        kids = node.get("children") or []
        split = (None,) * 4
        if kids:
            kids = sorted(kids, key=lambda c: bool(c["filter"]["orientation"]))
            f = kids[0]["filter"]
            r = f["reduction"]
            split = ([x["index"] for x in r["features"]], [float(x) for x in r["means"]], [float(x) for x in r["scores"]], float(f["split"]))
            for c in kids:
                todo.append((c, 2 * at + bool(c["filter"]["orientation"])))
        else:
            member += [(tree_id, at, s) for s in node.get("samples", [])]
        nodes.append((tree_id, at, at.bit_length() - 1, not kids, *split))
    return sorted(nodes), sorted(member)


def read_json(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaf membership) of all tree files that match; trees are numbered in order of their names."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), "value")
    numbered = {r.file: i for i, r in enumerate(files.select("file").orderBy("file").collect())}

    def parse(rows):
        for r in rows:
            nodes, member = flatten(json.loads(r.value), numbered[r.file])
            by: dict[int, list[int]] = {}
            for _, n, s in member:
                by.setdefault(n, []).append(s)
            for n in nodes:
                yield (*n, by.get(n[1], []))

    # Trees are few and each file is one tree: a row function per file is fine.
    rows = files.rdd.mapPartitions(parse).toDF(NODE_SCHEMA + ", samples array<long>")
    return rows.drop("samples"), rows.where("is_leaf").select("tree_id", "node_id", F.explode("samples").alias("sample_id"))


def to_json(nodes: DataFrame, leaf_member: DataFrame, stats: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """(tree_id, value): each tree as nested JSON with samples, means, medians, filter, depth and children."""
    if leaf_member.count() > JSON_ROWS:
        raise ValueError("too many samples for JSON; use Parquet")
    rows = {(r.tree_id, r.node_id): r for r in nodes.collect()}
    held = {(r.tree_id, r.node_id): list(r.samples) for r in leaf_member.groupBy("tree_id", "node_id").agg(F.sort_array(F.collect_list("sample_id")).alias("samples")).collect()}
    about = {}
    if stats is not None:
        pairs = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("feature_id", c))), lambda p: p[c])
        about = {(r.tree_id, r.node_id): (list(r.means), list(r.medians)) for r in stats.groupBy("tree_id", "node_id").agg(pairs("mean").alias("means"), pairs("median").alias("medians")).collect()}

    def build(tree, node):
        r = rows[tree, node]
        kids = [] if r.is_leaf else [build(tree, 2 * node), build(tree, 2 * node + 1)]
        up = rows.get((tree, node >> 1))
        made = None
        if up is not None and node > 1:
            feats = [{"name": names[f] if names else None, "index": f} for f in up.features]
            made = {"reduction": {"features": feats, "means": list(up.means), "scores": list(up.scores)}, "split": up.split, "orientation": bool(node & 1)}
        samples = held.get((tree, node), []) if r.is_leaf else sorted(s for k in kids for s in k["samples"])
        means, medians = about.get((tree, node), (None, None))
        return {"samples": samples, "means": means, "medians": medians, "filter": made, "depth": r.level, "children": kids}

    out = [(t, json.dumps(build(t, 1))) for t in sorted({k[0] for k in rows})]
    return nodes.sparkSession.createDataFrame(out, "tree_id int, value string")


def write_json(trees: DataFrame, path: str) -> None:
    """One text file per tree under ``path/tree_id=<n>``."""
    trees.repartition("tree_id").write.partitionBy("tree_id").text(path)


def from_mllib(model, spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved MLlib random forest regression model: (tree_id, node_id, level, is_leaf, ...)."""
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    by: dict[int, dict[int, object]] = {}
    for r in data.select("treeID", "id", "leftChild", "rightChild", "split").collect():
        by.setdefault(r.treeID, {})[r.id] = r
    rows = []
    for t, nodes in by.items():
        todo = [(0, 1)]
        while todo:
            i, at = todo.pop()
            r = nodes[i]
            inner = r.leftChild >= 0
            rows.append((t, at, at.bit_length() - 1, not inner, *(([r.split.featureIndex], [0.0], [1.0], float(r.split.leftCategoriesOrThreshold[0])) if inner else (None,) * 4)))
            if inner:
                todo += [(r.leftChild, 2 * at), (r.rightChild, 2 * at + 1)]
    return spark.createDataFrame(sorted(rows), NODE_SCHEMA)
