"""Text matrices and headers, and flat text output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): numbered non-blank lines in file order.

    Line numbers come from the position of each line in its split, with the
    splits' sizes summed: no global sort.
    """
    raw = spark.read.text(path).withColumn("__id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    part = F.shiftright("__id", 33)
    sizes = raw.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "first")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("__id")) - 1
    return raw.withColumn("part", part).join(first, "part").select((F.col("first") + inside).alias("line"), "value")


def _tokens(value):
    return F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " ")


def read_matrix(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Whitespace-delimited numbers, a sample per line -> wide matrix.

    A token that is no number is an error, or null when not strict.
    """
    cells = F.transform(_tokens(F.col("value")), lambda t: t.try_cast("double"))
    rows = lines(spark, path).select(F.col("line").cast("long").alias("sample_id"), cells.alias("x"), "value")
    if strict:
        bad = F.exists("x", lambda v: v.isNull() | F.isnan(v))
        rows = rows.withColumn("x", F.when(bad, F.raise_error(F.concat(F.lit("not a number in line "), F.col("sample_id").cast("string")))).otherwise(F.col("x")))
    return rows.select("sample_id", "x")


def number_repeats(names: DataFrame, order: str, name: str = "name") -> DataFrame:
    """Repeated names get their count as a suffix: a, a1, a2."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return names.withColumn(name, F.when(k > 0, F.concat(name, k.cast("string"))).otherwise(F.col(name)))


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One name per line -> (feature_id, name)."""
    named = lines(spark, path).select(F.col("line").cast("int").alias("feature_id"), F.trim("value").alias("name"))
    return number_repeats(named, "feature_id")


def write_tsv(w: DataFrame, path: str, mode: str = "error") -> None:
    """Rows of a wide matrix as tab-separated text."""
    tsv(w).select("value").write.mode(mode).text(path)


def tsv(w: DataFrame) -> DataFrame:
    return w.select("sample_id", F.concat_ws("\t", F.transform("x", lambda v: v.cast("string"))).alias("value"))


def write_names(names: DataFrame, path: str) -> None:
    names.orderBy("feature_id").select(F.col("name").alias("value")).coalesce(1).write.text(path)
