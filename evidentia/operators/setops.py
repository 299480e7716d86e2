"""Set operations over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    """All rows by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def intersect_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def except_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def missing_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """Numbers below ``n`` that the key lacks: empty if the table is complete."""
    return df.sparkSession.range(n).select(F.col("id").alias(key)).join(df.select(key).distinct(), key, "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with repeats, marked by side; none if the tables are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def positional_split(df: DataFrame, position: str, edges: list[int]) -> DataFrame:
    """``df`` with ``part``: the number of the range of positions that a row falls into."""
    part = F.lit(0)
    for e in edges[1:-1]:
        part = part + (F.col(position) >= e).cast("int")
    return df.where((F.col(position) >= edges[0]) & (F.col(position) < edges[-1])).withColumn("part", part)


def finished(reference: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Reference rows with ``done``: whether exactly one result has their key."""
    counts = results.groupBy(key).agg(F.count("*").alias("_n"))
    return reference.join(counts, key, "left").withColumn("done", F.coalesce(F.col("_n") == 1, F.lit(False))).drop("_n")
