"""Joins that the evidence workloads need, on explicit keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.rank import ordinal, running_offset, small
from evidentia.operators.substrings import holding
from evidentia.operators.tables import cut

#: First rows of keys up to which they are broadcast.
FIRST = 1000


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[Column], how: str = "inner") -> DataFrame:
    """Equi-join with the first right row of each key. Up to ``FIRST`` of them go to the left rows, which stay in
    their tasks; so no task reads all rows of a key that many have."""
    first = cut(right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n"))
    return left.join(small(first, FIRST) if how in ("inner", "left", "left_semi", "left_anti") else first, key, how)


def substring_first(queries: DataFrame, claims: DataFrame, query: str, claim: str, by: list[str], order: list[Column]) -> DataFrame:
    """Each query with the first claim that it contains, by the claims' rarest pieces (``substrings``)."""
    hit = holding(queries, claims, query, claim)
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def positional(left: DataFrame, right: DataFrame, ordinal: str) -> DataFrame:
    """Row by row join on an explicit ordinal."""
    return left.join(right, ordinal)


def offset_join(nested: DataFrame, flat: DataFrame, size: str, key: list[str], by: list[str], position: str) -> DataFrame:
    """Rows with ``size`` consecutive entries of a flat table each: entry i of a row is at the sum of the
    sizes before it plus i. ``flat`` has ``position`` within ``by``."""
    placed = running_offset(nested, size, [F.asc(c) for c in key], by).where(F.col(size) > 0)
    entries = placed.withColumn("q_idx", F.explode(F.sequence(F.lit(0), F.col(size) - 1))).withColumn(position, F.col("base") + F.col("q_idx"))
    return entries.join(flat, [*by, position])


def unprocessed(all_rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return all_rows.join(done.select(*key), key, "left_anti")


def resumable(all_rows: DataFrame, log: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows not in the log, and the log's last one again, since it may be unfinished."""
    last = log.agg(F.max(F.struct(F.col(ordinal).alias("_o"), F.col(key).alias("_k"))).alias("m")).select(F.col("m._k").alias(key))
    return all_rows.join(log.select(key).distinct().join(F.broadcast(last), key, "left_anti"), key, "left_anti")


def resume_after(all_rows: DataFrame, log: DataFrame, order: list[Column]) -> DataFrame:
    """Rows, in ``order``, after as many as the log has lines."""
    return ordinal(all_rows, order, "_o").where(F.col("_o") >= log.count()).drop("_o")


def lookup(items: Column, index: Column) -> Column:
    """Array element at a 0-based index; empty for a null or outside index."""
    return F.coalesce(F.get(items, index), F.lit(""))


def aligned(values: Column, wanted: Column, others: Column) -> Column:
    """The element of ``others`` at the first place where ``values`` holds ``wanted``; null if nowhere."""
    at = F.array_position(values, wanted)
    return F.when(at > 0, F.get(others, (at - 1).cast("int")))


def matching_sets(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows whose arrays are equal on both sides."""
    return left.join(right, key).where(F.col(a) == F.col(b))


def reorder(df: DataFrame, ids: DataFrame, key: str, place: str) -> DataFrame:
    """Rows of an id list in its order."""
    return df.join(ids, key).orderBy(place)


def pairs_in_group(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Every left row with every right row of its group: meant for the small groups of one claim."""
    return left.join(right, key)
