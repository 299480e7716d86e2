"""Connected components by alternating star contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Columns (``node``, ``root``) for every node of ``edges`` (``a``, ``b``): the least node that it
    reaches. Nulls and loops are ignored; no edges give no rows.

    Each round links every node's larger neighbours to its least one (large star), then its smaller
    ones (small star). Rounds are about the logarithm of the longest path. Minima are partially
    aggregated before the shuffle, and the join on a node with many neighbours can be split by AQE,
    since nothing above it needs all rows of a node together.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    e = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_low, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        e = cut(small, instead_of=e)
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        last = (state.n, state.s)
