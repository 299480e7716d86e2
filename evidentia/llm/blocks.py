"""All-against-all work inside groups, in block pairs of bounded size.

A group's members are dealt to blocks of at most ``size`` members; a task gets two blocks. A hot group
so becomes many tasks, none of which holds it whole, and no pair is ever written as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(members: DataFrame, n: str, size: int, deal: Column) -> DataFrame:
    """``members`` once for each task that needs them, with ``bi`` <= ``bj``, the two blocks of the task,
    and ``mine``, the member's own block. ``n`` is the size of the member's group; ``deal`` is the integer
    hash that deals members to blocks. A group of up to ``size`` members is one task."""
    dealt = members.withColumn("_blocks", F.ceil(F.col(n) / size).cast("int")).withColumn("mine", F.pmod(deal, F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.withColumn("bi", F.least("mine", "_other")).withColumn("bj", F.greatest("mine", "_other")).drop("_other", "_blocks", n)


def block_pairs(members: DataFrame, key: str, counts: DataFrame, size: int, deal: Column) -> DataFrame:
    """``spread`` with the group sizes from ``counts`` (``key`` and ``n``)."""
    return spread(members.join(counts.select(key, F.col("n").alias("_n")), key), "_n", size, deal)
