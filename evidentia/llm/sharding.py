"""Sharding: indivisible groups of equal texts are packed by best fit, largest first.

Packing runs on two levels. Small groups are packed into bundles, in buckets of bounded size on the
executors; bundles and large groups, whose number the shard count bounds, are packed into the shards
on the driver. On both levels a group enters the bin with the tightest remaining room, found in a
balanced tree.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut, table

#: Bytes that every row counts besides its text.
ROW_BYTES = 16
#: A group or bundle is at most this part of a shard, or else a single large group.
FINE = 256
#: Groups in a bucket and buckets at most.
BUCKET_GROUPS, BUCKETS = 50_000, 1 << 17


class Rooms:
    """Bins by remaining room in a balanced binary search tree (an AA tree)."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [level, key, left, right]

    @staticmethod
    def _skew(t: list) -> list:
        if (left := t[2]) is not None and left[0] == t[0]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t: list) -> list:
        if (right := t[3]) is not None and right[3] is not None and right[3][0] == t[0]:
            t[3], right[2] = right[2], t
            right[0] += 1
            return right
        return t

    def add(self, room: int, name: int) -> None:
        def put(t: list | None) -> list:
            if t is None:
                return [1, key, None, None]
            side = 2 if key < t[1] else 3
            t[side] = put(t[side])
            return self._split(self._skew(t))

        key = (room, name)
        self.root = put(self.root)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the smallest room of ``least`` or more, the lowest number
        among equals."""
        t, best = self.root, None
        while t is not None:
            if t[1][0] >= least:
                best, t = t[1], t[2]
            else:
                t = t[3]
        if best is not None:
            self.root = self._without(self.root, best)
        return best

    def take_widest(self) -> tuple[int, int]:
        t = self.root
        while t[3] is not None:
            t = t[3]
        best = t[1]
        self.root = self._without(self.root, best)
        return best

    def _without(self, t: list | None, key: tuple[int, int]) -> list | None:
        if t is None:
            return None
        if key < t[1]:
            t[2] = self._without(t[2], key)
        elif key > t[1]:
            t[3] = self._without(t[3], key)
        elif t[2] is None:
            return t[3]
        else:
            near = t[2]
            while near[3] is not None:
                near = near[3]
            t[1] = near[1]
            t[2] = self._without(t[2], near[1])
        low = min(t[2][0] if t[2] else 0, t[3][0] if t[3] else 0) + 1
        if low < t[0]:
            t[0] = low
            if t[3] is not None and t[3][0] > low:
                t[3][0] = low
        t = self._skew(t)
        if t[3] is not None:
            t[3] = self._skew(t[3])
            if t[3][3] is not None:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3] is not None:
            t[3] = self._split(t[3])
        return t


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, bins numbered as they open; a size over the capacity has a bin to itself."""
    rooms, out, n = Rooms(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = rooms.take(sizes[i]) if sizes[i] <= capacity else None
        if got is None:
            got, n = (capacity, n), n + 1
        out[i] = got[1]
        if got[0] > sizes[i]:
            rooms.add(got[0] - sizes[i], got[1])
    return out


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size so that the shards' sums are near equal: best fit, largest first, into
    ``shards`` bins. A size above the fair share of what is left has a shard to itself; the others
    share the capacity that remains; what fits nowhere enters the widest room."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    out, rest, bins, at = [0] * len(sizes), sum(sizes), shards, 0
    while at < len(order) and bins > 1 and sizes[order[at]] * bins >= rest:
        out[order[at]] = shards - bins
        rest -= sizes[order[at]]
        bins, at = bins - 1, at + 1
    room, rooms = -(-rest // bins), Rooms()
    for b in range(bins):
        rooms.add(room, shards - bins + b)
    for i in order[at:]:
        got = rooms.take(sizes[i]) or rooms.take_widest()
        out[i] = got[1]
        rooms.add(got[0] - sizes[i], got[1])
    return out


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id``, ``size`` (UTF-8 bytes of the text plus 16),
    ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows of equal text stay together; null counts as the empty text. Shards are near equal in bytes:
    apart by about 1/256 of a shard where no group is larger than a shard; a larger group has one of
    its own. Repeated rows are rows of their own. Shards without rows are possible if there are fewer
    groups than shards; an empty table gives no rows.

    Groups are summed before they are shuffled. Rows find their shard by a join on the text's digest:
    large groups (a bounded number) by broadcast, the others, none of which is large, by a shuffle.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    large = max(1, math.ceil((total.bytes or 0) / shards / FINE))
    buckets = max(1, min(BUCKETS, math.ceil(total.n / BUCKET_GROUPS)))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(bundle=best_fit_decreasing(pdf["bytes"].tolist(), large))

    small = groups.where(F.col("bytes") < large).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    bundled = cut(small.groupBy("bucket").applyInPandas(bundle, "digest binary, bytes bigint, n bigint, bucket int, bundle bigint"))

    # The driver gets bundles and large groups: at most shards * 256 of these, and as many full bundles
    # and one more for each bucket; and the row counts of blocks.
    step = max(256, total.n // 4096)
    bundles = bundled.groupBy("bucket", "bundle").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("bucket", "bundle").collect()
    alone = groups.where(F.col("bytes") >= large).orderBy("digest").collect()
    place = into_shards([*(b.bytes for b in bundles), *(g.bytes for g in alone)], shards)
    filled = [0] * shards
    placed = []
    for b, s in zip(bundles, place):
        placed.append((b.bucket, b.bundle, s, filled[s]))
        filled[s] += b.n

    by_bundle = spark.createDataFrame(placed, "bucket int, bundle bigint, shard int, base bigint")
    where = bundled.join(F.broadcast(by_bundle), ["bucket", "bundle"]).select("digest", "bucket", "bundle", "shard", "base")
    named = {bytes(g.digest): (i, s) for i, (g, s) in enumerate(zip(alone, place[len(bundles) :]))}
    of_alone = spark.createDataFrame([(bytearray(d), i, s, -(-alone[i].n // step)) for d, (i, s) in named.items()], "digest binary, alone int, shard int, blocks bigint")

    # A large group's rows are numbered in blocks, so that no task has to hold all of them.
    hot = rows.join(F.broadcast(of_alone), "digest").withColumn("block", F.pmod(F.xxhash64("id", "row"), F.col("blocks")))
    bases = []
    for r in hot.groupBy("alone", "shard", "block").count().orderBy("alone", "block").collect():
        bases.append((r.alone, r.block, filled[r.shard]))
        filled[r.shard] += r["count"]
    by_block = spark.createDataFrame(bases, "alone int, block bigint, base bigint")
    hot = hot.join(F.broadcast(by_block), ["alone", "block"]).select("id", "row", "size", "text_crc32", "shard", "base", F.col("alone").alias("a"), F.col("block").alias("b"))
    cold = rows.join(F.broadcast(of_alone.select("digest")), "digest", "left_anti").join(where, "digest").select("id", "row", "size", "text_crc32", "shard", "base", (-F.col("bucket") - 1).alias("a"), F.col("bundle").alias("b"))
    number = F.row_number().over(Window.partitionBy("a", "b").orderBy("id", "row"))
    return hot.unionByName(cold).select("id", "size", "text_crc32", "shard", (F.col("base") + number - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return shard(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op8_sharding": op8_sharding}
