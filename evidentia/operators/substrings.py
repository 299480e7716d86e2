"""Which texts hold which strings, by the rarest piece of each string.

Pieces are runs of up to eight bytes, which fit a machine word. A string's anchor is the one of its
pieces that fewest texts have. Texts give the anchors that they have in one scan, a shuffled join on
the anchor finds the strings, and each candidate is checked whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from evidentia.operators.tables import cut

#: Bytes of a piece; shorter strings are one piece.
PIECE = 8
#: Bits of the map that tells which pieces may matter. Its size is fixed: more strings let more pieces of
#: texts pass, and the join sorts them out.
MAP_BITS = 22
#: Bytes of a text that are taken apart at once.
SLICE = 1 << 20


def _mixed(words: np.ndarray, size: int) -> np.ndarray:
    """Keys of pieces of ``size`` bytes, spread over all 64 bits."""
    x = (words ^ np.uint64(size * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def keys(data: bytes, size: int) -> Iterator[np.ndarray]:
    """Keys of all pieces of ``size`` bytes of a text, a slice at a time. The empty piece is in every text."""
    if not size:
        yield _mixed(np.zeros(1, np.uint64), 0)
        return
    every = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(every) - size + 1, SLICE):
        part = every[at : at + SLICE + size - 1]
        n = len(part) - size + 1
        words = np.zeros(n, np.uint64)
        for i in range(size):
            words |= part[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        yield _mixed(words, size)


def slots(k: np.ndarray) -> np.ndarray:
    """Where keys fall in the map: their highest bits."""
    return (k >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def key_map(of: DataFrame, key: str) -> np.ndarray:
    """One bit for each slot of the map that some key falls into; 2^16 words at the driver at most."""
    found = of.select(F.shiftrightunsigned(F.col(key), 64 - MAP_BITS).alias("slot"))
    bits = found.select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(slot, 64) as int))").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    packed = np.zeros(1 << (MAP_BITS - 6), np.int64)
    for r in words:
        packed[r.word] = r.bits
    return np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)


def _pieces(df: DataFrame, schema: StructType, sizes: list[int], known, counted: bool) -> DataFrame:
    """Keys of the pieces of each row's text, each once, that ``known``, a shared map, has: summed up for a
    batch (``key``, ``n``), or beside the row's other columns (``key``). The text is the last column."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = known.value if known is not None else None
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if text is None:
                    continue
                got = [k if there is None else k[there[slots(k)]] for size in (sizes or [min(PIECE, len(text))]) for k in keys(text, size)]
                got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.uint64)
                found.append(got.view(np.int64))
                rows.append(np.full(len(got), i))
            every = np.concatenate(found) if found else np.zeros(0, np.int64)
            if counted:
                key, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], schema=arrow)
                continue
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            kept = [batch.column(j).take(at) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(every)], schema=arrow)

    return df.mapInArrow(run, schema)


def holding(texts: DataFrame, strings: DataFrame, text: str, string: str) -> DataFrame:
    """The rows of ``texts`` with those of ``strings`` that they hold, all columns of both. Null holds
    nothing and is in nothing; the empty string is in every text. Strings are not broadcast, and no
    pair is looked at that does not share the string's rarest piece. Column names have to differ.

    Texts are scanned twice, to count the pieces that strings have, and to find the anchors; what they
    have besides is never shuffled. Memory is bounded by the longest text and a map of fixed size.
    """
    spark = texts.sparkSession
    of = cut(strings.where(F.col(string).isNotNull()))
    distinct = of.select(F.col(string).alias("_string")).distinct()
    length = F.least(F.octet_length("_string"), F.lit(PIECE))
    sizes = sorted(r.n for r in distinct.select(length.alias("n")).distinct().collect())  # PIECE + 1 values at most
    binary = distinct.select("_string", F.col("_string").cast("binary").alias("_b"))
    keyed = StructType([StructField("_string", distinct.schema["_string"].dataType), StructField("_key", LongType())])
    parts = cut(_pieces(binary, keyed, [], None, False))
    if not sizes:
        return texts.join(of, F.lit(False))
    counted = StructType([StructField("_key", LongType()), StructField("_n", LongType())])
    plain = texts.select(F.col(text).cast("binary").alias("_b"))
    counts = _pieces(plain, counted, sizes, _share(spark, parts), True).groupBy("_key").agg(F.sum("_n").alias("_n"))
    # A string one of whose pieces no text has is in none.
    scored = parts.join(counts, "_key", "left").groupBy("_string").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_key").alias("key"))).alias("_a"))
    anchors = cut(scored.where("_a.n > 0").select("_string", F.col("_a.key").alias("_key")))
    carried = StructType([*texts.schema.fields, StructField("_key", LongType())])
    hits = _pieces(texts.withColumn("_b", F.col(text).cast("binary")), carried, sizes, _share(spark, anchors), False)
    found = hits.join(anchors, "_key").where(F.contains(F.col(text), F.col("_string")))
    return found.drop("_key").join(of, F.col("_string") == F.col(string)).drop("_string")


def _share(spark: SparkSession, of: DataFrame):
    return spark.sparkContext.broadcast(key_map(of, "_key"))
