"""Best-fit packing: documents as token pieces, packed by best fit, longest first, into sequences.

Best fit decreasing looks at lengths alone, and a length is a whole number up to the sequence's. So the
number of pieces of each length is all that packing needs: a segment tree over the remaining
capacities finds the tightest open sequences in logarithmic time, for all pieces of a length that meet
sequences of one capacity at once. The result is that of best fit decreasing, piece by piece, while
the driver holds one count for each length. Pieces then find their place by their rank among those
of their length.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import by_bytes, cut, table

#: Words whose ids a worker remembers, and the longest of them; it forgets all beyond that.
REMEMBERED, LONG = 600_000, 64

#: A space between two characters that are not white space: no token reaches across, but to take the
#: space as its first byte.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


class Encoder(dict):
    """Ids of texts as little-endian 32-bit words, word by word, for one byte-level vocabulary. As a
    dictionary it holds what follows a space: the word's ids, or None if white space at its border
    might join its neighbour's."""

    def __init__(self, path: str):
        super().__init__()
        self.plain = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The vocabulary of the file in the library that is faster at single words."""
        import tiktoken

        from evidentia.llm.token_counts import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # Fixed value: the word pattern of byte-level vocabularies of this kind.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> bytes:
        plain = self.plain
        some = array("I", plain.encode(text, allowed_special="all") if "<|" in text else plain.encode_ordinary(text))
        if sys.byteorder == "big":
            some.byteswap()
        return some.tobytes()

    def __missing__(self, word: str) -> bytes | None:
        known = None if not word or word[0].isspace() or word[-1].isspace() else self.ids(" " + word)
        if len(word) <= LONG:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = known
        return known

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if words and first and not first[-1].isspace():
            try:
                return self.ids(first) + b"".join(map(self.__getitem__, words))
            except TypeError:  # a word with white space at its border
                pass
        first, *words = _BETWEEN.split(text)
        get = self.get
        return self.ids(first) + b"".join([get(w) or self.ids(" " + w) for w in words])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(df: DataFrame, vocabulary: str, limit: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every row's text: its ids and the ``end`` id, cut into ``limit`` tokens where longer;
    of those pieces the first takes what is left over. Columns: the id as ``id``, ``row`` (a number of
    the row), ``piece`` (from 0), ``start`` (ids of the row before it), ``length``, ``ids_crc32`` and,
    with ``with_ids``, ``ids``.

    Null and empty texts make one piece, the ``end`` id; repeated rows each make theirs; a null id
    stays; other columns are not read. Strings of special tokens are those tokens.
    """
    if limit < 1:
        raise ValueError("at least one token a piece")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            for part in by_bytes(batch):
                source, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    data = (encode(text) if text else b"") + last
                    total = len(data) // 4
                    at, to, number = 0, total % limit or min(total, limit), 0
                    while at < total:
                        some = data[4 * at : 4 * to]
                        source.append(i)
                        piece.append(number)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(some))
                        if with_ids:
                            ids.append(np.frombuffer(some, dtype="<u4").astype(np.int64))
                        at, to, number = to, to + limit, number + 1
                at = pa.array(source, pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


class Capacities:
    """Open sequences by remaining capacity: runs of sequences of one capacity at the leaves of a segment
    tree whose nodes say whether anything is open below."""

    def __init__(self, limit: int):
        self.width = 1 << limit.bit_length()
        self.open = bytearray(2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        """``n`` sequences from number ``first`` on with ``room`` left; full ones are closed."""
        if room and n:
            self.runs[room].append((first, n))
            at = room + self.width
            while at and not self.open[at]:
                self.open[at] = 1
                at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of ``least`` or more that any open sequence has."""
        at = least + self.width
        while not self.open[at]:
            while at & 1:  # a right child: what follows lies beyond its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.width

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            at = room + self.width
            self.open[at] = 0
            while at > 1 and not self.open[at ^ 1]:
                at >>= 1
                self.open[at] = 0
        return run


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of ``counts[length]`` pieces of each length into sequences of ``limit``. Steps of
    (length, rank of the first piece among those of its length, pieces, pieces in each sequence, first
    sequence, place in the sequence): pieces fill the step's sequences one after the other.

    A piece enters the tightest sequence with room, which is then the tightest for the next one of its
    length as long as it has room; so a run of equal sequences takes its pieces at once. The steps, and
    the work, are bounded by the limit, not by the number of pieces.
    """
    rooms, steps, opened = Capacities(limit), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= limit:
            raise ValueError(f"pieces have 1 to {limit} tokens, not {length}")
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, n = limit, -(-left // (limit // length))
                first, opened = opened, opened + n
            else:
                first, n = rooms.take(room)
            each = room // length
            full = min(n, left // each)
            for bins, some in ((full, each), (1 if full < n else 0, left - full * each)):
                if bins and some:
                    steps.append((length, rank, bins * some, some, first, limit - room))
                    rooms.add(room - some * length, first, bins)
                    rank, left, first, n = rank + bins * some, left - bins * some, first + bins, n - bins
            rooms.add(room, first, n)
    return steps


def place(df: DataFrame, limit: int = 2048) -> DataFrame:
    """``df``, which has to be a written table with unique (``row``, ``piece``) and a ``length`` of 1 to
    ``limit``, with ``sequence_id`` and ``offset``: its place in as few sequences as best fit decreasing
    makes. An empty table gives no rows.

    Ranks among equal lengths come from counts by length and block (a block is what one task wrote), so
    a length that a third of all pieces have is numbered block by block. The driver gets one count for
    each length; executors get the steps, whose number the limit bounds.
    """
    spark = df.sparkSession
    parts = df.withColumn("_block", F.shiftright(F.col("row"), 33))
    by_block = parts.groupBy("length", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_block.select("length", "_block", before.alias("_base"))
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    steps = sorted(best_fit(counts, limit))
    columns = np.array(steps, dtype=np.int64).reshape(-1, 6).T
    shared = spark.sparkContext.broadcast((columns[0] << 44 | columns[1], *columns[1:]))

    number = F.row_number().over(Window.partitionBy("length", "_block").orderBy("row", "piece")) - 1
    ranked = parts.join(bases, ["length", "_block"]).withColumn("_rank", F.col("_base") + number).select(*df.columns, "_rank")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_rank, _, each, first, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            step = np.searchsorted(key, length << 44 | rank, side="right") - 1
            at = rank - first_rank[step]
            got = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*got, pa.array(first[step] + at // each[step]), pa.array(offset[step] + at % each[step] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(df: DataFrame, vocabulary: str, limit: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``pieces`` of every row with their ``sequence_id`` and ``offset`` (``place``). Texts are encoded once."""
    return place(cut(pieces(df, vocabulary, limit, end, id_col, text_col, with_ids)), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences of a table from ``pack`` with ids: ``sequence_id``, ``ids`` and ``lengths`` of
    the pieces in order, for attention that stays inside a piece. A sequence has at most ``limit`` ids."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    got = packed.groupBy("sequence_id").agg(held.alias("_held"))
    return got.select("sequence_id", F.flatten(F.col("_held.ids")).alias("ids"), F.col("_held.length").alias("lengths"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
