"""Shared pieces of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidentia.operators.tables import checkpoint_folder, cut  # noqa: F401
from evidentia.plans.base import t

#: White space of the word contracts: space and the bytes 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of text that a worker handles at once.
CHUNK_BYTES = 2 << 20

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return t(spark, sf_dir, name)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def over_batches(df: DataFrame, one: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch | None], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` with a function of one batch, of about ``limit`` bytes, that returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, limit):
                out = one(part)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes each, one row at least: long texts don't add up."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order, by a sort: ``np.unique`` without counts hashes them, which takes much longer."""
    x = np.sort(x)
    return x[np.concatenate((np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]))]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x = x * _MIX2
    x ^= x >> np.uint64(31)
    return x


#: One random odd multiplier for each place in a word; places from 4096 on use them again, shifted.
_PLACE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: What a byte adds to its word's hash: nothing for white space; A-Z count as a-z.
_VALUE = np.where(SPACE, 0, np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + 1).astype(np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the lower-cased words of all texts in order, index of each text's first word,
    with the total at the end). Words are runs of bytes that are not white space; A-Z are lower-cased."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = SPACE[joined]
    start = ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    bounds = np.concatenate(([0], np.searchsorted(first, ends)))
    if not len(first):
        return np.zeros(0, np.uint64), bounds
    values = _VALUE[joined[first[0] :]]
    # A word's stretch goes up to the next word; the white space in it adds nothing.
    place = np.arange(len(values)) - np.repeat(first - first[0], np.diff(np.append(first, len(joined))))
    if place.max() > 4095:
        values += (place >> 12).astype(np.uint64) * np.uint64(257) * (values > 0)
        place &= 4095
    values *= _PLACE[place]
    return mix64(np.add.reduceat(values, first - first[0])), bounds


_TURN = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words in order; the whole sequence as one if it is shorter, none if empty."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(size, n)
    total = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += words[i : n - k + 1 + i] * _TURN[i]
    return mix64(total)
