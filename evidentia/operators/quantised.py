"""Dense ranking over product-quantised vectors: a table look-up scan, then an exact re-rank.

A vector's parts are coded by the nearest of 256 words each. A query's products with all words make a
table, and a code's score is the sum of one entry a part; so a scan reads a byte for each part of a
vector. The best by these scores are ranked again by their exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.scorers import cosine, dot
from evidentia.operators.rank import small, top_k
from evidentia.operators.tables import cut

#: Vectors that the code words are fitted on, about, chosen by a hash of the id; all are coded and scanned.
SAMPLE = 20_000
#: Components in a part, and words for each part.
PART, WORDS = 4, 256
#: Queries whose tables are shared at a time: 16 KB each with 64 components.
QUERIES = 1000
#: Rows of codes that are scored at once.
ROWS = 2048


def fit(vectors: np.ndarray, part: int = PART, words: int = WORDS, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Code words, parts by words by components, by k-means in each part."""
    rng = np.random.default_rng(seed)
    n, size = vectors.shape
    parts = -(-size // part)
    padded = np.pad(vectors.astype(np.float32), ((0, 0), (0, parts * part - size))).reshape(n, parts, part)
    books = np.zeros((parts, words, part), np.float32)
    for m in range(parts):
        x = padded[:, m]
        c = x[rng.choice(n, words, replace=n < words)].copy()
        for _ in range(rounds):
            near = nearest(x, c)
            sums, count = np.zeros_like(c), np.bincount(near, minlength=words)
            np.add.at(sums, near, x)
            c[count > 0] = sums[count > 0] / count[count > 0, None]
            c[count == 0] = x[rng.integers(n, size=int((count == 0).sum()))]
        books[m] = c
    return books


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * x @ words.T, axis=1)


def encode(vectors: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, part = books.shape
    padded = np.pad(vectors.astype(np.float32), ((0, 0), (0, parts * part - vectors.shape[1]))).reshape(len(vectors), parts, part)
    return np.stack([nearest(padded[:, m], books[m]) for m in range(parts)], axis=1).astype(np.uint8)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Parts by words by queries: the product of each query's part with each word."""
    parts, _, part = books.shape
    padded = np.pad(queries.astype(np.float32), ((0, 0), (0, parts * part - queries.shape[1]))).reshape(len(queries), parts, part)
    return np.einsum("mwp,qmp->mwq", books, padded).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def dense_top_k(corpus: DataFrame, queries: DataFrame, doc_id: str, query_id: str, vector: str, k: int, unit: bool = False, sample: int = SAMPLE, widen: int = 20) -> DataFrame:
    """``rank.dense_top_k`` by quantised vectors: every row is scanned for every query, ``widen * k`` of them
    by their codes are ranked by exact products. Approximate: a row is missed if its code misleads by
    more than that; tests state the recall. Rows without a vector, or of another length than most, are in
    no ranking. Ids have to be unique.

    Codes, a byte for each part, are written once. Queries go to all tasks ``QUERIES`` at a time, each
    task keeps its best for each query, and vectors of candidates alone are fetched.
    """
    spark = corpus.sparkSession
    sizes = corpus.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return corpus.limit(0).select(F.lit(None).cast(dict(queries.dtypes)[query_id]).alias(query_id), F.col(doc_id), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    rows = corpus.where(F.size(vector) == sizes[0].n).select(F.col(doc_id).alias("_d"), F.col(vector).cast("array<float>").alias("_dv"))
    share = max(1, round(sizes[0]["count"] / sample))
    some = np.array([r._dv for r in rows.where(F.pmod(F.xxhash64("_d"), F.lit(share)) == 0).select("_dv").collect()], dtype=np.float32)  # about ``sample`` rows
    books = spark.sparkContext.broadcast(fit(_unit(some) if unit else some))
    kind = dict(rows.dtypes)["_d"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).to_pylist(), dtype=np.float32)
                codes = encode(_unit(x) if unit else x, books.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["_d", "_code"])

    codes = cut(rows.mapInArrow(coded, f"_d {kind}, _code binary"))
    asked = queries.where(F.size(vector) == sizes[0].n).select(F.col(query_id).alias("_q"), F.col(vector).cast("array<float>").alias("_qv"))
    turns = -(-asked.count() // QUERIES) or 1
    keep, best = widen * k, None
    for turn in range(turns):
        held = asked.where(F.pmod(F.xxhash64("_q"), F.lit(turns)) == turn).orderBy("_q").collect()  # about QUERIES rows
        if not held:
            continue
        x = np.array([r._qv for r in held], dtype=np.float32)
        shared = spark.sparkContext.broadcast((tables(_unit(x) if unit else x, books.value), pa.array([r._q for r in held], pa.int64() if kind in ("bigint", "int") else None)))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, names = shared.value
            parts, _, n = table.shape
            top, ids = np.full((0, n), -np.inf, np.float32), []
            chosen = np.zeros((0, n), np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    some = batch.slice(at, ROWS)
                    code = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, parts)
                    score = table[0][code[:, 0]]
                    for m in range(1, parts):
                        score += table[m][code[:, m]]
                    place = len(ids) + np.arange(len(code))
                    ids += some.column(0).to_pylist()
                    both, who = np.concatenate((top, score)), np.concatenate((chosen, np.repeat(place[:, None], n, axis=1)))
                    if len(both) > keep:
                        first = np.argpartition(-both, keep - 1, axis=0)[:keep]
                        both, who = np.take_along_axis(both, first, 0), np.take_along_axis(who, first, 0)
                    top, chosen = both, who
                    live, chosen = np.unique(chosen, return_inverse=True)
                    ids, chosen = [ids[i] for i in live.tolist()], chosen.reshape(top.shape)
            if len(top):
                q = np.tile(np.arange(n), len(top))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array([ids[i] for i in chosen.ravel().tolist()]), pa.array(top.ravel().astype(np.float64))], names=["_q", "_d", "_near"])

        got = top_k(codes.mapInArrow(scan, f"_q {dict(asked.dtypes)['_q']}, _d {kind}, _near double").where("_q <> _d"), ["_q"], [F.desc("_near"), F.asc("_d")], keep, "_place")
        best = got if best is None else best.unionByName(got)
    if best is None:
        return corpus.limit(0).select(F.lit(None).cast(dict(queries.dtypes)[query_id]).alias(query_id), F.col(doc_id), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    near = cut(best.select("_q", "_d"))
    pairs = corpus.select(F.col(doc_id).alias("_d"), F.col(vector).alias("_dv")).join(small(near), "_d").join(small(queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("_qv")), QUERIES), "_q")
    score = cosine(F.col("_dv"), F.col("_qv")) if unit else dot(F.col("_dv"), F.col("_qv"))
    exact = pairs.select(F.col("_q").alias(query_id), F.col("_d").alias(doc_id), F.round(score, 6).alias("score"))
    return top_k(exact, [query_id], [F.desc("score"), F.asc(doc_id)], k)
