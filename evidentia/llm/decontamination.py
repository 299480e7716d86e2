"""Benchmark decontamination by latent semantic retrieval.

Passages (overlapping windows of words) become TF-IDF vectors over the words of the benchmark, with
frequencies over all documents; a randomised SVD of the benchmark's passages and those of all
documents, summed on the executors, gives the latent space; every passage of every document
is searched, and those near a piece of a benchmark item are candidates. A candidate counts if the longest common subsequence of words
covers most of the item, or less of it but nearly all of its answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import as_bytes, by_bytes, distinct, table, word_hashes

#: Words of a passage, and from one passage's start to the next.
PASSAGE, STRIDE = 64, 32
#: Most words of a piece of an item: each run of so many words lies whole in some passage.
PIECE = 32
#: Benchmark items, and pieces of them, searched at a time, about; the others follow in further turns.
ITEMS, PIECES = 2000, 4096
#: Pieces of items that share a latent space: all of their vectors lie in it whole. Further dimensions
#: for the passages of documents.
BLOCK, FURTHER = 128, 16
#: Features in one row of the summed matrix, and entries projected at once.
ROWS, ENTRIES = 256, 16_384
#: Least latent cosine of a candidate; what holds enough of a piece is one whatever its cosine.
CANDIDATE = 0.4
#: Words in more than this share of documents make no feature, but the rarest few of each piece do.
COMMON, RAREST = 0.05, 24
#: Share of an item's words in the common subsequence; the lower one needs the answer too.
WHOLE, PART, ANSWER = 0.8, 0.6, 0.8


@dataclass
class Block:
    """Some pieces of items and the latent space that holds them all: 4 MB or so. Features are
    numbered within the block."""

    number: np.ndarray  # of each word of the vocabulary, -1 if no piece here has it
    idf: np.ndarray
    vectors: np.ndarray  # pieces x features
    item: np.ndarray  # of each piece
    enough: np.ndarray  # for each piece, the latent product from which on a passage is a candidate
    least: float  # least squared weight of a passage that can be a candidate
    omega: np.ndarray | None = None  # features x dimensions for documents
    #: Projection onto the space and product with the pieces there, as one sparse map from features to
    #: pieces: where each feature's entries begin, their pieces and values.
    fold: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


@dataclass
class Space:
    """What a search needs of the items searched at a time."""

    vocabulary: np.ndarray  # sorted word hashes
    first: np.ndarray  # by the highest bits of a hash, where its words begin
    idf: np.ndarray
    blocks: list[Block]
    ids: list
    words: list[np.ndarray]
    answers: list[tuple[int, int]]


def answer_of(text: bytes) -> tuple[int, int]:
    """The words (first, last and one) of an item's answer: what follows its last question mark, or else
    its last sentence."""
    body = text.rstrip().rstrip(b".!?")
    at = text.rfind(b"?", 0, len(body))
    if at < 0:
        at = max(body.rfind(b". "), body.rfind(b"! "), body.rfind(b"\n"))
    total, before = len(text.split()), len(text[: at + 1].split())
    return (before, total) if 0 < before < total else (0, total)


BITS = 18


def lookup(words: np.ndarray, vocabulary: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``words`` of those in the vocabulary, their numbers there)."""
    slot = (words >> np.uint64(64 - BITS)).astype(np.int64)
    at, end = first[slot], first[slot + 1]
    left = np.flatnonzero(at < end)
    found, number = [], []
    while len(left):
        hit = vocabulary[at[left]] == words[left]
        found.append(left[hit])
        number.append(at[left[hit]])
        left = left[~hit]
        at[left] += 1
        left = left[at[left] < end[left]]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, number = np.concatenate(found), np.concatenate(number)
    order = np.argsort(found, kind="stable")
    return found[order], number[order]


def slots(vocabulary: np.ndarray) -> np.ndarray:
    return np.searchsorted(vocabulary >> np.uint64(64 - BITS), np.arange((1 << BITS) + 1, dtype=np.uint64))


def passages(words: np.ndarray, bounds: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries' (passage, feature) rows in order, and the document and first word in it of each
    passage. Each feature counts once in a passage."""
    v = space.vocabulary
    hit, feature_of = lookup(words, v, space.first)
    some = space.idf[feature_of] > 0
    hit, feature_of = hit[some], feature_of[some]
    doc = np.searchsorted(bounds, hit, side="right") - 1
    place = hit - bounds[doc]
    n = np.diff(bounds)
    # Windows of a document start at 0, STRIDE, ... as long as they bring new words.
    count = np.maximum(1, -(-(n - PASSAGE) // STRIDE) + 1)
    base = np.concatenate(([0], np.cumsum(count)))
    last = np.minimum(place // STRIDE, count[doc] - 1)
    entries = []
    for back in range(-(-PASSAGE // STRIDE)):
        j = last - back
        ok = (j >= 0) & (place < j * STRIDE + PASSAGE)
        entries.append(((base[doc] + j) * len(v) + feature_of)[ok])
    entry = distinct(np.concatenate(entries))
    doc = np.repeat(np.arange(len(n)), count)
    return np.stack((entry // len(v), entry % len(v))), doc, (np.arange(len(doc)) - base[doc]) * STRIDE


def heavy(entries: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The passages whose weight in the block's features could make them candidates, and their entries
    with passages and features numbered anew."""
    number = block.number[entries[1]]
    here = number >= 0
    window, feature = entries[0][here], number[here]
    weight = np.bincount(window, weights=block.idf[feature] ** 2, minlength=1)
    some = weight[window] >= block.least
    window = window[some]  # in order, as entries are
    fresh = np.concatenate((np.ones(min(1, len(window)), dtype=bool), window[1:] != window[:-1]))
    return window[fresh], np.stack((np.cumsum(fresh) - 1, feature[some]))


def project(entries: np.ndarray, n: int, block: Block, basis: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some passages at a time: the first one's number, their entries, their latent vectors and
    their lengths in the block's features. Holds a vector for each of about ``ENTRIES`` entries."""
    row, feature = entries
    starts = np.append(np.searchsorted(row, np.arange(n)), len(row))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + ENTRIES, side="right")) - 1)
        lo, hi = starts[at], starts[end]
        w = block.idf[feature[lo:hi]]
        cuts = starts[at:end] - lo
        vectors = basis[feature[lo:hi]]
        vectors *= w[:, None].astype(np.float32)
        yield at, entries[:, lo:hi], np.add.reduceat(vectors, cuts, axis=0), np.sqrt(np.add.reduceat(w**2, cuts))
        at = end


#: Values of the folded map that are only rounding; passages scored at once.
TINY, SCORED = 1e-4, 8192


def folded(basis: np.ndarray, latent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``basis`` times the pieces' latent vectors. It is sparse, as the space holds the pieces' vectors
    whole: a feature that a piece does not have adds nothing to the product with it."""
    g = basis.astype(np.float64) @ latent.T
    feature, piece = np.nonzero(np.abs(g) > TINY)
    return np.searchsorted(feature, np.arange(len(g) + 1)), piece, g[feature, piece]


def scores(entries: np.ndarray, n: int, block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some passages at a time: the first one's number, their latent products with all pieces of the
    block, and their lengths in the block's features."""
    begin, piece, value = block.fold
    k = len(block.item)
    starts = np.searchsorted(entries[0], np.append(np.arange(0, n, SCORED), n))
    for at, lo, hi in zip(range(0, n, SCORED), starts, starts[1:]):
        row, feature = entries[0, lo:hi] - at, entries[1, lo:hi]
        m, w = min(SCORED, n - at), block.idf[feature]
        times = begin[feature + 1] - begin[feature]
        where = np.repeat(begin[feature] - np.cumsum(times) + times, times) + np.arange(times.sum())
        product = np.bincount(np.repeat(row * k, times) + piece[where], weights=np.repeat(w, times) * value[where], minlength=m * k)
        yield at, product.reshape(m, k), np.sqrt(np.bincount(row, weights=w**2, minlength=m))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each prefix of ``a``, the length of its longest common subsequence with ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int32)
    out = np.zeros(len(a) + 1, dtype=np.int32)
    for i, x in enumerate(a):
        step = np.where(b == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(step)
        out[i + 1] = row[-1]
    return out


def least_held(weights: np.ndarray, counts: np.ndarray, words: int) -> float:
    """A lower bound of the weight that is left of a piece of so many words if no more than
    ``1 - PART`` of them are gone. Features have a weight and a count of words in the piece."""
    order = np.argsort(-weights / counts, kind="stable")
    gone = np.clip((words - math.ceil(PART * words - 1e-9)) - (np.cumsum(counts[order]) - counts[order]), 0, counts[order])
    return float(weights.sum() - (weights[order] * gone / counts[order]).sum())


def leaks(item: np.ndarray, answer: tuple[int, int], words: np.ndarray) -> float | None:
    """The share of the item that the words hold in order, if it is enough, else None."""
    if not len(item) or not len(words):
        return None
    share = common_subsequence(item, words)[-1] / len(item)
    if share >= WHOLE:
        return float(share)
    lo, hi = answer
    if share >= PART and 0 < hi - lo < len(item) and common_subsequence(item[lo:hi], words)[-1] >= ANSWER * (hi - lo):
        return float(share)
    return None


def _task(df: DataFrame, one, schema: str) -> DataFrame:  # noqa: ANN001
    """``one`` gets all of a task's (ids, texts) in turn and yields frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = ((p.column(0).to_pylist(), as_bytes(p.column(1))) for b in batches for p in by_bytes(b))
        for frame in one(parts):
            if len(frame):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return df.mapInArrow(run, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it: ``id``, ``item`` and ``share``, the
    largest share of the item's words that some passage holds in order.

    Words are parted by space and the bytes 9 to 13, A-Z in lower case. Null and empty texts and items
    match nothing; rows with a null id, which no hit could name, are not searched; repeated ids count as
    one. Empty tables give no rows. Very long texts are cut into passages and searched whole. For each
    ``ITEMS`` items all documents are read three times, for frequencies, for the latent space and for the
    search, without a shuffle of texts; a task returns sums over the item vocabulary, or hits.
    """
    spark = docs.sparkSession
    kinds = dict(docs.select(F.col(id_col).alias("id")).dtypes) | dict(benchmark.select(F.col(item_col).alias("item")).dtypes)
    schema = f"id {kinds['id']}, item {kinds['item']}, share double"
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(F.col(text_col).cast("string")) > 0)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & (F.length(F.col(item_text).cast("string")) > 0)).select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    pieces = F.ceil(F.size(F.split("text", "[ \\x09-\\x0d]+")) / PIECE)
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(pieces), F.lit(0)).alias("pieces")).first()
    blocks = max(1, math.ceil(size.items / ITEMS), math.ceil(size.pieces / PIECES))
    found = None
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()  # about ITEMS rows
        one = _search(spark, rows, [(r.item, r.text.encode()) for r in some], schema)
        found = one if found is None else found.unionByName(one)
    return found.groupBy("id", "item").agg(F.max("share").alias("share"))


def _block(space: Space, parts: list[tuple[int, np.ndarray]]) -> Block:
    """The block of some (item, words) pieces."""
    number = np.full(len(space.vocabulary), -1, dtype=np.int32)
    of = [np.unique(np.searchsorted(space.vocabulary, part), return_counts=True) for _, part in parts]
    of = [(x[space.idf[x] > 0], n[space.idf[x] > 0]) for x, n in of]
    features = np.unique(np.concatenate([x for x, _ in of]))
    number[features] = np.arange(len(features))
    vectors = np.zeros((len(parts), len(features)), dtype=np.float32)
    for i, (x, _) in enumerate(of):
        vectors[i, number[x]] = space.idf[x]
    length = np.linalg.norm(vectors, axis=1)
    held = np.array([least_held(space.idf[x] ** 2, n, len(part)) for (x, n), (_, part) in zip(of, parts)]) * 0.999
    least = min(float(held.min()), float((CANDIDATE * length.min()) ** 2) * 0.999)
    rng = np.random.Generator(np.random.PCG64(len(features)))
    omega = rng.standard_normal((len(features), FURTHER)).astype(np.float32)
    return Block(number, space.idf[features], vectors, np.array([i for i, _ in parts]), held / length, least, omega)


def _search(spark: SparkSession, rows: DataFrame, items: list[tuple[object, bytes]], schema: str) -> DataFrame:
    words, bounds = word_hashes([t for _, t in items]) if items else (np.zeros(0, np.uint64), np.zeros(1, int))
    if not len(words):
        return spark.createDataFrame([], schema)
    v = np.unique(words)
    shared = spark.sparkContext.broadcast((v, slots(v)))

    def frequency(parts):  # noqa: ANN001, ANN202
        (v, first), seen, n = shared.value, None, 0
        for _, texts in parts:
            w, b = word_hashes(texts)
            hit, number = lookup(w, v, first)
            doc = np.searchsorted(b, hit, side="right") - 1
            c = np.bincount(distinct(doc * len(v) + number) % len(v), minlength=len(v))
            seen, n = c if seen is None else seen + c, n + len(texts)
        if seen is not None:
            yield pd.DataFrame({"feature": np.append(np.arange(len(v)), -1), "df": np.append(seen, n)}).astype("int64")

    counts = {r.feature: r.df for r in _task(rows, frequency, "feature bigint, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).collect()}  # a row for each item word
    total = max(1, counts.get(-1, 0))
    df = np.array([counts.get(i, 0) for i in range(len(v))], dtype=float)
    whole = [words[bounds[i] : bounds[i + 1]] for i in range(len(items))]
    parts = [(i, part) for i, item in enumerate(whole) if len(item) for part in np.array_split(item, -(-len(item) // PIECE))]
    kept = df <= max(COMMON * total, 2)
    for _, part in parts:
        of = np.unique(np.searchsorted(v, part))
        kept[of[np.argsort(df[of], kind="stable")[:RAREST]]] = True
    idf = np.where(kept, np.log((total + 1) / (df + 1)) + 1e-3, 0.0)
    space = Space(v, slots(v), idf, [], [i for i, _ in items], whole, [answer_of(t) for _, t in items])
    space.blocks = [_block(space, parts[at : at + BLOCK]) for at in range(0, len(parts), BLOCK)]
    probe = spark.sparkContext.broadcast(space)

    def sketch(parts):  # noqa: ANN001, ANN202
        space = probe.value
        sums, n = [None] * len(space.blocks), [0] * len(space.blocks)
        for _, texts in parts:
            entries, _, _ = passages(*word_hashes(texts), space)
            for k, block in enumerate(space.blocks):
                live, mine = heavy(entries, block)
                if not len(live):
                    continue
                y = sums[k] = np.zeros(block.omega.shape, dtype=np.float32) if sums[k] is None else sums[k]
                for at, (row, feature), latent, size in project(mine, len(live), block, block.omega):
                    order = np.argsort(feature, kind="stable")
                    row, feature = row[order] - at, feature[order]
                    back = (latent / size[:, None].astype(np.float32) ** 2)[row]
                    back *= block.idf[feature][:, None].astype(np.float32)
                    first = np.flatnonzero(np.concatenate(([True], np.diff(feature) != 0)))
                    y[feature[first]] += np.add.reduceat(back, first, axis=0)
                n[k] += len(live)
        for k, y in enumerate(sums):
            if y is not None:
                chunks = range(0, len(y), ROWS)
                yield pd.DataFrame({"block": k, "chunk": [c // ROWS for c in chunks], "n": n[k], "part": [y[c : c + ROWS].tobytes() for c in chunks]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"]]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "n": [int(pdf["n"].sum())], "part": [sum(parts[1:], parts[0]).astype(np.float32).tobytes()]})

    kind = "block bigint, chunk bigint, n bigint, part binary"
    sums = _task(rows, sketch, kind).groupBy("block", "chunk").applyInPandas(add, kind).collect()  # the item vocabulary by rank
    for k, block in enumerate(space.blocks):
        unit = block.vectors / np.linalg.norm(block.vectors, axis=1)[:, None]
        y = unit.T @ (unit @ block.omega)
        for r in sums:
            if r.block == k:
                y[r.chunk * ROWS : (r.chunk + 1) * ROWS] += np.frombuffer(r.part, np.float32).reshape(-1, y.shape[1]) / r.n
        # The first dimensions span the items' vectors, so that products with them are those of the features.
        basis = np.linalg.qr(np.concatenate((unit.T, y), axis=1))[0].astype(np.float32)
        block.fold, block.omega = folded(basis, unit @ basis), None
    ready = spark.sparkContext.broadcast(space)

    def search(parts):  # noqa: ANN001, ANN202
        space = ready.value
        for ids, texts in parts:
            w, b = word_hashes(texts)
            entries, doc, first = passages(w, b, space)
            near = set()
            for block in space.blocks:
                live, mine = heavy(entries, block)
                for at, product, size in scores(mine, len(live), block):
                    p, i = np.nonzero(product >= np.minimum(CANDIDATE * size[:, None], block.enough))
                    near.update(zip(live[at + p].tolist(), block.item[i].tolist()))
            out: dict[tuple[int, int], float] = {}
            for p, i in sorted(near):
                d, item = int(doc[p]), space.words[i]
                lo = b[d] + max(0, int(first[p]) - len(item))
                hi = min(b[d + 1], b[d] + int(first[p]) + PASSAGE + len(item))
                if out.get((d, i), 0.0) >= 1 or np.isin(item, w[lo:hi]).sum() / len(item) < PART:
                    continue
                if share := leaks(item, space.answers[i], w[lo:hi]):
                    out[d, i] = max(share, out.get((d, i), 0.0))
            if out:
                yield pd.DataFrame({"id": [ids[d] for d, _ in out], "item": [space.ids[i] for _, i in out], "share": list(out.values())})

    return _task(rows, search, schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_leaks`` of the benchmark in all documents: doc_id, item_id and share, one row for each hit."""
    got = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 6).alias("share"))


QUERIES = {"op10_decontamination": op10_decontamination}
