"""Scores of few queries against many rows, summed up and cut to the best in the tasks that hold the rows.

No pair of query and row leaves a task: it returns its ``k`` best rows of each query, and the best of
all tasks are the best of all rows. These helpers see Arrow batches inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products and cells summed up at once in a task.
CELLS = 1 << 21
#: Stands for a null id, which comes first in order.
NULL = -(1 << 63)


@dataclass
class Asked:
    """The queries of each numbered term: those of term t are at ``begin[t]`` to ``begin[t + 1]``."""

    begin: np.ndarray
    query: np.ndarray
    times: np.ndarray
    queries: int

    @staticmethod
    def of(term: list[int], query: list[int], times: list[int], terms: int, queries: int) -> Asked:
        order = np.lexsort((query, term))
        t = np.array(term, np.int64)[order]
        return Asked(np.searchsorted(t, np.arange(terms + 1)), np.array(query, np.int64)[order], np.array(times, np.float64)[order], queries)

    def pairs(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``term`` and each query of its term: the place, and where the query is."""
        n = self.begin[term + 1] - self.begin[term]
        return np.repeat(np.arange(len(term)), n), spread(self.begin[term], n)


def spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``begin`` on, one after another."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def summed(row: np.ndarray, query: np.ndarray, value: np.ndarray, rows: int, queries: int) -> np.ndarray:
    """Sums of ``value`` by row and query, in the order given; minus infinity where there is none."""
    cell = row * queries + query
    total = np.bincount(cell, weights=value, minlength=rows * queries)
    none = np.ones(rows * queries, dtype=bool)
    none[cell] = False
    total[none] = -np.inf
    return total.reshape(rows, queries)


class Best:
    """The ``k`` best rows of each query that a task has seen in each group: the highest score, rounded to 6
    places, then the lowest id."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.kept: dict[object, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.least: dict[object, np.ndarray] = {}  # the k-th score of each query so far

    def bar(self, group: object) -> np.ndarray:
        return self.least.setdefault(group, np.full(self.queries, -np.inf))

    def add(self, group: object, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: rows x queries, minus infinity for what is no match."""
        bar = self.bar(group)
        if len(ids) > self.k and np.isneginf(bar).any():
            bar = np.maximum(bar, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero((scores >= bar - 1e-6) & (scores > -np.inf))  # the bar is of rounded scores
        ids, score = ids[row], np.round(scores[row, query], 6) + 0.0
        if group in self.kept:
            ids, query, score = (np.concatenate(x) for x in zip(self.kept[group], (ids, query, score)))
        order = np.lexsort((ids, -score, query))
        ids, query, score = ids[order], query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.least[group][query[place == self.k - 1]] = score[place == self.k - 1]
        some = place < self.k
        self.kept[group] = ids[some], query[some], score[some]

    def batches(self, group: pa.Field | None, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Rows of group, ``_q``, ``_doc`` and ``score``."""
        for value, (ids, query, score) in self.kept.items():
            columns = {} if group is None else {group.name: pa.array([value] * len(ids), group.type)}
            yield pa.RecordBatch.from_pydict({**columns, "_q": pa.array(query.astype(np.int32)), "_doc": pa.array(ids, mask=ids == NULL).cast(kind), "score": pa.array(score)})


def counted(batches: Iterator[pa.RecordBatch], terms: list[str] | None) -> Iterator[pa.RecordBatch]:
    """For rows whose last column ``_tokens`` has their words: ``_len``, null for null, and their different
    words ``_terms`` with ``_tf`` occurrences; with ``terms``, only those, as numbers, in order."""
    wanted = None if terms is None else pa.array(terms, pa.string())
    for b in batches:
        words = b.column(b.num_columns - 1)
        size = pc.list_value_length(words)
        row = np.repeat(np.arange(len(b)), size.fill_null(0).to_numpy(zero_copy_only=False))
        if wanted is None:
            coded = words.flatten().dictionary_encode()
            code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        else:
            code, names = pc.index_in(words.flatten(), value_set=wanted).fill_null(-1).to_numpy(zero_copy_only=False), None
            row, code = row[code >= 0], code[code >= 0]
        v = len(wanted if names is None else names) + 1
        key, n = np.unique(row * v + code, return_counts=True)
        offsets = pa.array(np.searchsorted(key // v, np.arange(len(b) + 1)).astype(np.int32))
        number = pa.array((key % v).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, number if names is None else names.take(number)), pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))]
        fields = [*b.schema.names[:-1], "_len", "_terms", "_tf"]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], size.cast(pa.int32()), *lists], fields)


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NULL).to_numpy(zero_copy_only=False)


def groups_of(b: pa.RecordBatch, group: str | None) -> tuple[np.ndarray, list]:
    """(number of each row's group, the groups)."""
    if group is None:
        return np.zeros(len(b), np.int64), [None]
    coded = b.column(b.schema.get_field_index(group)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def cuts(cost: np.ndarray) -> np.ndarray:
    """Where to cut rows into runs of about ``CELLS`` in all."""
    return np.concatenate(([0], np.flatnonzero(np.diff((np.cumsum(cost) - cost) // CELLS)) + 1, [len(cost)]))


def best_documents(asked: Asked, group: str | None, k: int):  # noqa: ANN201
    """A task's best of rows (group, ``_doc``, ``_terms``, ``_impacts``), one for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, field, kind = Best(asked.queries, k), None, None
        for b in batches:
            field, kind = (b.schema.field(group) if group else None), b.schema.field("_doc").type
            number, groups = groups_of(b, group)
            lists, flat = b.column(b.num_columns - 2), b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            term, ids, n = lists.flatten().to_numpy(zero_copy_only=False), ids_of(b.column(b.num_columns - 3)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(n) - n
            for g, value in enumerate(groups):
                mine = np.flatnonzero((number == g) & (n > 0))
                times = np.concatenate(([0], np.cumsum(asked.begin[term + 1] - asked.begin[term])))
                edges = cuts(times[first[mine] + n[mine]] - times[first[mine]] + asked.queries)
                for lo, hi in zip(edges, edges[1:]):
                    docs = mine[lo:hi]
                    if not len(docs):
                        continue
                    at = spread(first[docs], n[docs])
                    place, where = asked.pairs(term[at])
                    row = np.repeat(np.arange(len(docs)), n[docs])[place]
                    best.add(value, ids[docs], summed(row, asked.query[where], flat[at][place] * asked.times[where], len(docs), asked.queries))
        yield from best.batches(field, kind)

    return run


#: Queries whose sums with some rows are worked on at once, to stay in a core's cache.
WIDE = 256


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of all rows of ``x`` and ``y``, summed up in order as ``scorers.dot`` does."""
    out = np.zeros((len(x), len(y)))
    left, right = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for at in range(0, len(y), WIDE):
        part, some = np.zeros((len(x), min(WIDE, len(y) - at))), right[:, at : at + WIDE]
        product = np.empty_like(part)
        for a, b in zip(left, some):
            np.multiply(a[:, None], b[None, :], out=product)
            part += product
        out[:, at : at + WIDE] = part
    return out


def lengths(x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for column in x.T:
        total += column * column
    return np.sqrt(total)


def best_vectors(names: list[int], queries: list[list[float]], k: int, unit: bool):  # noqa: ANN201
    """A task's best of rows (``_d``, ``_dv``) for each query but the one of the same name."""
    y, names = np.array(queries, dtype=np.float64), np.array(names, dtype=np.int64)
    size = lengths(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind, step = Best(len(y), k), None, max(1, min(1024, CELLS // len(y)))
        for b in batches:
            kind = b.column(0).type
            for at in range(0, len(b), step):
                some = b.slice(at, step)
                ids, x = ids_of(some.column(0)), some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(some), y.shape[1])
                scores = in_order(x, y)
                if unit:
                    scores /= lengths(x)[:, None] * size
                scores[ids[:, None] == names] = -np.inf
                best.add(None, ids, scores)
        yield from best.batches(None, kind)

    return run


def blocks_of(group: str | None):  # noqa: ANN201
    """Blocks of postings of rows (group, ``_bucket``, ``_doc``, ``_terms``, ``_parts``) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, doc, lists, parts = b.columns[-4:]
            number, _ = groups_of(b, group)
            where = bucket.to_numpy(zero_copy_only=False)
            turn = np.concatenate(([0], np.cumsum((np.diff(where) != 0) | (np.diff(number) != 0))))
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(b)), n)
            if not len(row):
                continue
            coded, part = lists.flatten().dictionary_encode(), parts.flatten().to_numpy(zero_copy_only=False)
            key = turn[row] * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
            of = row[order[starts]]
            postings = pa.StructArray.from_arrays([doc.take(pa.array(row[order])), pa.array(part[order])], names=["_doc", "_part"])
            columns = {} if group is None else {group: b.column(b.schema.get_field_index(group)).take(pa.array(of))}
            yield pa.RecordBatch.from_pydict({
                **columns, "_term": coded.dictionary.take(coded.indices.take(pa.array(order[starts]))), "_bucket": bucket.take(pa.array(of)), "_best": pa.array(np.maximum.reduceat(part[order], starts)),
                "_postings": pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), postings),
            })

    return run


def best_in_blocks(asked: Asked, group: str | None, k: int):  # noqa: ANN201
    """A task's best of whole buckets of blocks (group, ``_bucket``, ``_t``, ``_idf``, ``_best``, ``_postings``),
    sorted by bucket and term. A bucket is left out for a query if its bound is below the k-th best so far."""

    def whole(best: Best, b: pa.RecordBatch) -> None:
        number, groups = groups_of(b, group)
        bucket, term, idf, most, lists = (c.to_numpy(zero_copy_only=False) if i < 4 else c for i, c in enumerate(b.columns[-5:]))
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first, flat = np.cumsum(n) - n, lists.flatten()
        doc, part = ids_of(flat.field(0)), flat.field(1).to_numpy(zero_copy_only=False)
        fresh = np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(number) != 0)))
        turn, starts = np.cumsum(fresh) - 1, np.append(np.flatnonzero(fresh), len(b))
        cost = np.add.reduceat(n * (asked.begin[term + 1] - asked.begin[term]), starts[:-1])
        for g, value in enumerate(groups):
            mine = np.flatnonzero(number[starts[:-1]] == g)  # neighbours, as rows are sorted
            edges = cuts(cost[mine])
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                rows = np.arange(starts[mine[lo]], starts[mine[hi - 1] + 1])
                place, where = asked.pairs(term[rows])
                block, query, times = rows[place], asked.query[where], asked.times[where]
                cell = (turn[block] - mine[lo]) * asked.queries + query
                bound = np.bincount(cell, weights=np.maximum(idf[block], 0) * most[block] * times)
                near = bound[cell] >= best.bar(value)[query] - 1e-5  # scores are rounded, bounds sums in another order
                block, query, times = block[near], query[near], times[near]
                if not len(block):
                    continue
                at = spread(first[block], n[block])
                ids, row = np.unique(doc[at], return_inverse=True)
                products = np.repeat(idf[block], n[block]) * part[at] * np.repeat(times, n[block])
                best.add(value, ids, summed(row, np.repeat(query, n[block]), products, len(ids), asked.queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, field, kind, left = Best(asked.queries, k), None, None, []
        for b in batches:
            if not len(b):
                continue
            field, kind = (b.schema.field(group) if group else None), b.schema.field("_postings").type.value_type.field(0).type
            number, _ = groups_of(b, group)
            bucket = b.column(b.num_columns - 5).to_numpy(zero_copy_only=False)
            last = len(b) - int(np.argmax(((bucket != bucket[-1]) | (number != number[-1]))[::-1])) if (bucket != bucket[-1]).any() or (number != number[-1]).any() else 0
            held = left[0].slice(0, 1) if left else None
            same = held is not None and held.column(b.num_columns - 5)[0] == b.column(b.num_columns - 5)[0] and (group is None or held.column(0)[0] == b.column(0)[0])
            if left and not same:  # what is held back is whole
                whole(best, _one(left))
                left = []
            if last:
                whole(best, _one([*left, b.slice(0, last)]))
                left = []
            left.append(b.slice(last))
        if left:
            whole(best, _one(left))
        yield from best.batches(field, kind)

    return run


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
