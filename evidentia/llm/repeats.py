"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else too.

Only the groups of equal suffixes to the depth ``length`` matter, not the whole order. Suffixes are
dealt to tasks by anchors: a window of ``length`` bytes always holds the place whose short string has
the least hash in it, and equal windows hold it at the same offset. A task orders the suffixes that
start at its anchors by depth-limited radix passes over their bytes, most significant digit first,
eight bytes a digit; suffixes that are alone leave, and buckets of a few are told apart by comparing
them. What lies before the anchors is ordered likewise,
read backwards. The common lengths of neighbours in both orders give those of all pairs, so that a
repeated window is one whose bytes before and after the anchor agree: judged on bytes, not on hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.blocks import spread as spread_blocks
from evidentia.llm.common import as_bytes, cut, mix64, over_batches, shingles, table, word_hashes

#: Bytes of an anchor string, at most; contexts in one task; members in one block of a hot anchor; pairs
#: of contexts compared at once; contexts up to which an anchor's are compared without being ordered, and
#: from which on they are not compared in pairs.
ANCHOR, TASK, BLOCK, PAIRS, FEW, MANY = 64, 8192, 4096, 1 << 16, 32, 768

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.random.Generator(np.random.PCG64(400)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Fingerprints:
    """Fingerprints of any part of some bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        steps = np.full(n + 1, _ROOT)
        steps[0] = 1
        self.power = np.cumprod(steps)
        steps[1:] = _BACK
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * np.cumprod(steps)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.power[start])

    def all_of(self, k: int, mixed: bool = True) -> np.ndarray:
        out = self.sums[k:] - self.sums[:-k]
        out *= self.power[:-k]
        return mix64(out) if mixed else out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, by running minima of blocks from either side."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, np.ndarray, Fingerprints | None]:
    """(places, fingerprints of the ``k`` bytes there): every window of ``length`` bytes holds one, chosen
    by nothing but the window's bytes."""
    w = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    prints = Fingerprints(np.frombuffer(data, np.uint8))
    grams = prints.all_of(k)
    at = chosen(grams, w)
    return at, grams[at], prints


def chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of which every ``w`` neighbours hold one: those with the least hash of some such run."""
    ends = np.full(w - 1, 0, np.uint64)
    greatest = ~sliding_min(~np.concatenate((ends, sliding_min(hashes, w), ends)), w)
    return np.flatnonzero(hashes == greatest)


#: Bounds of 64-bit numbers with 1 to 8 bytes.
_BYTES = np.array([1 << (8 * k) for k in range(1, 8)], dtype=np.uint64)


def radix_order(digits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their digits within their group, groups in turn; for each but the first,
    how many bytes it has in common with the one before it, 0 if that is of another group).

    A row of ``digits`` holds a suffix, eight bytes a digit. One pass a digit, most significant first,
    over the rows that are not yet alone."""
    order = np.argsort(group, kind="stable")
    bucket = group[order]
    common = np.zeros(len(order), dtype=np.int16)
    live = np.arange(len(order))
    for d in range(digits.shape[1] + 1):
        b = bucket[live]
        edge = np.concatenate(([True], b[1:] != b[:-1])) if len(b) else np.zeros(0, bool)
        crowd = np.diff(np.append(np.flatnonzero(edge), len(b))) > 1
        some = np.repeat(crowd, np.diff(np.append(np.flatnonzero(edge), len(b))))
        live, b, edge = live[some], b[some], edge[some]
        if not len(live):
            break
        common[live[~edge]] = 8 * d
        if d == digits.shape[1]:
            break
        digit = digits[order[live], d]
        by = np.lexsort((digit, b))
        order[live], digit = order[live][by], digit[by]
        apart = np.flatnonzero(~edge[1:] & (digit[1:] != digit[:-1])) + 1
        common[live[apart]] = 8 * d + 7 - np.searchsorted(_BYTES, digit[apart] ^ digit[apart - 1], side="right")
        edge[apart] = True
        bucket[live] = live[edge][np.cumsum(edge) - 1]
        # From here on a bucket is named by its first place; places differ, so buckets do.
    return order, common


def _all_pairs(common: np.ndarray) -> np.ndarray:
    """For groups by members in order, what members i and j have in common: the least of the common
    bytes of neighbours between them. ``common`` holds each member's with the one before."""
    g, m = common.shape
    out = np.zeros((g, m, m), dtype=np.int16)
    for i in range(m - 1):
        out[:, i, i + 1 :] = out[:, i + 1 :, i] = np.minimum.accumulate(common[:, i + 1 :], axis=1)
    return out


def _digits(parts: list[bytes], depth: int) -> np.ndarray:
    width = -(-depth // 8) * 8
    return np.frombuffer(b"".join([x.ljust(width, b"\0") for x in parts]), dtype=">u8").reshape(len(parts), -1).astype(np.uint64)


def _compared(digits: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For groups by members, how many bytes each two have in common, digit by digit."""
    g, m = member.shape
    out = np.zeros((g, m, m), dtype=np.int16)
    own = digits[member]
    for i in range(m - 1):
        apart = own[:, i + 1 :] ^ own[:, i : i + 1]
        first = (apart != 0).argmax(axis=2)
        x = np.take_along_axis(apart, first[:, :, None], axis=2)[:, :, 0]
        common = np.where(x == 0, 8 * digits.shape[1], 8 * first + 7 - np.searchsorted(_BYTES, x, side="right"))
        out[:, i, i + 1 :] = out[:, i + 1 :, i] = common
    return out


def _ordered(digits: np.ndarray, member: np.ndarray) -> np.ndarray:
    """The same for larger groups, by ordering their suffixes."""
    g, m = member.shape
    order, common = radix_order(digits[member.ravel()], np.repeat(np.arange(g), m))
    place = np.empty(g * m, dtype=np.int64)
    place[order] = np.arange(g * m)
    at = place.reshape(g, m) - np.arange(g)[:, None] * m
    return _all_pairs(common.reshape(g, m))[np.arange(g)[:, None, None], at[:, :, None], at[:, None, :]]


def _without_pairs(right: np.ndarray, left: np.ndarray, after: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the members of one group, by digits of what lies after and before their anchors: (whether a window
    of ``length`` bytes is repeated, the most bytes before the anchor and after it that such windows reach).

    A window that starts ``d`` bytes before the anchor is repeated if another member has the same ``d``
    bytes before it and the same ``length - d`` after it. Both orders name these classes for any ``d``, so a
    window takes a sort of members and no pair is looked at. The furthest windows start or end where two
    members part or one of them ends, so that no others are tried; from either end, only classes with
    members whose furthest window is still open."""
    m, members = len(after), np.zeros(len(after), dtype=np.int64)
    (by_right, right), (by_left, left) = radix_order(right, members), radix_order(left, members)
    best_right, best_left = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for best, by, common, ends in ((best_right, by_right, right, after), (best_left, by_left, left, before)):
        best[by] = np.maximum(common, np.append(common[1:], 0))
        np.minimum(best, ends, out=best)
    reach = [np.full(m, -1), np.full(m, -1)]
    a, b = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for got, steps in zip(reach, (np.unique(np.append(left, before))[::-1], np.unique(np.append(right, after))[::-1])):
        for x in steps.tolist():
            behind, ahead = (x, max(length - x, 0)) if got is reach[0] else (max(length - x, 0), x)
            some = np.flatnonzero((best_right >= ahead) & (best_left >= behind))
            open_ = got[some] < 0
            if not open_.any():
                continue
            a[by_right] = np.cumsum(right < ahead)
            mine = a[some]
            wanted = np.zeros(m + 1, dtype=bool)
            wanted[mine[open_]] = True
            some = some[wanted[mine]]
            b[by_left] = np.cumsum(left < behind)
            key = a[some] * (m + 1) + b[some]
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            hit = some[order[np.append(same, False) | np.append(False, same)]]
            got[hit[got[hit] < 0]] = x
    return reach[0] >= 0, reach[0], reach[1]


def repeated(contexts: list[bytes], key: np.ndarray, offset: np.ndarray, lengths: tuple[int, ...], left: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the lengths: (index of a context, first byte, last byte and one) of what repeated
    windows of that length cover in contexts.

    A context holds an anchor of fingerprint ``key`` at ``offset``; its windows start 0 to ``left``
    bytes before that. Contexts are compared with those of the same key.
    """
    found = [[] for _ in lengths]
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0))) if len(order) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(order)))
    before = np.minimum(offset, left).astype(np.int16)
    after = (np.array([len(c) for c in contexts], dtype=np.int64) - offset).astype(np.int16)
    ahead = _digits([c[o:] for c, o in zip(contexts, offset.tolist())], int(after.max(initial=1)))
    back = _digits([c[:o][::-1] for c, o in zip(contexts, offset.tolist())], int(before.max(initial=1)))
    for m in np.unique(count[count > 1]).tolist():
        groups = edge[count == m]
        if m > MANY:
            for g in groups.tolist():
                member = order[g : g + m]
                for out, length in zip(found, lengths):
                    some, lefts, right = _without_pairs(ahead[member], back[member], after[member], before[member], length)
                    out.append((member[some], (offset[member] - lefts)[some], (offset[member] + right)[some]))
            continue
        step = max(1, PAIRS // (m * m))
        # A few suffixes are told apart by comparison, as where radix passes come down to small buckets.
        common = _compared if m <= FEW else _ordered
        for g in range(0, len(groups), step):
            member = order[groups[g : g + step, None] + np.arange(m)]  # groups by members
            right, lefts = common(ahead, member), common(back, member)
            # Suffixes were filled up with zero bytes: no two have more in common than the shorter one has.
            right = np.minimum(right, np.minimum(after[member][:, :, None], after[member][:, None, :]))
            lefts = np.minimum(lefts, np.minimum(before[member][:, :, None], before[member][:, None, :]))
            itself = np.arange(m)
            right[:, itself, itself] = lefts[:, itself, itself] = 0
            both = right + lefts
            for out, length in zip(found, lengths):
                hit = both >= length
                some = hit.any(axis=2)
                if some.any():
                    of = member[some]
                    # Windows around one anchor overlap, so that what they cover is one run.
                    out.append((of, offset[of] - np.where(hit, lefts, 0).max(axis=2)[some], offset[of] + np.where(hit, right, 0).max(axis=2)[some]))
    none = (np.zeros(0, np.int64),) * 3
    return [tuple(np.concatenate(x) for x in zip(*out)) if out else none for out in found]


def text_key(data: bytes) -> bytes:
    return hashlib.md5(data).digest()


def covered(df: DataFrame, lengths: tuple[int, ...] = (400,), text_col: str = "text") -> DataFrame:
    """Columns ``c`` (digest of a distinct text's bytes) and ``spans0``, ``spans1``, ...: for each of the
    lengths, the text's covered runs as an array of (first, last and one) in byte order, empty if none;
    for the texts that have any, judged among distinct texts.

    A string of ``length`` bytes counts if it starts at another place too, in the same text or another
    one; overlapping places count, and matches never cross texts. Null counts as empty. Contexts that
    agree in the 64-bit fingerprints of their anchor and of themselves count as equal; all else is
    compared by bytes.
    """
    least, most = min(lengths), max(lengths)
    if least < 2 or most > 4095:
        raise ValueError("strings have 2 to 4095 bytes")
    k = min(ANCHOR, max(1, least // 2))
    left = most - k
    texts = df.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= least)

    def found(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"c": [], "marks": []}
        for data in as_bytes(batch.column(0)):
            at, gram, prints = anchors(data, least, k)
            lo, hi = np.maximum(0, at - left), np.minimum(len(data), at + most)
            around = mix64(prints.of(lo, hi) * _ROOT + (at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64))
            out["c"].append(text_key(data))
            out["marks"].append(np.stack((gram.view(np.int64), around.view(np.int64), at << 12 | hi - at)).tobytes())
        return out

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [np.frombuffer(x, np.int64).reshape(3, -1) for x in batch.column(1).to_pylist()]
        times = np.repeat(np.arange(len(marks)), [m.shape[1] for m in marks])
        h, x, at = np.concatenate(marks, axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(times)), pa.array(h), pa.array(x), pa.array((at >> 12).astype(np.int32)), pa.array((at & 4095).astype(np.int32))], names=["c", "h", "x", "at", "ahead"])

    once = cut(over_batches(texts, found, "c binary, marks binary").dropDuplicates(["c"]))
    marks = over_batches(once, spread, "c binary, h bigint, x bigint, at int, ahead int")
    # Written, so that the join reads plain tables on either side and Spark may split a hot anchor's rows.
    twice = cut(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    marks = cut(marks.join(twice, "h"), instead_of=once)

    # Equal contexts cover all of each other. One of each kind then stands for it.
    kinds = cut(marks.groupBy("h", "x").agg(F.count("*").alias("n"), F.min(F.struct("c", "at")).alias("one")))
    first, last = F.greatest(F.lit(0), F.col("at") - left), F.col("at") + F.col("ahead")
    whole = marks.join(kinds.where("n > 1").select("h", "x"), ["h", "x"]).select("c", first.alias("first"), last.alias("last"))
    whole = cut(_runs(whole.select("c", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate(lengths)])).alias("_l"), "first", "last").where(F.col("last") - F.col("first") >= F.col("_l.n")).select("c", "_l.k", "first", "last"), len(lengths)), instead_of=marks)
    open_groups = cut(kinds.groupBy("h").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1").select("h", "n"))
    n_tasks = max(1, -(-(open_groups.agg(F.sum("n")).first()[0] or 0) // TASK))
    asked = kinds.select("h", "one").join(open_groups, "h").select("h", "n", "one.c", "one.at").groupBy("c").agg(F.collect_list(F.struct("h", "at", "n")).alias("asked"))
    asked = cut(asked, instead_of=kinds)

    def keyed(batch: pa.RecordBatch) -> dict[str, list]:
        return {"c": [text_key(x) for x in as_bytes(batch.column(0))], "text": batch.column(0).to_pylist()}

    def around(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"h": [], "n": [], "c": [], "lo": [], "offset": [], "context": []}
        for c, data, places in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            for p in places:
                lo = max(0, p["at"] - left)
                for name, v in zip(out, (p["h"], p["n"], c, lo, p["at"] - lo, data[lo : p["at"] + most])):
                    out[name].append(v)
        return out

    distinct = over_batches(texts, keyed, "c binary, text string")
    contexts = over_batches(distinct.join(asked, "c").dropDuplicates(["c"]).select("c", "text", "asked"), around, "h bigint, n bigint, c binary, lo int, offset int, context binary")
    tasks = spread_blocks(contexts, "n", BLOCK, F.xxhash64("c", "lo"))

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, c = pdf["lo"].to_numpy(), pdf["c"].to_numpy()
        out = []
        for k, (of, first, last) in enumerate(repeated(list(pdf["context"]), pdf["h"].to_numpy(), pdf["offset"].to_numpy().astype(np.int64), lengths, left)):
            out.append(pd.DataFrame({"c": c[of], "k": k, "first": (lo[of] + first).astype(np.int32), "last": (lo[of] + last).astype(np.int32)}))
        return pd.concat(out)

    judged = tasks.withColumn("task", F.pmod("h", F.lit(n_tasks))).groupBy("task", "bi", "bj").applyInPandas(judge, "c binary, k int, first int, last int")
    for k in range(len(lengths)):
        judged = judged.unionByName(whole.select("c", F.lit(k).alias("k"), F.inline(f"spans{k}")))
    return _runs(judged, len(lengths))


def _runs(rows: DataFrame, kinds: int) -> DataFrame:
    """Rows of (c, k, first, last) as the merged runs of each kind by ``c``."""
    runs = rows.groupBy("c").agg(F.collect_list(F.struct("k", "first", "last")).alias("runs"))
    return runs.select("c", *[merge_runs("runs", k).alias(f"spans{k}") for k in range(kinds)])


def merge_runs(column: str, k: int):  # noqa: ANN201
    """The runs of kind ``k`` in order, those that meet or overlap made one."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def merge(runs: pd.Series) -> pd.Series:
        def one(all_runs) -> list[dict]:  # noqa: ANN001
            out: list[list[int]] = []
            for first, last in sorted((p["first"], p["last"]) for p in all_runs if p["k"] == k):
                if out and first <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], last)
                else:
                    out.append([first, last])
            return [{"first": a, "last": b} for a, b in out]

        return runs.map(one)

    return merge(F.col(column))


def most_words(data: bytes, runs: list[tuple[int, int]]) -> int:
    """The most whole words that one of the runs of bytes holds; words are parted by white space."""
    most = 0
    for a, b in runs:
        part = data[a:b].split()
        cut_first = a > 0 and not data[a - 1 : a].isspace() and not data[a : a + 1].isspace()
        cut_last = b < len(data) and not data[b - 1 : b].isspace() and not data[b : b + 1].isspace()
        most = max(most, len(part) - cut_first - (cut_last and len(part) > cut_first))
    return most


def with_repeated_words(df: DataFrame, words: int = 50, slack: int = 5, text_col: str = "text") -> DataFrame:
    """Column ``c``, the digests of texts that hold a run of words which occurs at another place too, in
    the same text or another row: every run of ``words`` words is noticed, none of ``words - slack`` or
    fewer. Words are parted by white space, A-Z in lower case. Null and short texts have no such run.

    Of the runs of ``words - slack`` words and one, those with the least hash among ``slack`` neighbours
    stand for all; hashes have 64 bits and are counted, not compared by their words."""
    size = words - slack + 1

    def found(batch: pa.RecordBatch) -> dict[str, list]:
        texts = as_bytes(batch.column(0))
        hashes, at = word_hashes(texts)
        out: dict[str, list] = {"c": [], "runs": []}
        for i, t in enumerate(texts):
            own = hashes[at[i] : at[i + 1]]
            if len(own) >= words:
                runs = shingles(own, size)
                out["c"].append(text_key(t))
                out["runs"].append(runs[chosen(runs, slack)].tobytes())
        return out

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        runs = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        owner = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.concatenate(runs))], names=["c", "h"])

    texts = df.select(F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") >= 2 * words - 1)
    blobs = cut(over_batches(texts, found, "c binary, runs binary"))
    marks = over_batches(blobs, spread, "c binary, h bigint")
    twice = cut(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    return cut(marks.join(twice, "h").select("c").distinct(), instead_of=blobs)


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None, words: int | None = None) -> DataFrame:
    """One row per input row: the id as ``id``, ``n_bytes``, ``spans`` (covered runs, null if none),
    ``kept``, the bytes that stay, null if all do, and ``passage_words``: with a ``passage``, a shorter
    length, the most whole words in a run that repeated strings of that length cover, else 0; and
    ``repeats``: with ``words``, whether the text holds a run of so many words that occurs elsewhere, by
    ``with_repeated_words``, else false.

    Rows of equal text cover each other whole if they have ``length`` bytes, and stand for one text
    otherwise. Null and shorter texts keep all; ids may be null or repeated; very long texts are handled
    whole, a row at a time; an empty table gives no rows. Nothing is written per pair: a hot anchor's
    contexts are compared in block pairs, and tasks return runs.
    """
    kind = df.schema[id_col].dataType.simpleString()
    lengths = (length,) if passage is None else (length, passage)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def keyed(batch: pa.RecordBatch) -> dict[str, list]:
        return {"id": batch.column(0).to_pylist(), "c": [text_key(x) for x in as_bytes(batch.column(1))], "text": batch.column(1).to_pylist()}

    rows = over_batches(rows, keyed, f"id {kind}, c binary, text string").withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    copies = rows.groupBy("c").agg(F.count("*").alias("n")).where("n > 1")
    flagged = None if words is None else with_repeated_words(df, words, text_col=text_col)
    known = covered(df, lengths, text_col).join(copies, "c", "full")
    known = cut(known.withColumn("repeats", F.lit(False)) if flagged is None else known.join(flagged.withColumn("repeats", F.lit(True)), "c", "full"))
    marked = rows.join(known, "c", "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_bytes").cast("int").alias("last")))
    for k, n in enumerate(lengths):
        full = (F.col("n") > 1) & (F.col("n_bytes") >= n)
        marked = marked.withColumn(f"spans{k}", F.when(full, whole).when(F.size(f"spans{k}") > 0, F.col(f"spans{k}")))

    @F.pandas_udf("binary")
    def left_over(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str, runs) -> bytes | None:  # noqa: ANN001
            data, out, at = t.encode("utf-8", "surrogatepass"), [], 0
            for r in runs:
                out.append(data[at : r["first"]])
                at = r["last"]
            return b"".join([*out, data[at:]])

        return pd.Series([one(t, r) for t, r in zip(text, spans)])

    @F.pandas_udf("int")
    def most(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([most_words(t.encode("utf-8", "surrogatepass"), [(r["first"], r["last"]) for r in runs]) for t, runs in zip(text, spans)], dtype="int32")

    # Null spans come as empty arrays to the functions, whose results are then not used.
    given = lambda k: F.coalesce(f"spans{k}", F.expr("cast(array() as array<struct<first:int,last:int>>)"))
    seen = F.lit(0) if passage is None else F.when(F.col("spans1").isNotNull(), most(F.when(F.col("spans1").isNotNull(), F.col("text")).otherwise(""), given(1))).otherwise(0)
    kept = F.when(F.col("spans0").isNotNull(), left_over(F.when(F.col("spans0").isNotNull(), F.col("text")).otherwise(""), given(0)))
    return marked.select("id", "n_bytes", F.col("spans0").alias("spans"), "text", kept.alias("kept"), seen.alias("passage_words"), F.coalesce("repeats", F.lit(False)).alias("repeats"))


#: Words of a passage that ``repeats`` tells of.
WORDS = 50


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``remove_repeats`` of every document at 400 bytes: doc_id, n_bytes, n_removed, n_spans, kept_sha256.
    Further, ``repeats``: whether the document holds a run of 50 words that occurs elsewhere too, as
    those are often too short to be removed."""
    got = remove_repeats(table(spark, sf_dir, "documents"), words=WORDS)
    kept = F.coalesce("kept", F.col("text").cast("binary"))
    return got.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length(kept)).cast("bigint").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("bigint").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
        "repeats",
    )


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
