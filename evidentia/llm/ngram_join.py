"""N-gram Jaccard join: which documents share most of their word shingles.

A grouped prefix join. Of each document's set, only the shingles lowest in hash order are looked up:
as many as make sure that two linked documents have several of them in common. Those that no other
document has are dropped; a document with too few left can have no link. The rest are ordered by
document frequency, and documents of equal size and equal rest form one group. A prefix of the rest,
short by the number that links must have in common, brings groups together: two groups are a pair if
a prefix shingle is common to both, their sizes are alike, and they have as many looked-up shingles in
common as a link needs, so that a passage that many documents share makes no pairs by itself. Pairs are
found in block pairs and kept as a forest; the groups that it connects are expanded to their members,
whose whole sets are verified in block pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.blocks import block_pairs
from evidentia.llm.common import as_bytes, cut, mix64, over_batches, shingles, table, word_hashes
from evidentia.llm.components import components
from evidentia.operators.substrings import key_map, slots

#: Members in one block of a cluster, and shingles of a member above which it counts as several.
BLOCK, LARGE = 512, 1000
#: One in so many shingles of a set is looked up beyond those that its links may lack: the fewer, the less
#: is shuffled, and the more pairs of groups pass that are no links.
SPARE = 5


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    return [np.unique(shingles(words[at[i] : at[i + 1]], size)) for i in range(len(texts))]


def class_key(s: np.ndarray) -> int:
    """Equal sets have equal keys: 64 bits of a digest of the whole set."""
    return int.from_bytes(hashlib.md5(s.tobytes()).digest()[:8], "little", signed=True)


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any that it links to, at least."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """Looked-up shingles that two linked sets have in common, at least, if the smaller has ``n``."""
    return n // SPARE + 1


def looked_up(n: int, percent: int) -> int:
    """How many of the lowest shingles of a set of ``n`` are looked up. At most ``n - least_common`` of
    them are not in the other set, so at least ``spare`` are."""
    return min(n, n - least_common(n, percent) + spare(n))


def jaccard(percent: int) -> Callable[[int, int, np.ndarray], np.ndarray]:
    """Which sets of the given sizes link with one that they have so many shingles in common with."""
    return lambda one, others, common: 100 * common >= percent * (one + others - common)


def may_link(percent: int) -> Callable[[int, int, np.ndarray], np.ndarray]:
    """Which sets of the given sizes may link with one, by the looked-up shingles that they have in common."""

    def enough(one: int, others: np.ndarray, common: np.ndarray) -> np.ndarray:
        low, high = np.minimum(one, others), np.maximum(one, others)
        return (common >= low // SPARE + 1) & (100 * low >= percent * high)

    return enough


class Holders:
    """Which of some sets hold each of their elements."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        _, self.token = np.unique(joined, return_inverse=True)
        self.holder = np.repeat(np.arange(self.n), lengths)[np.argsort(self.token, kind="stable")]
        self.edge = np.concatenate(([0], np.cumsum(np.bincount(self.token))))
        self.begin = np.concatenate(([0], np.cumsum(lengths)))

    def common(self, i: int) -> np.ndarray | None:
        """How many elements each set has in common with set i; None if no other has any."""
        mine = self.token[self.begin[i] : self.begin[i + 1]]
        counts = self.edge[mine + 1] - self.edge[mine]
        mine, counts = mine[counts > 1], counts[counts > 1]
        if not len(mine):
            return None
        at = np.repeat(self.edge[mine] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        return np.bincount(self.holder[at], minlength=self.n)


def pairs_in(sets: list[np.ndarray], first: int | None, enough: Callable, sizes: np.ndarray, before: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those after i that have ``enough`` in common with set i), exact: for the sets before ``first`` with
    those from there on, or for all with all if it is None. With ``before``, only pairs count that have
    nothing in common there."""
    of, earlier = Holders(sets), None if before is None else Holders(before)
    for i in range(len(sets) if first is None else first):
        common = of.common(i)
        if common is None:
            continue
        low = i + 1 if first is None else first
        some = (common[low:] > 0) & enough(sizes[i], sizes[low:], common[low:])
        if earlier is not None and (shared := earlier.common(i)) is not None:
            some &= shared[low:] == 0
        if some.any():
            yield i, np.flatnonzero(some) + low


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart until now."""
        a, b = self.root(x), self.root(y)
        self.parent[a] = b
        return a != b


def links_in(sets: list[np.ndarray], first: int | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the sets."""
    forest, sizes = Forest(len(sets)), np.array([len(s) for s in sets], dtype=np.int64)
    return [(i, j) for i, others in pairs_in(sets, first, jaccard(percent), sizes) for j in others.tolist() if forest.join(i, j)]


def paired(shared: list[np.ndarray], before: list[np.ndarray], sizes: np.ndarray, first: int | None, percent: int) -> list[tuple[int, int]]:
    """The groups that are in a pair, with the number of one of those that pairs connect them with.
    Groups with anything in common ``before`` are no pair here."""
    forest, found = Forest(len(shared)), set()
    for i, others in pairs_in(shared, first, may_link(percent), sizes, before):
        some = others.tolist()
        found.update((i, *some))
        for j in some:
            forest.join(i, j)
    return [(i, forest.root(i)) for i in sorted(found)]


def apart(sets: list[np.ndarray], key: np.ndarray) -> list[np.ndarray]:
    """The sets with elements that differ from those of sets of another key: one look at all is then as good
    as one for each key."""
    return [s.astype(np.uint64, copy=False) ^ k for s, k in zip((s.view(np.uint64) if s.dtype == np.int64 else s for s in sets), mix64(key.view(np.uint64)))]


def in_units(members: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """``members`` in block pairs of units: a large key is a unit of its own, small ones are put together at
    random, so that a task has about ``BLOCK`` members in either case. ``counts`` has the keys to take
    and their ``n``."""
    small = F.col("n") <= BLOCK // 4
    total = counts.agg(F.sum(F.when(small, F.col("n")))).first()[0] or 0
    unit = F.when(small, F.pmod(F.xxhash64(key), F.lit(max(1, total // BLOCK)))).otherwise(F.xxhash64(key, F.lit(1)))
    of = cut(counts.select(key, "n", unit.alias("unit")))
    return block_pairs(members.join(of.select(key, "unit"), key), "unit", of.groupBy("unit").agg(F.sum("n").alias("n")), BLOCK, F.xxhash64("id"))


def jaccard_components(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id as ``id``, ``n_shingles`` (size of its set) and ``component_id``,
    the least id that it reaches by links, its own included.

    A set holds the distinct ``size``-word shingles of the text, A-Z in lower case, words parted by
    space and the bytes 9 to 13; fewer words count as one shingle; null texts and texts without words
    have empty sets, which link with nothing. Two rows link when
    ``100 * intersection >= percent * union``. Rows with equal sets are one class and cost one member
    however many they are. Repeated ids are rows of their own. An empty table gives no rows.

    Nothing is written per pair: shuffles carry a fixed part of each set's shingles; tasks that filter
    or verify hold two blocks of groups or members, and return groups or a forest. Groups that prefix shingles connect
    are filtered all at once, or shingle by shingle and size by size where that makes fewer pairs.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50, up to 100")
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def keyed(batch: pa.RecordBatch) -> dict[str, list]:
        sets = sets_of(as_bytes(batch.column(1)), size)
        return {"id": batch.column(0).to_pylist(), "c": [class_key(s) for s in sets], "n_shingles": [len(s) for s in sets]}

    keys = cut(over_batches(rows, keyed, f"id {kind}, c bigint, n_shingles bigint"))

    def lowest(batch: pa.RecordBatch) -> dict[str, list]:
        sets = [s for s in sets_of(as_bytes(batch.column(0)), size) if len(s)]
        return {"c": [class_key(s) for s in sets], "n": [len(s) for s in sets], "low": [s[: looked_up(len(s), percent)].view(np.int64).tobytes() for s in sets]}

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
        times = [len(x) for x in low]
        c, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), times) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n.astype(np.int32), pa.int32()), pa.array(np.concatenate(low), pa.int64())], names=["c", "n", "token"])

    one_each = over_batches(texts, lowest, "c bigint, n int, low binary").dropDuplicates(["c"])
    tokens = over_batches(one_each, spread, "c bigint, n int, token bigint")
    # Document frequency of looked-up shingles; counts are summed before the shuffle.
    frequent = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    found = tokens.join(frequent, "token")
    common = F.floor(F.ceil(F.col("n") * percent / 100) / SPARE).cast("int") + 1
    per_set = found.groupBy("c").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    kept = per_set.withColumn("keep", F.size("shared") - common + 1).where("keep > 0").select("c", "n", F.col("shared.token").alias("shared"), "keep")
    in_group = cut(kept.withColumn("g", F.xxhash64("n", "shared")))

    # Groups of equal size and looked-up shingles. Groups that any prefix shingle connects are a pool; sizes
    # go in steps of the ratio, so that like sizes are in the same step or the next.
    groups = cut(in_group.groupBy("g").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.first("keep").alias("keep")))
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent) if percent < 100 else 1e-6)).cast("bigint")
    posts = cut(groups.select("g", step.alias("step"), F.explode(F.slice("shared", F.lit(1), F.col("keep"))).alias("token")))
    hubs = posts.groupBy("token", "step").agg(F.min("g").alias("hub"))
    to_hub = posts.join(hubs, ["token", "step"]).select(F.col("g").alias("a"), F.col("hub").alias("b"))
    ladder = hubs.select("token", "step", F.col("hub").alias("a")).join(hubs.select("token", (F.col("step") - 1).alias("step"), F.col("hub").alias("b")), ["token", "step"]).select("a", "b")
    pools = cut(components(to_hub.unionByName(ladder)))

    # What is filtered together: a pool, or the groups of a prefix shingle and of like size, whichever makes
    # fewer pairs to look at. A pool that a few passages hold together has short lists; copies share most
    # shingles, and each of them lists nearly the whole pool.
    lists = posts.join(pools.withColumnRenamed("node", "g"), "g").select("root", "g", "token", F.explode(F.array("step", F.col("step") - 1)).alias("step"))
    listed = lists.groupBy("root", "token", "step").agg(F.count("*").cast("double").alias("n")).groupBy("root").agg(F.sum(F.col("n") * F.col("n")).alias("in_lists"))
    plan = pools.groupBy("root").agg(F.count("*").cast("double").alias("n")).join(listed, "root").select("root", ((F.col("n") > BLOCK) & (F.col("in_lists") < F.col("n") * F.col("n"))).alias("by_token"))
    plan = cut(plan)
    whole_pools = pools.withColumnRenamed("node", "g").join(plan.where("not by_token"), "root").select(F.col("root").alias("key"), F.lit(0).cast("bigint").alias("token"), F.lit(False).alias("listed"), "g")
    by_token = lists.join(plan.where("by_token").select("root"), "root").select(F.xxhash64("token", "step").alias("key"), "token", F.lit(True).alias("listed"), "g")
    keyed_groups = cut(whole_pools.unionByName(by_token))
    per_key = keyed_groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    to_filter = in_units(keyed_groups.join(groups.select(F.col("g"), F.col("g").alias("id"), F.col("n").alias("size"), "shared"), "g"), "key", per_key)

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        pdf = pdf.sort_values(["mine", "key", "g"]) if bi != bj else pdf.sort_values(["key", "g"])
        shared, key = list(pdf["shared"]), pdf["key"].to_numpy(np.int64)
        # A pair has to be found at the first shingle that is common to both prefixes, and there alone.
        before = [s[: int(np.argmax(s == t))] if one else s[:0] for s, t, one in zip(shared, pdf["token"], pdf["listed"])]
        found = paired(apart(shared, key), apart(before, key), pdf["size"].to_numpy(np.int64), int((pdf["mine"] == bi).sum()) if bi != bj else None, percent)
        g = pdf["g"].to_numpy()
        return pd.DataFrame({"unit": pdf["unit"].iloc[0], "bi": bi, "bj": bj, "root": [g[r] for _, r in found], "g": [g[i] for i, _ in found]})

    in_pairs = cut(to_filter.groupBy("unit", "bi", "bj").applyInPandas(filtered, "unit bigint, bi int, bj int, root bigint, g bigint"))
    # A group in no pair still has its members to compare.
    alone = in_group.join(in_pairs.select("g"), "g", "left_anti").select("c", "n", F.col("g").alias("cluster"))
    members = cut(in_group.join(in_pairs.select("g", F.xxhash64("unit", "bi", "bj", "root").alias("cluster")), "g").select("c", "n", "cluster").unionByName(alone))
    weight = F.greatest(F.count("*"), F.ceil(F.sum("n") / LARGE))
    counts = members.groupBy("cluster").agg(F.count("*").alias("members"), weight.alias("n")).where("members > 1").drop("members")
    members = members.select("c", "cluster")

    wanted = cut(members.join(counts.select("cluster"), "cluster", "left_semi"))
    # A map of fixed size tells nearly all texts that no cluster wants, before they are shuffled.
    there = df.sparkSession.sparkContext.broadcast(key_map(wanted, "c"))

    def named(batch: pa.RecordBatch) -> dict[str, list]:
        keys = np.array([class_key(s) for s in sets_of(as_bytes(batch.column(0)), size)], dtype=np.int64)
        some = np.flatnonzero(there.value[slots(keys.view(np.uint64))])
        return {"c": keys[some].tolist(), "text": batch.column(0).take(pa.array(some)).to_pylist()}

    whole = over_batches(texts, named, "c bigint, text string").join(wanted, "c").dropDuplicates(["c", "cluster"])
    tasks = in_units(whole.withColumn("id", F.col("c")), "cluster", counts)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        pdf = pdf.sort_values(["mine", "cluster", "c"]) if bi != bj else pdf.sort_values(["cluster", "c"])
        sets = apart(sets_of([t.encode("utf-8", "surrogatepass") for t in pdf["text"]], size), pdf["cluster"].to_numpy(np.int64))
        found = links_in(sets, int((pdf["mine"] == bi).sum()) if bi != bj else None, percent)
        c = pdf["c"].to_numpy()
        return pd.DataFrame({"a": [c[i] for i, _ in found], "b": [c[j] for _, j in found]}, dtype="int64")

    edges = tasks.groupBy("unit", "bi", "bj").applyInPandas(verify, "a bigint, b bigint")
    roots = components(edges).withColumnRenamed("node", "c")
    in_root = keys.where("n_shingles > 0").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = in_root.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = in_root.join(least, "root").select("id", "n_shingles", "component_id")
    return linked.unionByName(keys.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose 4-word shingles agree to 85 per cent."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85).withColumnRenamed("id", "doc_id")


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}

ORACLE = {
    "op2_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
each as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from each a join each b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select a as start, b as node from pairs union select r.start, p.b from reach r join pairs p on r.node = p.a),
least_of as (select start, min(node) as m from reach group by start)
select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from sets left join least_of on start = doc_id"""
}
