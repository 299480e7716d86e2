"""An inverted index for BM25: blocks of postings with their greatest impact, written once.

Documents are dealt to buckets of bounded size, and a block holds a term's postings in one bucket. The
greatest impacts of a bucket's blocks bound the score of every document in it, so a query reads the
postings of those buckets alone whose bound reaches the score of its k-th best document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import rank as R
from evidentia.operators.rank import asked_terms, bm25_weights, small, top_k
from evidentia.operators.scoring import best_in_blocks, blocks_of
from evidentia.operators.tables import cut

#: Documents in a bucket, on average.
BUCKET = 256
#: Buckets whose documents are scored first, to learn how good the k-th best is at least.
SEEDS = 2


@dataclass(frozen=True)
class Index:
    """``blocks``: group, ``_term``, ``_bucket``, ``_best``, ``_postings`` (document, impact), sorted by term;
    ``weights``: group, ``_term``, ``_idf``."""

    blocks: DataFrame
    weights: DataFrame
    group: list[str]
    doc_id: str


def build(corpus: DataFrame, doc_id: str, folder: str, text: str = "text", group: str | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, bucket: int = BUCKET) -> Index:
    """Writes the index of ``corpus`` into ``folder``, which all machines share, and opens it.

    One scan of the documents. What is shuffled is a row for each document with its terms, to the task of its
    bucket, which makes the bucket's blocks; a term that all documents have is spread over the buckets. Files
    hold some buckets each, sorted by term.
    """
    g = [group] if group else []
    docs = R.bm25_documents(corpus, doc_id, text, g)
    stats = R.bm25_sizes(docs, g)
    if R.repeated(docs, g):  # those of equal length count as one
        hits = docs.select(*g, "_doc", "_len", F.explode(F.arrays_zip("_terms", "_tf")).alias("_x")).groupBy(*g, "_doc", "_len", F.col("_x._terms").alias("_term")).agg(F.sum("_x._tf").cast("int").alias("_n"))
        docs = cut(hits.groupBy(*g, "_doc", "_len").agg(F.collect_list(F.struct("_term", "_n")).alias("_x")).select(*g, "_doc", "_len", F.col("_x._term").alias("_terms"), F.col("_x._n").alias("_tf")))
    counts = docs.select(*g, F.explode("_terms").alias("_term")).groupBy(*g, "_term").agg(F.count("*").alias("_df"))
    bm25_weights(counts, stats, g, epsilon).write.parquet(f"{folder}/weights")
    sized = docs.join(small(stats), g) if g else docs.crossJoin(F.broadcast(stats))  # else one row
    parts = F.transform("_tf", lambda n: n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("_len") / F.col("_mean"))))
    dealt = sized.select(*g, F.pmod(F.xxhash64("_doc"), F.ceil(F.col("_n") / bucket)).alias("_bucket"), "_doc", "_terms", parts.alias("_parts")).repartition(*g, "_bucket").sortWithinPartitions(*g, "_bucket")
    kinds = dict(dealt.dtypes)
    schema = "".join(f"`{n}` {kinds[n]}, " for n in g) + f"_term string, _bucket bigint, _best double, _postings array<struct<_doc:{kinds['_doc']},_part:double>>"
    dealt.mapInArrow(blocks_of(group), schema).sortWithinPartitions("_term", *g, "_bucket").write.parquet(f"{folder}/blocks")
    return load(corpus.sparkSession, folder, doc_id, group)


def load(spark: SparkSession, folder: str, doc_id: str, group: str | None = None) -> Index:
    return Index(spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/weights"), [group] if group else [], doc_id)


def bounds(index: Index, wanted: DataFrame) -> DataFrame:
    """``_bound`` of every bucket for every query: no document in it scores more. Reads no postings."""
    blocks = index.blocks.select(*index.group, "_term", "_bucket", "_best").join(wanted, [*index.group, "_term"])
    most = F.sum(F.greatest(F.col("_idf"), F.lit(0.0)) * F.col("_best") * F.col("_times"))
    return blocks.groupBy(*index.group, "_query", "_bucket").agg(most.alias("_bound"))


def scores(index: Index, wanted: DataFrame, buckets: DataFrame) -> DataFrame:
    """``_query``, ``_doc`` and ``score`` of the documents in the given (query, bucket)s."""
    g = index.group
    blocks = index.blocks.join(wanted, [*g, "_term"]).join(buckets.select(*g, "_query", "_bucket"), [*g, "_query", "_bucket"])
    found = blocks.select(*g, "_query", "_idf", "_times", F.explode("_postings").alias("_p"))
    return found.groupBy(*g, "_query", F.col("_p._doc").alias("_doc")).agg(F.round(F.sum(F.col("_idf") * F.col("_p._part") * F.col("_times")), 6).alias("score"))


def search(index: Index, queries: DataFrame, query_id: str, text: str = "text", k: int = 10) -> DataFrame:
    """The rows of ``rank.bm25`` with ``k``, from the index alone: no document is read. Exact: a bucket is
    left out only if its bound is below the score of the k-th best document found so far. The blocks of up
    to ``rank.ASKED`` terms are dealt by bucket to tasks, each of which keeps its own best (ids have to be
    whole numbers); else blocks, queries and open buckets are joined."""
    g = index.group
    shared = [c for c in g if c in queries.columns]
    asked = asked_terms(queries, query_id, text, shared)
    if not shared and (kind := index.blocks.schema["_postings"].dataType.elementType["_doc"].dataType.simpleString()) in ("tinyint", "smallint", "int", "bigint") and (known := R.numbered(asked)) is not None:
        batch, terms, names = known
        number = queries.sparkSession.createDataFrame(list(enumerate(terms)), "_t int, _term string")
        wanted = index.weights.join(F.broadcast(number), "_term")  # what the terms of a batch have
        blocks = (index.blocks.where(F.col("_term").isin(terms)) if len(terms) <= TERMS else index.blocks).join(small(cut(wanted)), [*g, "_term"])
        rows = blocks.select(*g, "_bucket", "_t", "_idf", "_best", "_postings").repartition(*g, "_bucket").sortWithinPartitions(*g, "_bucket", "_t")
        found = rows.mapInArrow(best_in_blocks(batch, g[0] if g else None, k), R.found_schema(rows, g, kind))
        return R.best_of_tasks(found, names, g, query_id, index.doc_id, k)
    terms = [r._term for r in asked.select("_term").distinct().limit(TERMS + 1).collect()]
    if len(terms) <= TERMS:
        index = Index(index.blocks.where(F.col("_term").isin(terms)), index.weights.where(F.col("_term").isin(terms)), g, index.doc_id)
    wanted = small(cut(index.weights.join(small(asked), [*shared, "_term"])))
    every = cut(bounds(index, wanted))
    seeds = top_k(every, [*g, "_query"], [F.desc("_bound"), F.asc("_bucket")], SEEDS, "_place")
    best = top_k(scores(index, wanted, small(seeds)), [*g, "_query"], [F.desc("score"), F.asc("_doc")], k, "_place")
    least = best.where(F.col("_place") == k).select(*g, "_query", F.col("score").alias("_least"))
    # Scores are rounded, bounds are sums in another order: a bucket stays if it comes near.
    open_ = every.join(small(least), [*g, "_query"], "left").where(F.col("_least").isNull() | (F.col("_bound") >= F.col("_least") - 1e-5))
    found = scores(index, wanted, small(open_)).select(*g, F.col("_query").alias(query_id), F.col("_doc").alias(index.doc_id), "score")
    return top_k(found, [*g, query_id], [F.desc("score"), F.asc(index.doc_id)], k)


#: Terms of a batch of queries up to which they become a filter on the scan.
TERMS = 2000
