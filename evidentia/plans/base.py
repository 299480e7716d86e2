"""What the query modules share: registration, tables, and fixtures derived from the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.tables import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with DuckDB SQL for the same rows."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


#: Bytes of files from which on a table that comes in few pieces is dealt to all cores.
LARGE = 4 << 20


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if its files make fewer tasks than there are cores and are not small, its rows are dealt
    out. Tables of many files or row groups are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= LARGE and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as claims."""
    return t(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))


def stored(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the knowledge store: document n belongs to claim n modulo the number of claims."""
    n = t(spark, d, "benchmark").agg(F.count("*").alias("_n"))
    return t(spark, d, "documents").crossJoin(F.broadcast(n)).select((F.col("doc_id") % F.col("_n")).alias("claim_id"), "doc_id", "text", "lang", "source")


#: DuckDB counterparts of the shared expressions.
TOKENS = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
STORED = "(select doc_id % (select count(*) from benchmark) as claim_id, doc_id, text, lang, source from documents)"
JACCARD = "(case when len(list_distinct(list_concat({0}, {1}))) > 0 then len(list_intersect({0}, {1}))::double / len(list_distinct(list_concat({0}, {1}))) else 0 end)"


def tok(x: str) -> str:
    return TOKENS.format(x)


def jac(a: str, b: str) -> str:
    return JACCARD.format(a, b)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
