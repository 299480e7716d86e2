"""The corpus pipeline: documents through five operators, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import checkpoint_folder, table
from evidentia.llm.decontamination import find_leaks
from evidentia.llm.ngram_join import jaccard_components
from evidentia.llm.quality import filter_documents, train
from evidentia.llm.secrets import redact
from evidentia.llm.sentencepieces import encode_and_check


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds low in quality or toxic; null and empty texts stay."""
    return filter_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of id and text, as ids may be null or repeated, under a name that no column has."""
    name = "key"
    while name in docs.columns:
        name = f"_{name}"
    text = F.when(F.col("text").isNull(), F.lit("-")).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    return docs.withColumn(name, F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text)), name


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one document stays: the one with
    the least id, a null id last; of rows with one id, the least by text; of rows with one id and text,
    the least by its other columns as JSON, of whatever type they are."""
    keyed, key = _keyed(docs)
    groups = jaccard_components(keyed, size=5, percent=80, id_col=key).select(F.col("id").alias(key), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key))
    first = keyed.select("doc_id", key).distinct().join(groups, key).groupBy("component_id").agg(F.min_by(F.col(key), order).alias(key)).select(key)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.to_json(F.struct(*rest)) if rest else F.lit("")
    return keyed.join(first, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*docs.columns), least).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keyed, key = _keyed(docs)
    leaked = find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(F.col("id").alias(key)).distinct()
    return keyed.join(leaked, key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; ``n_chars`` follows the text. All documents stay."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids with the end id, n_tokens and exact: whether the ids decode to the text."""
    return encode_and_check(docs, _vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The classifier, the join's components, the search and the encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
