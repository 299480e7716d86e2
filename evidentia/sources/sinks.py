"""Writers. Jobs commit as a whole, so a failed one leaves no half-written table behind."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def json_document(df: DataFrame, path: str, wrapped: bool = False, limit: int = 1_000_000) -> None:
    """One JSON array, or an object with it as ``data``: for results that a person reads, since it makes
    a single row of the table. Tables of more than ``limit`` rows are refused; write those as lines."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows for one JSON document")
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias("data"))
    text = F.to_json(F.struct("data") if wrapped else F.col("data"), {"pretty": "true", "ignoreNullFields": "false"})
    rows.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").csv(path)


def csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Quoted values with a header, written as they are."""
    writer = df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("encoding", encoding).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def embeddings(df: DataFrame, path: str, key: str = "claim_id") -> None:
    """Vectors by claim; a reader that filters on the claim reads its folder only."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def store(df: DataFrame, path: str, append: bool = True) -> None:
    """(url, lines) rows of the knowledge store by claim."""
    df.write.mode("append" if append else "overwrite").partitionBy("claim_id").parquet(path)


def run_log(name: str, path: str | None = None) -> logging.Logger:
    """A driver log for a run: console, and a file if asked."""
    log = logging.getLogger(f"evidentia.{name}")
    log.setLevel(logging.INFO)
    if not log.handlers:
        for h in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            h.setFormatter(logging.Formatter("%(asctime)s %(name)s %(message)s"))
            log.addHandler(h)
    return log
