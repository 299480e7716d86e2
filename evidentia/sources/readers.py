"""Readers for the evidence formats. Schemas are explicit, so nothing is read twice to infer one."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evidentia.functions.text import html_lines
from evidentia.operators.rank import ordinal
from evidentia.sources import schemas


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv_latin1(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def search_tsv(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Search logs; lines that do not parse are kept in ``_bad`` instead of stopping the read."""
    schema = schemas.SEARCH_LOG + ", _bad STRING"
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)


def tsv_union(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """All files of a folder with a name prefix, headers dropped, blank lines skipped, with ``file``, the
    file's name."""
    got = spark.read.schema(schemas.SEARCH_LOG).option("sep", "\t").option("header", True).csv(f"{folder}/{prefix}*")
    return got.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(F.col("link").isNotNull() | F.col("claim").isNotNull())


def store(spark: SparkSession, path: str) -> DataFrame:
    """The knowledge store, partitioned by claim: a filter on ``claim_id`` prunes to its folder."""
    return spark.read.parquet(path)


def text_folder(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """Whole text files (``file``, ``text``) with their ``position`` by name, from ``first`` up to ``last``."""
    files = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    placed = ordinal(files, [F.asc("file")], "position").where(F.col("position") >= first)
    return placed if last is None else placed.where(F.col("position") < last)


def instruction_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"data": [{prompt, output}]}`` as rows."""
    return json_document(spark, path, f"data ARRAY<STRUCT<{schemas.INSTRUCTION}>>").select(F.inline("data"))


def hub(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A dataset from elsewhere, already a DataFrame: the columns that the builders use."""
    return frame.select(*columns)


def take(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows that come."""
    return df.limit(n)


def search(queries: DataFrame, results: DataFrame, by: str, date: str, until: str, order: str, page: int = 0, size: int = 10) -> DataFrame:
    """Result pages of a search: of each query's results dated up to its ``until``, in ``order``, those on
    the given page, with their 1-based ``position``. A table of results stands for the network; queries
    without results have no rows."""
    dated = queries.join(results, by).where(F.col(date) <= F.col(until))
    placed = dated.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return placed.where((F.col("position") > page * size) & (F.col("position") <= (page + 1) * size))


def paired_csv(spark: SparkSession, path: str, source: str = "input", target: str = "target") -> DataFrame:
    return spark.read.option("header", True).csv(path).select(F.col(source).alias("input"), F.col(target).alias("target"))


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\[((?:[^\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|(T\*|Td|TD|BT)", re.S)
_STRING = re.compile(rb"\((?:[^()\\]|\\.)*\)", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def simple_pdf_text(data: bytes) -> str:
    """The text that a PDF's page streams show as literal strings, plain or deflated, a line for each
    move of the pen. Fonts with an encoding of their own and text in images are beyond it."""
    out: list[str] = []
    for m in _STREAM.finditer(data):
        stream = m[1]
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        for s in _SHOWN.finditer(stream) if b"BT" in stream else ():
            if s[3]:
                out.append("\n")
                continue
            for part in _STRING.findall(s[1] if s[1] is not None else s[2]):
                plain = _ESCAPED.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else _NAMED.get(e[1], e[1]), part[1:-1])
                out.append(plain.decode("latin-1"))
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def pdf_texts(spark: SparkSession, path: str, to_text: Callable[[bytes], str] = simple_pdf_text, files: str = "*.pdf") -> DataFrame:
    """Files of a folder as (``url``, ``text``) by a function from bytes to text; null where it fails."""

    def one(data: bytes) -> str | None:
        try:
            return to_text(bytes(data))
        except Exception:  # noqa: BLE001  a damaged file has no text
            return None

    convert = F.pandas_udf(lambda s: s.map(one), "string")
    return spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select(F.col("path").alias("url"), convert("content").alias("text"))


def page_lines(urls: DataFrame, pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Addresses with the text lines of their page; those without a page have none. The pages table
    stands for the network: a page that could not be fetched is null or absent."""
    return urls.join(pages.select(url, html), url, "left").withColumn("lines", html_lines(F.col(html))).drop(html)


def store_lines(stored: DataFrame, text_col: str = "url2text") -> DataFrame:
    """Non-empty pages, their lines as rows and their text joined by spaces."""
    full = stored.where(F.size(text_col) > 0)
    return full.withColumn("page_text", F.array_join(text_col, " ")).select("*", F.posexplode(text_col).alias("line_idx", "line"))
