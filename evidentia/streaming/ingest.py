"""Incremental ingest of pages: an extension beside the batch engine's append with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evidentia.functions.text import html_lines


def pages_to_store(spark: SparkSession, source: str, schema: StructType | str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new page files and appends (url, lines) to the store, each url once: a micro-batch drops what
    the store has already. Started again, it goes on after the last batch that was committed."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.where("url is not null").dropDuplicates(["url"]).select("url", html_lines(F.col("html")).alias("lines"))
        jvm = spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = rows.join(spark.read.schema("url string, lines array<string>").parquet(target).select("url"), "url", "left_anti")
        rows.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and type; works on streams, where rows later than ``late`` are dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
