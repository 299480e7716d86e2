"""Tables written on the way: to cut lineage where rows must not be made twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set here only where the session has none and runs
    on one machine (tests). On a cluster without one this fails: its machines share no other folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("the session names no spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="evidentia-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


#: Spark removes the shuffle files of a query that is over where this is on.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared checkpoint folder and reads it from there, so that later
    uses neither recompute it nor depend on one executor. The shuffle files that went into it go, and so
    does ``instead_of``, an earlier table of ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    folder, before = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.select("*").write.parquet(folder)
    finally:
        spark.conf.set(_CLEAN, before)
    if instead_of is not None:
        for f in {x.rsplit("/", 1)[0] for x in instead_of.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return spark.read.schema(df.schema).parquet(folder)
