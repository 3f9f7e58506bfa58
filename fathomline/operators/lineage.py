"""Cutting lineage: a frame written to the folder that driver and executors share, and read again from there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own switch for dropping a query's shuffles when it ends: nothing reads them once its table is written.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a writer of these tables holds.
ROW_GROUP = 32 << 20


def shared_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names in spark.checkpoint.dir. Where it names none and none was set, a
    temporary folder serves a local session, and any other session is refused: its executors could not read it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"fathomline-{os.getpid()}"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for tables that are written to be read by others."""
    shared_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there, so that lost executors cost nothing before it.

    A table rather than a checkpoint: its size is known to the planner, where that of a checkpoint is guessed from the plan
    before, by products that grow without bound over the rounds of an iteration; and columns that aren't used aren't read."""
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what `cut` wrote for frames that nothing reads any more: all that was made of them has been cut itself."""
    for df in frames:
        path = getattr(df, "_written", None) if df is not None else None
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
