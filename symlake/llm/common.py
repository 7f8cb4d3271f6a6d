"""What the training-data operators share: the shared work folder, tables, Arrow batch bounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the session names none, and bounds Arrow batches.

    The folder is the one in ``spark.checkpoint.dir``, which all executors of a cluster
    share. Only where that is unset and the master is local (tests, one machine) a temporary
    one is made; on a cluster that is an error.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not shared and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="symlake-checkpoints-"))
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(key, str(bound))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder, so a lost executor costs no recomputation.

    Spark removes the files when the frame is no longer referenced.
    """
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared checkpoint folder and read back: lineage ends as with cut(), but columns are compressed and read one by one.

    The table goes when the driver's Python ends. Columns that hold nothing but nulls without a type can't be written: then it is cut().
    """
    spark = df.sparkSession
    prepare(spark)
    if '"void"' in df.schema.json():
        return cut(df)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet"))


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df, of short rows, with a broadcast hint if it has at most so many rows (df should be checkpointed); else joins are left to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

