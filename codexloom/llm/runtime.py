"""Session helpers: Arrow batch bounds and tables that cut lineage in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship

#: Rows and bytes in one Arrow batch handed to Python; bounds a worker's memory whatever the row size.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python functions get, by rows and by bytes, and let workers import this package.

    The bounds are the session's and stay: frames run when their results are asked for, which is after the call that made them.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a shared table that nothing reads any more."""
    with contextlib.suppress(Exception):  # a stopped session can't delete; the cluster's own cleaning does
        fs, p = _hadoop(spark, path)
        fs.delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/codexloom/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_table, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, and lost executors
    cost no recomputation of what came before. The path is kept on the frame as ``_stored_at``."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stored`."""
    drop_table(df.sparkSession, df._stored_at)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
