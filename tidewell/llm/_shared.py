"""Scratch tables that outlive executors, and Arrow batch bounds.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``.  Where that setting
is absent, a local folder is made if the master is local (tests on one machine), and else it is an error.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewell.session import fresh_folder

#: Upper bound of one Arrow batch handed to Python; long texts make short batches.
BATCH_BYTES = 16 << 20
#: Bytes of text that a numpy kernel holds expanded at a time.
CHUNK_BYTES = 1 << 20


class Scratch:
    """A folder of Parquet tables under the shared folder, one per operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh_folder(spark, name)
        self.names: set[str] = set()
        bound_batches(spark)

    def table(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """Writes ``df`` and reads it back: cuts lineage and survives lost executors."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*sorted(self.names - set(names)))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that a run of very long texts doesn't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs, which else stay until the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives the memory that a task of a Python worker has freed back to the system; workers stay, and count with their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)
