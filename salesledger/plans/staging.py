"""Write a table once when several reports read it, in a folder that all executors share."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Tables of one job under a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str | None = None, release: bool = False) -> None:
        """``folder`` defaults to the session's ``spark.checkpoint.dir``; there is no other fallback.

        ``release`` asks the driver to collect its garbage after each table: Spark deletes the shuffle files behind it when the
        driver no longer knows them, which else happens whenever its memory fills.
        """
        folder = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("name a staging folder that all executors share, or set spark.checkpoint.dir")
        self.spark, self.path = spark, f"{folder.rstrip('/')}/salesledger-{uuid.uuid4().hex}"
        self.count, self.release = 0, release

    def __call__(self, df: DataFrame) -> DataFrame:
        """Store ``df`` and read it back: later readers get pruned columns and pushed filters, not its lineage."""
        path = f"{self.path}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
        if self.release:
            del df
            gc.collect()  # Python's side of what the driver knows; its thread tells the driver every tenth of a second
            time.sleep(0.5)
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(schema).parquet(path)

    def clear(self) -> None:
        """Delete the job's folder."""
        java = self.spark.sparkContext._jvm
        path = java.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def staging(spark: SparkSession, folder: str | None = None) -> Iterator[Staging]:
    """Staging that ends with the block. What is read from it later, such as a returned table, must not be."""
    stage = Staging(spark, folder)
    try:
        yield stage
    finally:
        stage.clear()
