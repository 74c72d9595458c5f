"""Tables written in the middle of an operator, in the folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
"""Folders made for sessions in one process, by application."""


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a session in one process gets a folder of its own;
    the session's settings stay as they are."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="llm-")
    return _own[application]


def staged(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` and read it back: its lineage ends, readers get pruned columns, a lost executor costs nothing.

    ``release`` asks the driver to collect its garbage afterwards: Spark deletes the shuffle files behind ``df`` when the driver
    no longer knows them, which else happens whenever its memory fills.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if release:
        gc.collect()  # Python's side of what the driver knows; its thread tells the driver every tenth of a second
        time.sleep(0.5)
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)
