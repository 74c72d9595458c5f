"""Tables of a job appear together: they are written beside the target and moved in when all are complete.

A run writes to a folder of its own. One rename of that folder decides that the run counts; moving its tables in can be done
again, so a job that ends before the rename leaves the target as it was, and one that ends after it is completed by the
next publication of the same target, or by ``settle``. Renaming is one step on HDFS and local disks; object stores need a
committer that offers it.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

WHOLE, MONTHS = "overwrite", "months"
MODES = ("errorifexists", WHOLE, MONTHS)
MONTH_FOLDER = "month="


class Folders:
    """The few operations on folders that publishing needs, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def move(self, source: str, target: str) -> None:
        to = self._path(target)
        self._fs.mkdirs(to.getParent())
        if not self._fs.rename(self._path(source), to):
            raise OSError(f"cannot move {source} to {target}")

    def months(self, path: str, below: str = "") -> Iterator[str]:
        """Folders of months under ``path``, relative to it: as many as tables have sites and months, not files."""
        for entry in self._fs.listStatus(self._path(f"{path}/{below}")):
            if entry.isDirectory():
                name = entry.getPath().getName()
                inner = f"{below}/{name}" if below else name
                if name.startswith(MONTH_FOLDER):
                    yield inner
                else:
                    yield from self.months(path, inner)


def _ready(target: str, mode: str) -> str:
    return f"{target}_ready_{mode}"


def _table_and_month(folder: str) -> tuple[str, str]:
    """``mittagstisch/main/site=a/month=202303`` as its table and what the run replaces of it."""
    parts = folder.split("/")
    at = next(i for i, part in enumerate(parts) if "=" in part)
    return "/".join(parts[:at]), "/".join(parts[at:])


def _empty_months(folders: Folders, run: str, target: str) -> None:
    """Empty folders in the run for months that it has, but no longer in every table: they replace the old rows too."""
    made = {_table_and_month(folder) for folder in folders.months(run)}
    months = {month for _, month in made}
    for table, month in {_table_and_month(folder) for folder in folders.months(target)} - made:
        if month in months:
            folders.make(f"{run}/{table}/{month}" if table else f"{run}/{month}")


def settle(spark: SparkSession, target: str) -> None:
    """Complete a publication that ended after its run was decided on; without one nothing happens."""
    target = target.rstrip("/")
    folders = Folders(spark, target)
    if folders.exists(ready := _ready(target, WHOLE)):
        folders.delete(target)
        folders.move(ready, target)
    if folders.exists(ready := _ready(target, MONTHS)):
        for month in list(folders.months(ready)):
            folders.delete(f"{target}/{month}")
            folders.move(f"{ready}/{month}", f"{target}/{month}")
        folders.delete(ready)


@contextlib.contextmanager
def publication(spark: SparkSession, target: str, mode: str = "errorifexists") -> Iterator[str]:
    """A folder to write tables to, which take their places under ``target`` when the block ends without an error.

    ``errorifexists`` stops before any work if the target exists, ``overwrite`` replaces the whole target, and ``months``
    replaces the months that the run has, by site where there are sites, and leaves all others. One job at a time may
    publish to a target.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    target = target.rstrip("/")
    folders = Folders(spark, target)
    settle(spark, target)
    if mode == "errorifexists" and folders.exists(target):
        raise FileExistsError(f"{target} exists; mode overwrite replaces it, mode months the months of this run")
    run = f"{target}_run_{uuid.uuid4().hex}"
    try:
        yield run
        if mode == MONTHS and folders.exists(target):
            _empty_months(folders, run, target)
        folders.move(run, _ready(target, MONTHS if mode == MONTHS else WHOLE))
    except BaseException:
        folders.delete(run)
        raise
    settle(spark, target)
