"""Writers. Rows are dealt to files by ranges of (month, order), so a month's files in the order of their names hold its rows in
whole order, a large month has several files and small ones share a task. Ranges come from a sample of the keys, which Spark
takes in a pass of its own; a hash of the whole row ends the key, so that rows which agree in the order can be parted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.functions.dates import month_of
from salesledger.functions.keys import site_of
from salesledger.operators.reports import named

ROW_ORDER = ["date", "time", "transaction_id", "description"]


def _by_month(df: DataFrame, path: str, order: list[str], mode: str) -> None:
    folders = [*site_of(df), "month"]
    sort = [*folders, *[F.col(f"`{name}`").asc_nulls_last() for name in order]]
    whole = F.xxhash64(*[F.col(f"`{name}`") for name in df.columns])
    ranges = df.repartitionByRange(*sort, whole)
    ranges.sortWithinPartitions(*sort).write.mode(mode).partitionBy(*folders).parquet(path)


def write_intermediate(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    _by_month(df.withColumn("month", month_of(F.col("date"))), path, ROW_ORDER, mode)


def write_report(
    report: DataFrame, path: str, names: dict[str, str], order: list[str], mode: str = "errorifexists"
) -> None:
    """Report under its own column names in ``main``."""
    columns = named(report, names)
    _by_month(columns, f"{path}/main", [names[name] for name in order], mode)


def write_closing(closing: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """At most one row per site and post, ordered by ``sort``; one file, or one folder per site."""
    if site := site_of(closing):
        closing.hint("rebalance", *site).sortWithinPartitions(*site, "sort").write.mode(mode).partitionBy(*site).parquet(path)
    else:
        closing.coalesce(1).sortWithinPartitions("sort").write.mode(mode).parquet(path)
