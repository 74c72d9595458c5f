"""The two monthly CSV exports of the till, for any number of months at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.keys import site_of_path
from salesledger.operators.normalize import normalize_sales, normalize_transactions


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """Rows of CSV files with a header, as text, with quotes doubled inside quoted cells.

    A row with more or fewer cells than the header is an error, whichever columns are asked for. A file whose header
    differs from the first one's is an error as well: read such months on their own. Cells with line breaks need
    ``multi_line``, which reads a file in one task; without it they are an error.
    """
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .option("multiLine", multi_line)
        .csv(path)
    )


def _typed(raw: DataFrame, columns: dict, file_name: bool, site_pattern: str | None) -> DataFrame:
    """Columns by header name, so an export with more columns or another order reads the same."""
    named = [F.col(f"`{outer}`").cast(kind).alias(inner) for outer, (inner, kind) in columns.items()]
    if site_pattern:
        named.insert(0, site_of_path(F.col("_metadata.file_path"), site_pattern).alias("site"))
    return raw.select(*named, *[F.col("_metadata.file_name").alias("file_name")] * file_name)


def read_sales(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    file_name: bool = False,
    site_pattern: str | None = None,
) -> DataFrame:
    """Sales report, normalized; with ``file_name`` as a further column if asked.

    With ``site_pattern`` the files of several sites are read at once: its first group in a file's path is the ``site`` of
    the file's rows, such as ``/site=([^/]+)/``. A path that it doesn't match is an error.
    """
    return normalize_sales(_typed(read_csv(spark, path, multi_line), S.SALES_COLUMNS, file_name, site_pattern))


def read_transactions(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = False,
    file_name: bool = False,
    site_pattern: str | None = None,
) -> DataFrame:
    """Transaction report, normalized; see ``read_sales``."""
    raw = read_csv(spark, path, multi_line)
    return normalize_transactions(_typed(raw, S.TRANSACTION_COLUMNS, file_name, site_pattern))
