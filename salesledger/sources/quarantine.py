"""CSV exports with rows that cannot be read: the good rows, and a table of the others with their place in the file.

A row with more or fewer cells than the header is malformed. A cell is unreadable when it holds a text that its column's type
does not admit, or a date of a day that does not exist. Neither ends the job; what to do is the caller's decision.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger import schema as S
from salesledger.functions.dates import impossible_booking_date, impossible_sale_date
from salesledger.functions.keys import site_of_path
from salesledger.operators.normalize import normalize_sales, normalize_transactions
from salesledger.sources.intermediate import coerce_cells
from salesledger.sources.rows import FILE, PLACE, Stage, numbered

FIRST_ROW = 2
"""The header is the first row of a file."""

_TEXT = "_malformed_text"


@dataclass(frozen=True)
class Checked:
    """``rows`` are the good rows with ``file`` and ``row``; ``rejected`` the others, one row per fault.

    ``rejected`` has file, row, rule (malformed_row or unreadable_cell), the column and its value, and the row's text; with a site
    pattern also the site.
    """

    rows: DataFrame
    rejected: DataFrame


def read_text_cells(
    spark: SparkSession,
    path: str | list[str],
    stage: Stage | None = None,
    multi_line: bool = False,
    site_pattern: str | None = None,
) -> DataFrame:
    """All rows of CSV files as text cells under the header's names, with file, row and the text of malformed rows.

    Files whose header differs from the first one's are an error, as for ``read_csv``. Empty lines are no rows.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(name, T.StringType()) for name in (*header, _TEXT)])
    raw = (
        reader.schema(schema)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _TEXT)
        .option("columnPruning", False)
        .csv(path)
    )
    # Rows are counted without taking their cells apart; their headers are compared when they are read.
    counted = spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)
    rows = numbered(raw, FIRST_ROW, stage, None if multi_line else counted)
    if site_pattern:
        rows = rows.select(site_of_path(F.col(FILE), site_pattern).alias("site"), "*")
    return rows


def _malformed() -> Column:
    nothing = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("malformed_row").alias("rule"), nothing.alias("column"), nothing.alias("value")))


def _faults(columns: dict[str, Column], impossible: dict[str, Column]) -> Column:
    """Array of (rule, column, value) of a row; empty for a good one."""
    faults = [
        F.when(
            F.col(f"`{outer}`").isNotNull() & impossible[outer],
            F.struct(F.lit("unreadable_cell").alias("rule"), F.lit(outer).alias("column"), F.col(f"`{outer}`").alias("value")),
        )
        for outer in columns
    ]
    return F.when(F.col(_TEXT).isNotNull(), _malformed()).otherwise(F.array_compact(F.array(*faults)))


def _row_text(cells: DataFrame) -> Column:
    """The text of a malformed row, or the cells of another one, quoted anew."""
    own = [F.col(f"`{name}`") for name in cells.columns if name not in (*PLACE, "site", _TEXT)]
    return F.coalesce(F.col(_TEXT), F.to_csv(F.struct(*own), {"escape": '"'}))


def _with_text(faults: Column, text: Column) -> Column:
    """A row per fault, each with the row's text inside: Spark 4.1 loses a column beside the generator when it prunes."""
    return F.explode(F.transform(faults, lambda f: F.struct(f.rule.alias("rule"), f.column.alias("column"), f.value.alias("value"), text.alias("text"))))


def split(cells: DataFrame, columns: dict, impossible: dict[str, Column]) -> Checked:
    """Typed rows under internal names, and the rejected ones, from cells as ``read_text_cells`` gives them.

    ``columns`` maps a column of the file to its internal name and type; ``impossible`` has further conditions on cells.
    """
    site = [name for name in cells.columns if name == "site"]
    typed = {outer: F.col(f"`{outer}`").try_cast(kind) for outer, (_, kind) in columns.items()}
    unread = {outer: value.isNull() | impossible[outer] if outer in impossible else value.isNull() for outer, value in typed.items()}
    # Most rows are good: the list of faults is made for the others alone.
    good = F.col(_TEXT).isNull()
    for outer in columns:
        good &= F.col(f"`{outer}`").isNull() | ~unread[outer]
    rows = cells.where(good).select(*PLACE, *site, *[typed[outer].alias(inner) for outer, (inner, _) in columns.items()])
    bad = cells.where(~good).select(*site, *PLACE, _with_text(_faults(typed, unread), _row_text(cells)).alias("fault"))
    return Checked(rows, bad.select(*site, *PLACE, "fault.*"))


def check_sales(
    spark: SparkSession,
    path: str | list[str],
    stage: Stage | None = None,
    multi_line: bool = False,
    site_pattern: str | None = None,
) -> Checked:
    """Sales report, normalized, as good and rejected rows; see ``read_sales`` for the options."""
    cells = read_text_cells(spark, path, stage, multi_line, site_pattern)
    found = split(cells, S.SALES_COLUMNS, {"Datum": impossible_sale_date(F.col("Datum"))})
    return Checked(normalize_sales(found.rows), found.rejected)


def check_transactions(
    spark: SparkSession,
    path: str | list[str],
    stage: Stage | None = None,
    multi_line: bool = False,
    site_pattern: str | None = None,
) -> Checked:
    """Transaction report, normalized, as good and rejected rows."""
    cells = read_text_cells(spark, path, stage, multi_line, site_pattern)
    found = split(cells, S.TRANSACTION_COLUMNS, {"Datum": impossible_booking_date(F.col("Datum"))})
    return Checked(normalize_transactions(found.rows), found.rejected)


def check_cells(
    spark: SparkSession,
    path: str | list[str],
    stage: Stage | None = None,
    multi_line: bool = False,
    site_pattern: str | None = None,
) -> Checked:
    """Intermediate rows exported as cells, with file and row.

    A cell that cannot be read is null in ``rows``, as in ``read_cells``, and named in ``rejected``; only malformed rows are
    left out.
    """
    cells = read_text_cells(spark, path, stage, multi_line, site_pattern)
    site = [name for name in cells.columns if name == "site"]
    inner = {name: outer for outer, (name, _) in S.INTERMEDIATE_COLUMNS.items()}
    named = [F.col(f"`{outer}`").alias(name) for name, outer in inner.items()]
    texts = cells.select(*site, *PLACE, _TEXT, *named, F.struct(*named).alias("_cells"), _row_text(cells).alias("text"))
    read = coerce_cells(texts, keep=(*PLACE, _TEXT, "_cells", "text"))
    fields = [f.name for f in S.INTERMEDIATE.fields if not isinstance(f.dataType, T.StringType)] + ["time"]
    lost = [
        F.when(
            F.col(name).isNull() & (F.trim(F.col(f"_cells.{name}")) != ""),
            F.struct(F.lit("unreadable_cell").alias("rule"), F.lit(inner[name]).alias("column"), F.col(f"_cells.{name}").alias("value")),
        )
        for name in fields
    ]
    faults = F.when(F.col(_TEXT).isNotNull(), _malformed()).otherwise(F.array_compact(F.array(*lost)))
    rejected = read.select(*site, *PLACE, _with_text(faults, F.col("text")).alias("fault"))
    rows = read.where(F.col(_TEXT).isNull()).select(*site, *PLACE, *S.INTERMEDIATE.names)
    return Checked(rows, rejected.select(*site, *PLACE, "fault.*"))
