"""The intermediate table as a spreadsheet tool hands it back: every cell is text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger import schema as S
from salesledger.functions.keys import site_of, site_of_path
from salesledger.sources.till_csv import read_csv

# --- fixed values ------------------------------------------------------------------------------------
SERIAL_OF_1970 = 25569
SECONDS_PER_DAY = 86400


def coerce_cells(cells: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed intermediate table from text cells under the internal column names, with the columns of ``keep`` before.

    Dates are serial day numbers and times are parts of a day. A cell that does not parse is null, and so is a
    blank label. The label columns lose the blanks around them. A time is rounded to seconds before it is judged, so
    one that rounds to the end of the day is null.
    """
    seconds = f"round(try_cast(time AS DOUBLE) * {SECONDS_PER_DAY})"
    within = f"try_cast(time AS DOUBLE) >= 0 AND {seconds} < {SECONDS_PER_DAY}"
    seconds = f"int({seconds})"
    clock = ", ':', ".join(
        f"lpad({part}, 2, '0')"
        for part in (f"{seconds} div 3600", f"({seconds} div 60) % 60", f"{seconds} % 60")
    )
    changed = {
        "date": f"date_add(DATE '1970-01-01', try_cast(date AS INT) - {SERIAL_OF_1970})",
        "time": f"CASE WHEN {within} THEN concat({clock}) END",
        "quantity": "try_cast(quantity AS BIGINT)",
        "price_gross": "try_cast(price_gross AS DECIMAL(18, 2))",
        "price_net": "try_cast(price_net AS DECIMAL(18, 2))",
        "commission": "try_cast(commission AS DECIMAL(18, 4))",
        **{name: f"nullif(trim({name}), '')" for name in ("payment_method", "topic", "owner", "purpose")},
    }
    return cells.selectExpr(*site_of(cells), *keep, *[f"{changed.get(name, name)} AS {name}" for name in S.INTERMEDIATE.names])


def read_cells(
    spark: SparkSession, path: str | list[str], multi_line: bool = False, site_pattern: str | None = None
) -> DataFrame:
    """Intermediate rows exported as CSV cells, under the file's own column names; see ``read_csv``, and ``read_sales`` for sites."""
    raw = read_csv(spark, path, multi_line)
    cells = [F.col(f"`{name}`").alias(inner) for name, (inner, _) in S.INTERMEDIATE_COLUMNS.items()]
    site = [site_of_path(F.col("_metadata.file_path"), site_pattern).alias("site")] if site_pattern else []
    return coerce_cells(raw.select(*site, *cells))


def read_intermediate(spark: SparkSession, path: str, sites: bool = False, places: bool = False) -> DataFrame:
    """Intermediate table stored by ``write_intermediate``; a filter on ``month`` reads only those folders.

    ``sites`` says that it was stored with a site, whose folders a filter prunes as well. ``places`` adds the file and the row
    that each row came from, null where they were not stored.
    """
    schema = S.STORED_SITES if sites else S.STORED_INTERMEDIATE
    if places:
        schema = T.StructType([*S.PLACE.fields, *schema.fields])
    return spark.read.schema(schema).parquet(path)
