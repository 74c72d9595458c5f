"""Where a row stands in its file, found without sorting or numbering all rows in one task.

Rows of one stretch of a file that a task reads follow each other. Their numbers inside the stretch come from the order of
reading, the rows before the stretch from the sums of the stretches before it: one row per stretch, not per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

FILE, ROW = "file", "row"
PLACE = [FILE, ROW]


def placed(raw: DataFrame) -> DataFrame:
    """Rows as a file source reads them, with the path of the file, the start of the stretch and the order of reading.

    To be called on the reader's result before any filter.
    """
    return raw.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        "*",
    )


def numbered(raw: DataFrame, first: int = 1, stage: Stage | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Rows of a file source with ``file`` and ``row``, their number in the file from ``first`` on.

    ``stage`` stores what was read; without it the files are read twice, in the same order as long as they and the session's
    settings stay the same. Files that grow or change meanwhile need it. ``counted`` reads the same rows for the first of the two
    times, which needs their number only.
    """
    rows = placed(raw)
    rows = stage(rows) if stage else rows
    seen = rows if stage or counted is None else placed(counted)
    stretches = seen.groupBy(FILE, "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per stretch of a file.
    before = stretches.selectExpr(
        FILE, "_block", f"{first} + sum(_n) OVER (PARTITION BY {FILE} ORDER BY _block) - _n - _first AS _shift"
    )
    # Their number is that of the stretches the reader plans, so every task can hold them and no row of the files is shuffled.
    met = rows.join(F.broadcast(before), [FILE, "_block"]).withColumn(ROW, F.col("_at") + F.col("_shift"))
    return met.select(*PLACE, *[F.col(f"`{name}`") for name in raw.columns])
