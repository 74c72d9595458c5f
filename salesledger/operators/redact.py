"""Manual changes to the intermediate table between preparing and exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.keys import site_of

EDITABLE = ["topic", "owner", "purpose", "comment"]
KEYS = ("transaction_id", "description")


def duplicate_overrides(overrides: DataFrame, on: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys that are named more than once, with their number of rows; each would repeat the rows it edits."""
    return overrides.groupBy(*site_of(overrides), *on).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def apply_overrides(intermediate: DataFrame, overrides: DataFrame, on: tuple[str, ...] = KEYS) -> DataFrame:
    """Replace topic, owner, purpose and comment of the rows named in ``overrides``.

    With a site in both tables it belongs to the key; overrides without one count for all sites.
    ``overrides`` holds the key columns and the four editable columns, one row per key, which
    ``duplicate_overrides`` checks. Spark broadcasts it while
    its measured size is below its threshold; beyond it both sides are shuffled and AQE splits heavy keys.
    """
    if "site" in overrides.columns:
        on = (*site_of(intermediate, overrides), *on)
    edits = overrides.select(*on, F.struct(*EDITABLE).alias("edit"))
    edited = intermediate.join(edits, list(on), "left")
    change = {
        name: F.when(F.col("edit").isNotNull(), F.col(f"edit.{name}")).otherwise(F.col(name)) for name in EDITABLE
    }
    return edited.withColumns(change).select(*site_of(intermediate), *S.INTERMEDIATE.names)


def add_rows(intermediate: DataFrame, extra: DataFrame) -> DataFrame:
    """Add artificial rows, such as cash sales that were never keyed in. They stand in no file, so their place is null."""
    site = site_of(intermediate, extra)
    return intermediate.unionByName(extra.select(*site, *S.INTERMEDIATE.names), allowMissingColumns=True)
