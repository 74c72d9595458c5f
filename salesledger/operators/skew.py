"""Joins that stay even when one key holds a large part of all rows.

``hot_keys`` finds heavy keys with a frequent-items sketch: one column is read, nothing but sketches is shuffled.
``spread_join`` then gives every row of a heavy key, and every row without a key, a salt taken from the input
partition it came from, and repeats the heavy keys of the other side once per salt. The salt only decides where
rows meet, so the result is the one of the plain join, whichever keys are named heavy. It depends on the
partition number alone, not on row order or a random number, so a task that runs again writes the same rows to
the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1024
"""A key is heavy when it holds more than 1/SHARE of the rows of a lane, see ``hot_keys``."""

MIN_ROWS = 10_000
"""A key with fewer rows is no burden for one task, at any size of the table."""

ROWS_PER_SALT = 1_000
"""Rows of a heavy key that share a salt: a key is repeated as often as its own rows ask for."""

LANES = 64
_TRACKED = 8 * SHARE

HASHED = "key_hash"
"""Column of heavy keys that consist of several columns: the sketch counts their hash."""


def _listed(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _item(keys: list[str]) -> Column:
    """What the sketch counts: the key, or the hash of its columns; two keys of one hash share salts, no more."""
    if len(keys) == 1:
        return F.col(keys[0])
    missing = " OR ".join(f"{k} IS NULL" for k in keys)
    return F.when(F.expr(missing), None).otherwise(F.xxhash64(*keys))


def _item_name(keys: list[str]) -> str:
    return keys[0] if len(keys) == 1 else HASHED


def hot_keys(df: DataFrame, key: str | Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Heavy values of ``key`` with their number of rows as seen by the sketch.

    The input partitions are dealt to ``LANES`` lanes and each lane names the keys that hold more than 1/SHARE of its
    rows. A key with more than 1/SHARE of all rows exceeds that in at least one lane, so none is missed, and
    the table has fewer than LANES * SHARE rows whatever the input. Keys with few rows are left out. Of a key of several
    columns the table has the hash, as ``key_hash``.
    """
    keys = _listed(key)
    lanes = df.select(_item(keys).alias("item"), (F.spark_partition_id() % LANES).alias("lane"))
    tops = lanes.groupBy("lane").agg(
        F.expr(f"approx_top_k(item, {SHARE}, {_TRACKED})").alias("top"), F.count(F.lit(1)).alias("rows")
    )
    items = tops.select("rows", F.explode("top").alias("top"))
    heavy = items.where(F.col("top.item").isNotNull() & (F.col("top.count") * SHARE > F.col("rows")))
    counted = heavy.groupBy(F.col("top.item").alias(_item_name(keys))).agg(F.sum("top.count").alias("rows"))
    return counted.where(F.col("rows") >= min_rows)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    how: str,
    hot: DataFrame | None = None,
    null_safe: bool = False,
    hashed: bool = False,
) -> DataFrame:
    """Join on ``key`` with the rows of heavy keys on the left spread over several partitions.

    ``how`` is inner, left, left_semi or left_anti. ``hot`` is a table of heavy keys, with their ``rows`` if known;
    without it they are looked up in ``left``. Each heavy key gets one salt per ROWS_PER_SALT of its rows, and the right
    side is repeated once per salt. With ``null_safe`` a missing key equals a missing key. Keys below the thresholds of
    ``hot_keys`` are left to adaptive execution, which should be on. With ``hashed`` the rows on the right are hashed by partition
    instead of sorting both sides; it is for a right side with few rows per key, so that a partition of it fits in a task.
    """
    keys = _listed(key)
    name = _item_name(keys)
    if hot is None:
        # Fewer than LANES * SHARE short rows by construction, so every task can hold them.
        marks = F.broadcast(hot_keys(left, key))
    else:
        # A caller's table may have any size: Spark measures it and shuffles beyond its threshold.
        rows = F.col("rows") if "rows" in hot.columns else F.lit(MIN_ROWS)
        marks = hot.groupBy(name).agg(F.max(rows).alias("rows"))
    marks = marks.selectExpr(f"{name} AS _hot", f"int(greatest(2, ceil(rows / {ROWS_PER_SALT}))) AS _salts")

    # Rows without a key meet at most one row, so any number of salts serves them.
    partitions = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = f"({' OR '.join(f'{k} IS NULL' for k in keys)})"
    spread_left = left.join(marks, _item(keys) == F.col("_hot"), "left").selectExpr(
        *[f"`{c}`" for c in left.columns],
        f"""CASE WHEN _hot IS NOT NULL THEN spark_partition_id() % _salts
                 WHEN {missing} THEN spark_partition_id() % {partitions} ELSE 0 END AS _salt""",
    )
    spread_right = right.join(marks, _item(keys) == F.col("_hot"), "left").selectExpr(
        *[f"`{c}` AS _key{keys.index(c)}" if c in keys else f"`{c}`" for c in right.columns],
        f"""explode(CASE WHEN _hot IS NOT NULL THEN sequence(0, _salts - 1)
                    WHEN {missing} THEN sequence(0, {partitions - 1}) ELSE array(0) END) AS _salt_r""",
    )
    if not null_safe:
        spread_right = spread_right.where(" AND ".join(f"_key{i} IS NOT NULL" for i in range(len(keys))))
    if hashed:
        spread_right = spread_right.hint("shuffle_hash")
    same = "<=>" if null_safe else "="
    equal = " AND ".join(f"{k} {same} _key{i}" for i, k in enumerate(keys))
    joined = spread_left.join(spread_right, F.expr(f"{equal} AND _salt = _salt_r"), how)
    return joined.drop("_salt", "_salt_r", *[f"_key{i}" for i in range(len(keys))])
