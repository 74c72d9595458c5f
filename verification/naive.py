"""Key figures the long way: a filtered aggregate and a left join per figure. A yardstick for tests and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.functions import labels
from salesledger.functions.dates import month_of
from salesledger.operators.keyfigures import FIGURES, Figure

COLUMNS = {"net": "price_net", "commission": "commission", "quantity": "quantity"}


def _one(rows: DataFrame, figure: Figure) -> DataFrame:
    kept = rows
    for name, value in (("topic", figure.topic), ("owner", figure.owner), ("payment_method", figure.method)):
        if value:
            kept = kept.where(F.col(name) == value)
    if figure.tip is not None:
        kept = kept.where((F.col("purpose") == "Tip") if figure.tip else (F.col("purpose") != "Tip"))
    if figure.meal:
        kept = kept.where(labels.MEALS[figure.meal])
    if figure.other:
        kept = kept.where(figure.other)
    total = F.sum(F.coalesce(COLUMNS[figure.measure], F.lit(0)))
    rounded = total if figure.measure == "quantity" else F.bround(total, 2).cast("decimal(18,2)")
    return kept.groupBy("date").agg(rounded.alias(figure.name))


def daily_key_figures_by_joins(rows: DataFrame, figures: list[Figure] | None = None) -> DataFrame:
    daily = rows.where("date IS NOT NULL").select("date").distinct()
    for figure in FIGURES if figures is None else figures:
        daily = daily.join(_one(rows, figure), "date", "left")
    return daily.withColumn("month", month_of(F.col("date")))
