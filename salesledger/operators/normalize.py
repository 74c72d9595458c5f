"""Clean-up of the two exports before they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.money import zero


def normalize_sales(sales: DataFrame) -> DataFrame:
    """A missing net price is the gross price; lines that only mark a change of shift cost nothing."""
    marks_shift = F.col("description").isin(S.SHIFT_DESCRIPTIONS)
    return sales.withColumns(
        {
            "price_gross": F.when(marks_shift, zero()).otherwise(F.col("price_gross")),
            "price_net": F.when(marks_shift, zero()).otherwise(F.coalesce("price_net", "price_gross")),
        }
    )


def normalize_transactions(transactions: DataFrame) -> DataFrame:
    """A missing net amount is the full amount."""
    return transactions.withColumn("net", F.coalesce("net", "amount"))
