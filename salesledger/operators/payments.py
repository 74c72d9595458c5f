"""What the transaction report adds to the sales lines: shift changes, fees and tips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import dates
from salesledger.functions.keys import site_of
from salesledger.functions.money import zero
from salesledger.operators.skew import spread_join

TIP_HEADER = ["sold_at", "kind", "transaction_id", "payment", "category", "sku", "currency", "account"]


def shift_changes(transactions: DataFrame, order_by: Column | None = None) -> DataFrame:
    """Last change of shift of each weekday between noon and four o'clock.

    Last means the latest time, or the last by ``order_by`` when the report has a row order to respect, such as its
    ``row`` in a file.
    """
    booked = F.col("booked_at")
    found = (
        transactions.where(F.col("description").contains(S.SHIFT_CHANGE))
        .withColumns({"date": dates.booking_date(booked), "time": dates.booking_time(booked)})
        .where((F.col("time") > dates.SHIFT_EARLIEST) & (F.col("time") < dates.SHIFT_LATEST))
        .where(~dates.is_weekend(F.col("date")))
    )
    last = F.max("time") if order_by is None else F.max_by(F.col("time"), order_by)
    return found.groupBy(*site_of(transactions), "date").agg(last.alias("shift_change"))


def unreadable_times(transactions: DataFrame) -> DataFrame:
    """Rows whose booking text has the form of a time of day that does not exist, such as 25:00:00."""
    booked = F.col("booked_at")
    looks_like_time = booked.rlike(r".{11}\d\d:\d\d:\d\d")
    return transactions.where(looks_like_time & dates.booking_time(booked).isNull())


def _completed() -> Column:
    return (F.col("kind") == S.REVENUE_KIND) & (F.col("status") == S.STATUS_DONE)


def commission_base(transactions: DataFrame) -> DataFrame:
    """Total, fee, tip and time of the completed revenue transactions."""
    return transactions.where(_completed()).select(
        *site_of(transactions),
        "transaction_id",
        F.col("amount").alias("commissioned_total"),
        "fee",
        F.coalesce("tip", zero()).alias("tip"),
        dates.booking_time(F.col("booked_at")).alias("time"),
    )


def tip_lines(
    sales: DataFrame, base: DataFrame, grain: str = "line", hot: DataFrame | None = None
) -> DataFrame:
    """One sales line per tip, in the shape of the sales report.

    With the grain "line" tips are distinct over all columns, so a transaction with lines in two categories gets two
    tip lines. With the grain "transaction" it gets one. ``base`` is the output of ``commission_base``.
    """
    if grain not in ("line", "transaction"):
        raise ValueError(f"unknown grain: {grain}")
    site = site_of(sales, base)
    keys = [*site, "transaction_id"]
    headers = sales.where(F.col("transaction_id").isNotNull()).select(*site, *TIP_HEADER)
    tips = base.where(F.col("tip") > 0).select(*keys, "tip").distinct()
    # Most transactions have no tip: theirs go before anything is made distinct.
    tipped = spread_join(headers, tips, keys, "inner", hot, hashed=True)
    if grain == "line":
        tipped = tipped.distinct()
    else:
        rest = [c for c in TIP_HEADER if c != "transaction_id"]
        first = F.min(F.struct(*rest)).alias("first")
        tipped = tipped.groupBy(*keys, "tip").agg(first).select(*keys, "first.*", "tip")
    return tipped.select(
        *site,
        "sold_at",
        "kind",
        "transaction_id",
        "payment",
        F.lit(1).cast("bigint").alias("quantity"),
        F.lit(S.TIP_DESCRIPTION).alias("description"),
        "category",
        "sku",
        "currency",
        F.col("tip").alias("list_price"),
        zero().alias("discount"),
        F.col("tip").alias("price_gross"),
        F.col("tip").alias("price_net"),
        zero().alias("tax"),
        F.lit(None).cast("string").alias("tax_rate"),
        "account",
    )
