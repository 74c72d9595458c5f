"""From the two exports of the till to the labelled intermediate table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import dates, labels
from salesledger.functions.keys import site_of
from salesledger.functions.money import share_of_fee, zero
from salesledger.functions.text import strip
from salesledger.operators.normalize import normalize_sales
from salesledger.operators.payments import commission_base, shift_changes, tip_lines
from salesledger.operators.reconcile import refunded_ids
from salesledger.operators.skew import hot_keys, spread_join

LINE = [
    "account",
    "sold_at",
    "kind",
    "transaction_id",
    "payment",
    "quantity",
    "description",
    "category",
    "currency",
    "price_gross",
    "price_net",
]

USED = [*LINE, "sku"]
"""Columns of the sales report that reach the intermediate table; the others stay behind."""


def transaction_facts(sales: DataFrame, transactions: DataFrame) -> DataFrame:
    """What the lines need to know about a transaction: fee base, tip and time, or that it was refunded.

    One row per completed booking, and one per refunded transaction without any, with ``refunded`` telling them apart. A
    refund without an id has a row without an id.
    """
    keys = [*site_of(sales, transactions), "transaction_id"]
    base = commission_base(transactions).where(F.col("transaction_id").isNotNull())
    refunded = refunded_ids(sales).withColumn("refunded", F.lit(True))
    both = base.join(refunded, keys, "full_outer")
    return both.withColumn("refunded", F.coalesce("refunded", F.lit(False)))


def valid_shift_changes(transactions: DataFrame, facts: DataFrame, in_row_order: bool = False) -> DataFrame:
    """Shift changes outside refunded transactions. Only the few shift lines meet the refunds.

    A day's last change is the latest, or with ``in_row_order`` the last row of the last file.
    """
    marks = transactions.where(F.col("description").contains(S.SHIFT_CHANGE))
    keys = [*site_of(transactions, facts), "transaction_id"]
    ids = facts.where("refunded").select(*[F.col(name).alias(f"refund_{name}") for name in keys])
    same = [F.col(name).eqNullSafe(F.col(f"refund_{name}")) for name in keys]
    kept = marks.join(ids, same, "left_anti")
    return shift_changes(kept, F.struct(*S.PLACE.names) if in_row_order else None)


def label_lines(lines: DataFrame) -> DataFrame:
    """Add type, payment method, topic, owner and purpose to lines that carry time, weekend and shift change."""
    return lines.selectExpr(
        "*",
        f"{labels.PAYMENT_METHOD} AS payment_method",
        f"{labels.RECORD_TYPE} AS type",
        f"{labels.PURPOSE} AS purpose",
        f"{labels.TOPIC} AS topic",
    ).selectExpr("*", f"{labels.OWNER} AS owner")


def prepare(
    sales: DataFrame,
    transactions: DataFrame,
    hot: DataFrame | None = None,
    tip_grain: str = "line",
    facts: DataFrame | None = None,
    stage: Callable[[DataFrame], DataFrame] | None = None,
    in_row_order: bool = False,
) -> DataFrame:
    """Intermediate table: one row per sales line and tip, without refunded transactions.

    ``hot`` names transactions that hold a large part of all lines; without it they are looked up in ``sales``.
    ``facts`` is a stored ``transaction_facts`` of the two reports. ``stage`` stores a table and reads it back: with it the reports
    are computed once, and what is not given of ``hot`` and ``facts`` once each, instead of once per use. Where both reports
    have a site, so has the result, and transaction numbers and shift changes are a site's own. ``in_row_order`` takes the last
    change of shift by ``file`` and ``row`` of the transactions instead of by time.
    """
    site = site_of(sales, transactions)
    keys = [*site, "transaction_id"]
    sales = normalize_sales(sales)
    if stage:
        sales, transactions = stage(sales.select(*site, *USED)), stage(transactions)
    if hot is None:
        hot = hot_keys(sales, keys if site else "transaction_id")
        hot = stage(hot) if stage else hot
    if facts is None:
        facts = transaction_facts(sales, transactions)
        facts = stage(facts) if stage else facts
    tips = tip_lines(sales, facts.where("NOT refunded"), tip_grain, hot)

    lines = sales.select(*site, *LINE).unionByName(tips.select(*site, *LINE))
    # A transaction has several lines and about one fact: the facts are hashed, and the shares of its fee start from doubles.
    shares = facts.withColumns({name: F.col(name).cast("double") for name in ("commissioned_total", "fee")})
    with_facts = spread_join(lines, shares, keys, "left", hot, hashed=True).where(~F.coalesce("refunded", F.lit(False)))
    trimmed = with_facts.withColumn("description", strip(F.col("description")))
    marks_shift = F.col("description") == S.SHIFT_CHANGE
    priced = trimmed.withColumns(
        {
            "date": dates.sale_date(F.col("sold_at")),
            "price_gross": F.when(marks_shift, zero()).otherwise(F.col("price_gross")),
            "price_net": F.when(marks_shift, zero()).otherwise(F.col("price_net")),
        }
    )
    shifts = valid_shift_changes(transactions, facts, in_row_order)
    if not site:
        # One row per calendar day, so the list has a fixed bound (every day of 9,999 years is 3.7 million). With sites it has
        # none, and Spark measures it.
        shifts = F.broadcast(shifts)
    allocated = priced.join(shifts, [*site, "date"], "left").withColumns(
        {
            "shift_change": F.coalesce("shift_change", F.lit(dates.DEFAULT_SHIFT_CHANGE)),
            "commission": share_of_fee(F.col("price_gross"), F.col("commissioned_total"), F.col("fee")),
            "is_weekend": dates.is_weekend(F.col("date")),
            "comment": F.lit(None).cast("string"),
        }
    )
    return label_lines(allocated).select(*site, *S.INTERMEDIATE.names)
