"""Money stays decimal until a result leaves the library, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesledger.schema import FINE_MONEY, MONEY


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def round2(formula: str) -> str:
    """SQL text that rounds half to even at two places."""
    return f"CAST(bround({formula}, 2) AS DECIMAL(18, 2))"


def total(*plus: str, minus: tuple[str, ...] = ()) -> str:
    """SQL text of a rounded sum and difference of columns, where a missing value counts as zero."""
    added = " + ".join(f"coalesce({name}, 0)" for name in plus)
    taken = "".join(f" - coalesce({name}, 0)" for name in minus)
    return round2(added + taken)


def share_of_fee(price: Column, amount: Column, fee: Column) -> Column:
    """Part of a transaction's fee that falls on one line, rounded half to even at four places.

    The division runs in double precision: ``rint`` on the scaled value is the IEEE form of half to even.
    An amount of zero gives null.
    """
    exact = F.try_divide(price.cast("double"), amount.cast("double")) * fee.cast("double")
    return (F.rint(exact * F.lit(10000.0)) / F.lit(10000.0)).cast(FINE_MONEY)
