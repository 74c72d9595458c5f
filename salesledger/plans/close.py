"""From journal and budget to the closing of a month."""

from __future__ import annotations

from pyspark.sql import DataFrame

from salesledger.operators.closing import Budget, account_balances, balances_by_month, budget_closing, closing_by_month
from salesledger.operators.closing import with_every_post


def close_month(journal: DataFrame, budget: Budget, month: str, since_new_year: bool = False) -> DataFrame:
    """Closing with a row for every post that lists an account."""
    balances = account_balances(with_every_post(journal, budget, month), month, since_new_year)
    return budget_closing(balances, budget, month)


def close_months(
    journal: DataFrame, budget: Budget, first: str, last: str, since_new_year: bool = False
) -> DataFrame:
    """Closings of all months from ``first`` to ``last`` with a row for every post that lists an account."""
    full = journal
    for year in range(int(first[:4]), int(last[:4]) + 1):
        full = with_every_post(full, budget, f"{year}01")
    return closing_by_month(balances_by_month(full, first, last, since_new_year), budget)
