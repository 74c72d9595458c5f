"""From the intermediate table to the four reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger.operators.keyfigures import daily_key_figures
from salesledger.operators.measures import details_report, with_total_rows
from salesledger.operators.postings import ledger
from salesledger.operators.reports import accounting_report, partner_report


@dataclass(frozen=True)
class Reports:
    details: DataFrame
    partner: DataFrame
    accounting: DataFrame
    ledger: DataFrame


def details_with_totals(intermediate: DataFrame) -> DataFrame:
    """Details per day and a total row per month."""
    return with_total_rows(details_report(daily_key_figures(intermediate)))


def accounting(intermediate: DataFrame) -> DataFrame:
    return accounting_report(details_with_totals(intermediate))


def reports(details: DataFrame, detail_rows: DataFrame) -> Reports:
    """All four reports from the daily details with totals and the rows that are posted in detail.

    Both should be stored tables, as each report reads them.
    """
    posted = accounting_report(details)
    return Reports(details, partner_report(details), posted, ledger(posted, detail_rows))


def partner_transactions(intermediate: DataFrame) -> DataFrame:
    """The rows behind the partner report."""
    return intermediate.where(F.col("topic") == "MiTi")
