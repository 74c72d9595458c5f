"""Jobs: the only place that runs actions, writes results and decides that a violation stops the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.dates import booking_date, is_supported_month, month_of, month_of_file, sale_date
from salesledger.operators import postings, reconcile, validate
from salesledger.operators.closing import Budget, account_balances, budget_closing, unbudgeted_accounts, with_every_post
from salesledger.operators.payments import unreadable_times
from salesledger.operators.redact import add_rows, apply_overrides, duplicate_overrides
from salesledger.operators.skew import hot_keys
from salesledger.plans.export import details_with_totals, partner_transactions, reports
from salesledger.plans.prepare import prepare, transaction_facts
from salesledger.plans.publish import publication
from salesledger.plans.staging import staging
from salesledger.sources import sinks
from salesledger.sources.intermediate import read_intermediate
from salesledger.sources.journal_xml import read_journal
from salesledger.sources.quarantine import check_cells, check_sales, check_transactions

SHOWN = 20
"""Offending rows in the text of an error; the table it names has all of them."""

# --- fixed values: first words of the names of the input files ---
SALES_FILE = ("sales_report", "csv")
TRANSACTIONS_FILE = ("transaction_report", "csv")


class BookkeepingError(Exception):
    """A check failed; the message shows the first offending rows and names the table with all of them."""


def fail_on(rows: DataFrame, message: str, store: str | None = None) -> None:
    """Stop if there are rows; all of them are written to ``store`` first."""
    if rows.isEmpty():
        return
    if store:
        rows.write.mode("overwrite").parquet(store)
        rows, message = rows.sparkSession.read.parquet(store), f"{message}; all rows: {store}"
    raise BookkeepingError("\n".join([message, *[str(row.asDict()) for row in rows.limit(SHOWN).collect()]]))


def check_month(spark: SparkSession, month: str) -> None:
    given = spark.range(1).select(F.lit(month).alias("month"))
    fail_on(given.where(~is_supported_month(F.col("month"))), "month must be yyyyMM from 202301 to 210012")


def file_months(spark: SparkSession, path: str, prefix: str, extension: str) -> DataFrame:
    """Months of the files under ``path``, from their names alone."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file_name"))
    return files.select("file_name", month_of_file(F.col("file_name"), prefix, extension).alias("month"))


def month_of_journal(spark: SparkSession, path: str) -> str:
    """The one month that the journal files under ``path`` are named after."""
    months = file_months(spark, path, "konten", "xls").select("month").distinct().limit(2).collect()
    if len(months) != 1 or months[0].month is None:
        raise BookkeepingError(f"journal files must be named konten_<yyyymm>….xls for one month: {path}")
    return months[0].month


def outside_file_month(rows: DataFrame, date: Column, prefix: str, extension: str) -> DataFrame:
    """Rows dated outside the month that their file is named after; files with other names are not asked.

    ``rows`` are as read, with the name of their file in ``file_name``.
    """
    named = rows.withColumns(
        {"file_month": month_of_file(F.col("file_name"), prefix, extension), "month": month_of(date)}
    )
    return named.where(is_supported_month(F.col("file_month")) & (F.col("month") != F.col("file_month")))


def run_prepare(
    spark: SparkSession,
    sales_path: str | list[str],
    transactions_path: str | list[str],
    target: str,
    overrides: DataFrame | None = None,
    mode: str = "errorifexists",
    staging_folder: str | None = None,
    multi_line: bool = False,
    site_pattern: str | None = None,
    quarantine: str | None = None,
    in_row_order: bool = False,
) -> DataFrame:
    """Read both exports, check that they agree, write the intermediate table; returns rows without a price.

    Rows that cannot be read stop the job, which names their files and rows. With ``quarantine``, a folder, they are stored
    there as ``sales`` and ``transactions``, and the job goes on with the others. ``in_row_order``: see ``prepare``.

    With ``site_pattern`` (see ``read_sales``) the files of several sites are worked on in one call. ``mode`` may be
    ``overwrite``, or ``months`` to replace the months of these files and leave the others; the table changes when it is complete.

    A failing check stores its rows under ``<target>_violations``. Tables in between are kept in ``staging_folder``, by
    default ``spark.checkpoint.dir``, and deleted at the end.
    """
    found = f"{target.rstrip('/')}_violations"
    with staging(spark, staging_folder) as stage:
        # CSV has no columns to skip, so the text is parsed once and every later step reads columns.
        both = {
            "sales": check_sales(spark, sales_path, stage, multi_line, site_pattern),
            "transactions": check_transactions(spark, transactions_path, stage, multi_line, site_pattern),
        }
        for name, checked in both.items():
            if quarantine:
                checked.rejected.write.mode(mode).parquet(f"{quarantine.rstrip('/')}/{name}")
            else:
                fail_on(checked.rejected, f"unreadable rows in the {name} report", f"{found}/unreadable_{name}")
        file_name = F.element_at(F.split(F.col("file"), "/"), -1)
        sales, transactions = (stage(checked.rows.withColumn("file_name", file_name)) for checked in both.values())
        for rows, date, name in (
            (sales, sale_date(F.col("sold_at")), SALES_FILE),
            (transactions, booking_date(F.col("booked_at")), TRANSACTIONS_FILE),
        ):
            strangers = outside_file_month(rows, date, *name)
            fail_on(strangers, f"rows of another month in {name[0]}", f"{found}/months_{name[0]}")
        # One row per transaction answers all checks on the sales report.
        summary = stage(reconcile.sales_summary(sales))
        missing = reconcile.reconcile(sales, transactions, summary)
        fail_on(missing, "transactions missing in the sales report or the transaction report", f"{found}/missing")
        fail_on(reconcile.refund_violations(sales, summary), "refunds that do not balance the sale", f"{found}/refunds")
        twice = reconcile.duplicate_transactions(transactions)
        fail_on(twice, "transactions booked more than once", f"{found}/duplicate_transactions")
        fail_on(unreadable_times(transactions), "transactions with an impossible time", f"{found}/times")
        facts = stage(transaction_facts(sales, transactions))
        hot = stage(hot_keys(sales, ["site", "transaction_id"] if site_pattern else "transaction_id"))
        prepared = prepare(sales, transactions, hot, facts=facts, in_row_order=in_row_order)
        if overrides is not None:
            twice = duplicate_overrides(overrides)
            fail_on(twice, "overrides that name a row more than once", f"{found}/duplicate_overrides")
            prepared = apply_overrides(prepared, overrides)
        with publication(spark, target, mode) as run:
            sinks.write_intermediate(prepared, run)
    return validate.zero_value_rows(read_intermediate(spark, target, sites=bool(site_pattern)))


def run_reread(
    spark: SparkSession,
    cells_path: str | list[str],
    target: str,
    extra: DataFrame | None = None,
    mode: str = "errorifexists",
    multi_line: bool = False,
    site_pattern: str | None = None,
    quarantine: str | None = None,
    staging_folder: str | None = None,
) -> None:
    """Store the hand-edited table, exported as cells, and further rows as the intermediate table to export from.

    Each row keeps its file and row, which the export's violations show. A malformed row stops the job; an unreadable cell is
    null. With ``quarantine``, a folder, both are stored there and the job goes on.
    """
    with staging(spark, staging_folder) as stage:
        checked = check_cells(spark, cells_path, stage, multi_line, site_pattern)
        if quarantine:
            checked.rejected.write.mode(mode).parquet(quarantine)
        else:
            broken = checked.rejected.where("rule = 'malformed_row'")
            fail_on(broken, "malformed rows in the edited table", f"{target.rstrip('/')}_violations/malformed")
        rows = checked.rows if extra is None else add_rows(checked.rows, extra)
        with publication(spark, target, mode) as run:
            sinks.write_intermediate(rows, run)


def run_export(
    spark: SparkSession,
    source: str,
    target: str,
    mode: str = "errorifexists",
    staging_folder: str | None = None,
    sites: bool = False,
) -> None:
    """Validate the intermediate table and write the four reports, the rows behind them once beside them.

    ``sites`` says that the table was stored with a site; the reports then have one as well.

    The six tables appear together or not at all; see ``publication`` for ``mode``.

    The table is read for the validation, for the daily sums, for the few rows that are posted in detail, and to
    write the rows and those of the partner. Everything else follows from the daily table.
    """
    found = f"{target.rstrip('/')}_violations"
    rows = read_intermediate(spark, source, sites)
    invalid = validate.violations(read_intermediate(spark, source, sites, places=True))
    fail_on(invalid, "invalid rows in the intermediate table", f"{found}/rows")
    with staging(spark, staging_folder) as stage, publication(spark, target, mode) as run:
        details = stage(details_with_totals(rows))
        made = reports(details, stage(postings.detail_rows(rows)))
        errors = postings.balance_violations(made.accounting).where(F.col("severity") == "error")
        fail_on(errors, "transitory accounts that do not net to zero", f"{found}/balances")
        sinks.write_report(made.details, f"{run}/details", S.DETAILS_REPORT, ["date"])
        sinks.write_report(made.partner, f"{run}/mittagstisch", S.PARTNER_REPORT, ["date"])
        sinks.write_report(made.accounting, f"{run}/accounting", S.ACCOUNTING_REPORT, ["date"])
        sinks.write_report(made.ledger, f"{run}/banana", S.LEDGER_REPORT, ["datum", "beschreibung"])
        sinks.write_intermediate(rows.drop("month"), f"{run}/transactions")
        sinks.write_intermediate(partner_transactions(rows).drop("month"), f"{run}/mittagstisch/transactions")


def run_close(
    spark: SparkSession,
    journal_path: str,
    budget: Budget,
    target: str,
    month: str | None = None,
    mode: str = "errorifexists",
    since_new_year: bool = False,
    staging_folder: str | None = None,
) -> DataFrame:
    """Close ``month``, by default the one in the file names.

    Fails on accounts outside the budget, else writes and returns the closing.
    """
    month = month_of_journal(spark, journal_path) if month is None else month
    check_month(spark, month)
    journal = with_every_post(read_journal(spark, journal_path), budget, month)
    with staging(spark, staging_folder) as stage:
        balances = stage(account_balances(journal, month, since_new_year))
        strangers = unbudgeted_accounts(balances, budget)
        fail_on(strangers, "accounts that the budget does not consider", f"{target.rstrip('/')}_violations/accounts")
        sinks.write_closing(budget_closing(balances, budget, month), target, mode)
    return spark.read.parquet(target)
