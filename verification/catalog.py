"""Every operator as a query over the generated tables. Money leaves as double, after all rounding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger.functions import dates
from salesledger.operators import closing, keyfigures, measures, normalize, payments, postings, reconcile, reports
from salesledger.operators import redact, validate
from salesledger.plans import close, export
from salesledger.plans.prepare import prepare
from salesledger.sources.intermediate import coerce_cells
from verification import files, star
from verification.oracle import CLOSING_MONTH, FIRST_MONTH

Query = Callable[[SparkSession, str], DataFrame]


def out(df: DataFrame) -> DataFrame:
    """Cast decimals to double, the last step of every query."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_sales(star.sales(spark, sf_dir))


def _kept_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.drop_refunded_transactions(_sales(spark, sf_dir), star.transactions(spark, sf_dir))


def _tips(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    base = payments.commission_base(_kept_transactions(spark, sf_dir))
    return payments.tip_lines(_sales(spark, sf_dir), base, grain)


def _accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.accounting(star.intermediate(spark, sf_dir))


def _ledger(rows: DataFrame) -> DataFrame:
    """Postings from the rows, which the reports and the details read."""
    return postings.ledger(export.accounting(rows), rows)


def _invalid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = star.edited(spark, sf_dir, faulty=True)
    found = [validate.invalid_values(df, field).withColumn("field", F.lit(field)) for field in validate.ALLOWED]
    return reduce(DataFrame.unionByName, found)


def _file_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of file names made from the orders' dates, with other first words, lengths and endings."""
    names = star.table(spark, sf_dir, "orders").selectExpr(
        """concat(CASE o_orderkey % 7 WHEN 1 THEN 'intermediat_' ELSE 'intermediate_' END,
                  CASE o_orderkey % 7 WHEN 2 THEN concat(year(o_orderdate), month(o_orderdate))
                       WHEN 3 THEN date_format(o_orderdate, 'MM.yy') ELSE date_format(o_orderdate, 'yyyyMM') END,
                  CASE o_orderkey % 7 WHEN 4 THEN '_edited' ELSE '' END,
                  CASE o_orderkey % 7 WHEN 5 THEN '.csv' WHEN 6 THEN '.XLSX' ELSE '.xlsx' END) AS file_name"""
    )
    month = dates.month_of_file(F.col("file_name"), "intermediate", "xlsx")
    return names.select("file_name", month.alias("month"), dates.is_supported_month(month).alias("supported"))


def _repeated_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's priority as a manual label: most labels are named more than once."""
    edits = star.table(spark, sf_dir, "orders").selectExpr(
        "o_orderpriority AS transaction_id", "o_orderstatus AS description"
    )
    return redact.duplicate_overrides(edits)


def _balances(spark: SparkSession, sf_dir: str, since_new_year: bool = False) -> DataFrame:
    return closing.account_balances(star.journal(spark, sf_dir), CLOSING_MONTH, since_new_year)


def _unreported(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = keyfigures.daily_key_figures(star.intermediate(spark, sf_dir), keyfigures.UNREPORTED)
    return daily.select("month", "date", *[F.col(f.name).alias(f"f_{f.name}") for f in keyfigures.UNREPORTED])


SITES = 2


def _two_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return star.sales(spark, sf_dir, SITES), star.transactions(spark, sf_dir, SITES)


def _sites_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intermediate table of two sites that number their transactions alike, from one call; the same manual labels for both."""
    rows = prepare(*_two_sites(spark, sf_dir), stage=star.staging(spark))
    return redact.apply_overrides(rows, star.overrides(spark, sf_dir), on=("description",))


def _sites_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(star.stored(_sites_edited(spark, sf_dir)))


def _sites_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = star.table(spark, sf_dir, "lineitem").select(F.expr(f"concat('s', l_orderkey % {SITES}) AS site"), "*")
    return star.journal_of(parts)


def catalog() -> dict[str, Query]:
    prepared, intermediate, transactions = star.prepared, star.intermediate, star.transactions
    plain: dict[str, Query] = {
        "normalize_sales": _sales,
        "normalize_transactions": lambda s, d: normalize.normalize_transactions(transactions(s, d)),
        "missing_in_sales": lambda s, d: reconcile.missing_in_sales(star.sales(s, d), transactions(s, d)),
        "missing_in_transactions": lambda s, d: reconcile.missing_in_transactions(
            star.sales(s, d), transactions(s, d)
        ),
        "reconcile": lambda s, d: reconcile.reconcile(star.sales(s, d), transactions(s, d)),
        "refund_violations": lambda s, d: reconcile.refund_violations(_sales(s, d)),
        "drop_refunded_sales": lambda s, d: reconcile.drop_refunded_sales(_sales(s, d)),
        "drop_refunded_transactions": _kept_transactions,
        "duplicate_transactions": lambda s, d: reconcile.duplicate_transactions(transactions(s, d)),
        "shift_changes": lambda s, d: payments.shift_changes(_kept_transactions(s, d)),
        "commission_base": lambda s, d: payments.commission_base(_kept_transactions(s, d)),
        "tip_lines": lambda s, d: _tips(s, d, "line"),
        "tip_lines_per_transaction": lambda s, d: _tips(s, d, "transaction"),
        "allocate_commission": lambda s, d: prepared(s, d).select(
            "transaction_id", "description", "price_gross", "commission"
        ),
        "infer_topic": lambda s, d: prepared(s, d).select("transaction_id", "date", "time", "description", "topic"),
        "infer_owner": lambda s, d: prepared(s, d).select("transaction_id", "description", "topic", "owner"),
        "infer_labels": lambda s, d: prepared(s, d)
        .groupBy("topic", "owner", "purpose", "type", "payment_method")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        "prepare_intermediate": prepared,
        "apply_overrides": star.edited,
        "reread_intermediate": lambda s, d: coerce_cells(files.as_cells(intermediate(s, d))),
        "month_of_file": _file_months,
        "duplicate_overrides": _repeated_overrides,
        "zero_value_rows": lambda s, d: validate.zero_value_rows(prepared(s, d)),
        "invalid_values": _invalid_values,
        "topic_owner_violations": lambda s, d: validate.topic_owner_violations(star.edited(s, d, faulty=True)),
        "violations": lambda s, d: validate.violations(star.edited(s, d, faulty=True))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_rows")),
        "unusual_owners": lambda s, d: validate.unusual_owners(star.edited(s, d, faulty=True)),
        "tips_in_detail_postings": lambda s, d: validate.tips_in_detail_postings(intermediate(s, d)),
        "partner_transactions": lambda s, d: export.partner_transactions(intermediate(s, d)),
        "daily_key_figures": lambda s, d: keyfigures.daily_key_figures(intermediate(s, d)),
        "unreported_figures": _unreported,
        "meal_counts": lambda s, d: keyfigures.daily_key_figures(intermediate(s, d), keyfigures.MEAL_FIGURES),
        "daily_details": lambda s, d: measures.details_report(keyfigures.daily_key_figures(intermediate(s, d))),
        "details_with_total": lambda s, d: export.details_with_totals(intermediate(s, d)),
        "miti_report": lambda s, d: reports.partner_report(export.details_with_totals(intermediate(s, d))),
        "accounting_report": _accounting,
        "balance_violations": lambda s, d: postings.balance_violations(
            export.accounting(star.edited(s, d, faulty=True))
        ),
        "rounding_correction": lambda s, d: postings.rounding_correction(_accounting(s, d)),
        "posting_summary": lambda s, d: postings.posting_summary(_accounting(s, d)),
        "posting_details": lambda s, d: postings.posting_details(intermediate(s, d)),
        "banana_ledger": lambda s, d: _ledger(intermediate(s, d)),
        "journal_movements": lambda s, d: closing.journal_movements(star.journal(s, d), CLOSING_MONTH),
        "account_balances": _balances,
        "account_balances_since_new_year": lambda s, d: _balances(s, d, since_new_year=True),
        "unbudgeted_accounts": lambda s, d: closing.unbudgeted_accounts(_balances(s, d), star.budget(s, d)),
        "budget_closing": lambda s, d: closing.budget_closing(_balances(s, d), star.budget(s, d), CLOSING_MONTH),
        "dummy_postings": lambda s, d: closing.dummy_postings(star.budget(s, d), CLOSING_MONTH),
        "closing_all_posts": lambda s, d: close.close_month(star.journal(s, d), star.budget(s, d), CLOSING_MONTH),
        "closing_by_month": lambda s, d: close.close_months(
            star.journal(s, d), star.budget(s, d), FIRST_MONTH, CLOSING_MONTH
        ),
        "closing_by_month_since_new_year": lambda s, d: close.close_months(
            star.journal(s, d), star.budget(s, d), FIRST_MONTH, CLOSING_MONTH, since_new_year=True
        ),
        "read_sales_csv": files.sales_csv,
        "read_transactions_csv": files.transactions_csv,
        "read_cells_csv": files.cells_csv,
        "read_journal": files.journal_xml,
        "read_budget_posts": files.budget_posts,
        "read_budget_amounts": files.budget_amounts,
        "stored_intermediate": files.stored_intermediate,
        "stored_report": files.stored_report,
        "stored_closing": files.stored_closing,
        "rejected_sales": files.rejected_sales,
        "accepted_sales": files.accepted_sales,
        "numbered_violations": files.numbered_violations,
        "sites_reconcile": lambda s, d: reconcile.reconcile(*_two_sites(s, d)),
        "sites_refund_violations": lambda s, d: reconcile.refund_violations(normalize.normalize_sales(_two_sites(s, d)[0])),
        "sites_prepare": _sites_edited,
        "sites_details": lambda s, d: export.details_with_totals(_sites_edited(s, d)),
        "sites_ledger": _sites_ledger,
        "sites_closing": lambda s, d: close.close_month(_sites_journal(s, d), star.budget(s, d), CLOSING_MONTH),
        "sites_closing_by_month": lambda s, d: close.close_months(
            _sites_journal(s, d), star.budget(s, d), FIRST_MONTH, CLOSING_MONTH
        ),
    }
    return {name: (lambda s, d, q=query: out(q(s, d))) for name, query in plain.items()}
