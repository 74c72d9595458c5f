"""Do sales report and transaction report name the same transactions? And which were refunded?

Both reports are first reduced to one row per transaction, before any shuffle of detail rows, so a transaction
with a very large number of lines costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.keys import site_of
from salesledger.functions.money import zero
from salesledger.operators.payments import commission_base
from salesledger.operators.skew import spread_join


def is_refund():
    return F.col("kind").isin(S.REFUND_KINDS)


def _ids_in_sales(sales: DataFrame) -> DataFrame:
    return (
        sales.where(F.col("transaction_id").isNotNull())
        .groupBy(*site_of(sales), "transaction_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def _ids_in_transactions(transactions: DataFrame) -> DataFrame:
    valid = F.col("status").isin(S.STATUS_DONE, S.STATUS_PLANNED) & F.col("transaction_id").isNotNull()
    return transactions.where(valid).groupBy(*site_of(transactions), "transaction_id").agg(F.count(F.lit(1)).alias("n_rows"))


def missing_in_sales(sales: DataFrame, transactions: DataFrame) -> DataFrame:
    """Valid transactions without a sales line, with their number of rows."""
    keys = [*site_of(sales, transactions), "transaction_id"]
    return _ids_in_transactions(transactions).join(_ids_in_sales(sales).select(keys), keys, "left_anti")


def missing_in_transactions(sales: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions with sales lines but no valid transaction, with their number of lines."""
    keys = [*site_of(sales, transactions), "transaction_id"]
    return _ids_in_sales(sales).join(_ids_in_transactions(transactions).select(keys), keys, "left_anti")


def reconcile(sales: DataFrame, transactions: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Both directions in one pass: ``missing_in`` tells which report lacks the transaction.

    ``summary`` is a stored ``sales_summary`` of the same report.
    """
    keys = [*site_of(sales, transactions), "transaction_id"]
    ids = _ids_in_sales(sales) if summary is None else summary.select(*keys, "n_rows")
    in_sales = ids.withColumnRenamed("n_rows", "sales_rows")
    in_transactions = _ids_in_transactions(transactions).withColumnRenamed("n_rows", "transaction_rows")
    both = in_sales.join(in_transactions, keys, "full_outer")
    missing = F.when(F.col("sales_rows").isNull(), "sales").when(
        F.col("transaction_rows").isNull(), "transactions"
    )
    return both.select(
        *keys, missing.alias("missing_in"), F.coalesce("sales_rows", "transaction_rows").alias("n_rows")
    ).where(F.col("missing_in").isNotNull())


def sales_summary(sales: DataFrame) -> DataFrame:
    """One row per transaction of the sales report: number of lines, net sum, and whether a line refunds it."""
    return (
        sales.where(F.col("transaction_id").isNotNull())
        .groupBy(*site_of(sales), "transaction_id")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("price_net"), zero()).cast(S.MONEY).alias("total_net"),
            F.max(F.coalesce(is_refund(), F.lit(False))).alias("refunded"),
        )
    )


def refund_violations(sales: DataFrame, summary: DataFrame | None = None) -> DataFrame:
    """Refunded transactions whose lines do not add up to exactly zero."""
    per_transaction = sales_summary(sales) if summary is None else summary
    return per_transaction.where(F.col("refunded") & (F.col("total_net") != 0)).select(
        *site_of(sales), "transaction_id", "total_net"
    )


def refunded_ids(sales: DataFrame) -> DataFrame:
    return sales.where(is_refund()).select(*site_of(sales), "transaction_id").distinct()


def drop_refunded_sales(sales: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Sales without any line of a refunded transaction; lines without a transaction id stay."""
    return spread_join(sales, refunded_ids(sales), [*site_of(sales), "transaction_id"], "left_anti", hot)


def drop_refunded_transactions(
    sales: DataFrame, transactions: DataFrame, hot: DataFrame | None = None
) -> DataFrame:
    """Transactions without the refunded ones. A refund without an id removes the rows without an id."""
    keys = [*site_of(sales, transactions), "transaction_id"]
    return spread_join(transactions, refunded_ids(sales), keys, "left_anti", hot, null_safe=True)


def duplicate_transactions(transactions: DataFrame) -> DataFrame:
    """Transaction ids booked more than once; each would repeat the sales lines it is joined to."""
    return (
        commission_base(transactions)
        .groupBy(*site_of(transactions), "transaction_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("transaction_id").isNotNull() & (F.col("n_rows") > 1))
    )
