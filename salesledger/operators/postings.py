"""Double-entry postings from the accounting report, and the checks on transitory accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.dates import last_of_month, month_of
from salesledger.functions.keys import site_of
from salesledger.functions.money import round2, zero

# --- fixed values ------------------------------------------------------------------------------------
TOLERANCE = "0.05"
PREFIX = "SU "
CARD_ACCOUNT = "10920"
CASH_ACCOUNT = "10000"
RENTAL_ACCOUNT = "31000"
PAID_OUT_ACCOUNT = "20121"
CORRECTED_ACCOUNT = "20051"
CORRECTION_ACCOUNT = "68450"
CORRECTION_TEXT = "SU Rundungskorrektur 20051"
UNDATED_POSTING = ("10930", "10100")
PAID_OUT_TEXT = "SU Kooperation Ausbezahlt"
CARD_TEXT = "SU Kooperation Karte"
CASH_TEXT = "SU Kooperation bar"

# Account -> (columns that are added, columns that are subtracted, severity)
BALANCES = {
    "10920": (
        [
            "p10920_30200",
            "p10920_30700",
            "p10920_30810",
            "p10920_23050",
            "p10920_31000",
            "p10920_32000",
            "p10920_46000",
            "p10920_20051",
            "p10920_20121",
            "p10920_10910",
        ],
        ["payment_sumup", "p68450_10920"],
        "error",
    ),
    "20121": (["p10000_20121", "p10920_20121"], ["p20121_10000"], "error"),
    "20051": (["p10920_20051", "p59991_20051"], ["p20051_10930", "p20051_30500"], "info"),
}


def _net(account: str) -> Column:
    """Balance of a transitory account; null as soon as one posting is null."""
    plus, minus, _ = BALANCES[account]
    return F.expr(round2(" + ".join(plus) + "".join(f" - {name}" for name in minus)))


def balance_violations(accounting: DataFrame) -> DataFrame:
    """Rows and transitory accounts whose balance is off by more than the tolerance.

    10920 and 20121 are errors. 20051 is information only, because ``rounding_correction`` settles it.
    """
    checks = F.array(
        *[
            F.struct(F.lit(a).alias("account"), _net(a).alias("net"), F.lit(BALANCES[a][2]).alias("severity"))
            for a in BALANCES
        ]
    )
    rows = accounting.select(*site_of(accounting), "month", "date", "is_total", F.inline(checks))
    return rows.where(F.abs("net") > F.lit(TOLERANCE).cast(S.MONEY))


BLANKS = ["beleg", "rechnung", "anzahl", "einheit", "preis_einheit"]
"""Ledger columns that no posting fills: empty text, or null in the rounding correction."""


def _ledger_row(site: list[str], **values: Column) -> list[Column]:
    blank = F.lit("")
    columns = {**{name: blank for name in S.LEDGER_REPORT}, **values}
    return [*[F.col(name) for name in (*site, "month")], *[columns[name].alias(name) for name in S.LEDGER_REPORT]]


def _posted(accounting: DataFrame, entries: list[Column]) -> DataFrame:
    """Entries of the total row of each month as ledger rows, without those that amount to zero."""
    site = site_of(accounting)
    long = accounting.where(F.col("is_total")).select(*site, "month", F.inline(F.array(*entries)))
    return long.where(F.col("betrag_chf") != 0).select(
        *_ledger_row(
            site,
            datum=F.when(F.col("dated"), last_of_month(F.col("month"))),
            beschreibung=F.col("beschreibung"),
            kt_soll=F.col("kt_soll"),
            kt_haben=F.col("kt_haben"),
            betrag_chf=F.col("betrag_chf"),
            **{name: F.col("blank") for name in BLANKS},
        )
    )


def _entry(debit: Column, credit: Column, text: str, dated: bool, amount: Column, blank: str | None) -> Column:
    return F.struct(
        debit.alias("kt_soll"),
        credit.alias("kt_haben"),
        F.lit(text).alias("beschreibung"),
        F.lit(dated).alias("dated"),
        amount.cast(S.MONEY).alias("betrag_chf"),
        F.lit(blank).cast("string").alias("blank"),
    )


def _summary_entries() -> list[Column]:
    return [
        _entry(
            F.lit(debit),
            F.lit(credit),
            PREFIX + text,
            (debit, credit) != UNDATED_POSTING,
            F.col(S.posting_column(debit, credit)),
            "",
        )
        for _, debit, credit, text in S.POSTINGS
    ]


def _correction_entry() -> Column:
    net = _net(CORRECTED_ACCOUNT)
    debit = F.when(net > 0, CORRECTED_ACCOUNT).otherwise(CORRECTION_ACCOUNT)
    credit = F.when(net < 0, CORRECTED_ACCOUNT).otherwise(CORRECTION_ACCOUNT)
    return _entry(debit, credit, CORRECTION_TEXT, True, F.abs(net), None)


def rounding_correction(accounting: DataFrame) -> DataFrame:
    """Posting that settles what rounding left on account 20051 in a month."""
    return _posted(accounting, [_correction_entry()])


def posting_summary(accounting: DataFrame) -> DataFrame:
    """The total row of each month as postings, without those that amount to zero."""
    return _posted(accounting, _summary_entries())


def summary_with_correction(accounting: DataFrame) -> DataFrame:
    """Both from one reading of the report."""
    return _posted(accounting, [*_summary_entries(), _correction_entry()])


def _money_account() -> Column:
    return F.when(F.col("payment_method") == "Card", CARD_ACCOUNT).otherwise(CASH_ACCOUNT)


def _rentals(intermediate: DataFrame) -> DataFrame:
    return (
        intermediate.where(F.col("topic") == "Rental")
        .withColumn("month", month_of(F.col("date")))
        .select(
            *_ledger_row(
                site_of(intermediate),
                datum=F.col("date"),
                beschreibung=F.col("description"),
                kt_soll=_money_account(),
                kt_haben=F.lit(RENTAL_ACCOUNT),
                betrag_chf=F.col("price_net").cast(S.MONEY),
            )
        )
    )


def _paid_out(intermediate: DataFrame) -> DataFrame:
    """Per day: what came in for partners by payment method, and the sum paid out to them in cash."""
    site = site_of(intermediate)
    by_method = (
        intermediate.where(F.col("owner") == "PaidOut")
        .groupBy(*site, "date", "payment_method")
        .agg(F.sum(F.coalesce("price_net", zero())).alias("amount"))
    )
    day, method = [F.col(name) for name in (*site, "date")], F.col("payment_method")
    both = by_method.groupingSets([[*day, method], day], *day, method).agg(F.grouping("payment_method").alias("out"), F.sum("amount").alias("amount"))
    out, card = F.col("out") == 1, F.col("payment_method") == "Card"
    return both.withColumn("month", month_of(F.col("date"))).select(
        *_ledger_row(
            site,
            datum=F.col("date"),
            beschreibung=F.when(out, PAID_OUT_TEXT)
            .when(card, CARD_TEXT)
            .otherwise(CASH_TEXT),
            kt_soll=F.when(out, PAID_OUT_ACCOUNT).otherwise(_money_account()),
            kt_haben=F.when(out, CASH_ACCOUNT).otherwise(PAID_OUT_ACCOUNT),
            betrag_chf=F.coalesce(F.col("amount"), zero()).cast(S.MONEY),
        )
    )


def detail_rows(intermediate: DataFrame) -> DataFrame:
    """The rows that postings are kept for in detail, a small part of all."""
    return intermediate.where((F.col("topic") == "Rental") | (F.col("owner") == "PaidOut"))


def posting_details(intermediate: DataFrame) -> DataFrame:
    """Postings kept one by one or by day: room rentals and what belongs to cooperation partners."""
    return _rentals(intermediate).unionByName(_paid_out(intermediate))


def _replaced(intermediate: DataFrame) -> DataFrame:
    """Month and credit account of every posting of ``posting_details``, at most three accounts a site and month."""
    accounts = f"""concat(IF(topic = 'Rental', array('{RENTAL_ACCOUNT}'), array()),
                          IF(owner = 'PaidOut', array('{PAID_OUT_ACCOUNT}', '{CASH_ACCOUNT}'), array()))"""
    rows = detail_rows(intermediate).withColumn("month", month_of(F.col("date")))
    return rows.select(*site_of(intermediate), "month", F.explode(F.expr(accounts)).alias("kt_haben")).distinct()


def ledger(accounting: DataFrame, intermediate: DataFrame) -> DataFrame:
    """Postings of each month: details replace the summary postings to the accounts they credit.

    ``intermediate`` may be cut down to its ``detail_rows``.
    """
    details = posting_details(intermediate)
    site = site_of(accounting, intermediate)
    # At most three credit accounts per calendar month, so the list of one site is small however many rows there are.
    replaced = _replaced(intermediate) if site else F.broadcast(_replaced(intermediate))
    summary = summary_with_correction(accounting)
    kept = summary.where(F.col("kt_haben").isNotNull()).join(replaced, [*site, "month", "kt_haben"], "left_anti")
    return kept.select(details.columns).unionByName(details)
