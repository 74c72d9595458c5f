"""Year-to-date ledger movements against the budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.dates import cut_off
from salesledger.functions.keys import site_of
from salesledger.functions.money import zero

# --- fixed values ------------------------------------------------------------------------------------
BUDGET_ACCOUNT = r"^[3456789]\d{3,4}\z"
EXEMPT_ACCOUNT = "8900"
DUMMY_DESCRIPTION = "Dummy post"


@dataclass(frozen=True)
class Budget:
    """Budget as three tables: posts, the accounts of each post, the amount per post and year.

    The posts are common to all sites. Amounts are a site's own where ``post_budget`` has a site, else each site has them.
    """

    post: DataFrame
    post_account: DataFrame
    post_budget: DataFrame


def journal_movements(journal: DataFrame, month: str, since_new_year: bool = False) -> DataFrame:
    """Debits as positive and credits as negative movements of the budget accounts up to the end of ``month``.

    A journal normally holds one year; ``since_new_year`` also drops what lies before it.
    """
    period = F.col("date") < cut_off(F.lit(month))
    if since_new_year:
        period = period & (F.col("date") >= F.lit(f"{month[:4]}-01-01").cast("date"))
    sides = F.array(
        F.struct(F.col("debit").alias("account"), F.col("amount").alias("amount")),
        F.struct(F.col("credit").alias("account"), (-F.col("amount")).cast(S.MONEY).alias("amount")),
    )
    return journal.where(period).select(*site_of(journal), "date", F.inline(sides)).where(F.col("account").rlike(BUDGET_ACCOUNT))


def account_balances(journal: DataFrame, month: str, since_new_year: bool = False) -> DataFrame:
    """Balance per site and account. The account pattern admits 77,000 codes, so the result of one site is small."""
    return (
        journal_movements(journal, month, since_new_year)
        .groupBy(*site_of(journal), "account")
        .agg(F.coalesce(F.sum("amount"), zero()).cast(S.MONEY).alias("balance"))
    )


def balances_by_month(journal: DataFrame, first: str, last: str, since_new_year: bool = False) -> DataFrame:
    """Balance per account at the end of each month from ``first`` to ``last``, from one reading of the journal.

    Movements are summed by month, at most 77,000 accounts a month, and each of these sums counts in its own and
    every later month of the range; with ``since_new_year`` in those of its own year only.
    """
    month = F.date_trunc("month", F.col("date")).cast("date")
    site = site_of(journal)
    monthly = journal_movements(journal, last).groupBy(*site, "account", month.alias("of")).agg(F.sum("amount").alias("amount"))
    low, high = (F.to_date(F.lit(m), "yyyyMM") for m in (first, last))
    end = F.least(high, F.make_date(F.year("of"), F.lit(12), F.lit(1))) if since_new_year else high
    start = F.greatest(F.col("of"), low)
    counted = F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))
    spread = monthly.where(start <= end).select(*site, "account", "amount", F.explode(counted).alias("at"))
    return spread.groupBy(*site, F.date_format("at", "yyyyMM").alias("month"), "account").agg(
        F.coalesce(F.sum("amount"), zero()).cast(S.MONEY).alias("balance")
    )


def closing_by_month(balances: DataFrame, budget: Budget) -> DataFrame:
    """Budget, actual and remaining amount per post and month, from balances by month."""
    known = _with_posts(balances, budget).where(F.col("post_key").isNotNull())
    site = site_of(balances)
    per_post = known.groupBy(*site, "month", "post_key", "name", "sort", "factor").agg(
        F.sum(F.col("balance") * F.col("factor")).cast(S.MONEY).alias("net")
    )
    own = site_of(budget.post_budget)
    yearly = budget.post_budget.select(*own, "year", "post_key", F.col("amount").alias("budget"))
    budgeted = per_post.withColumn("year", F.left("month", F.lit(4))).join(yearly, [*own, "year", "post_key"], "left")
    budgeted = budgeted.withColumn("budget", F.coalesce("budget", zero()))
    closed = budgeted.groupBy(*site, "month", "name", "sort", "budget", "factor").agg(F.sum("net").cast(S.MONEY).alias("net"))
    remaining: Column = ((F.col("budget") - F.col("net")) * F.col("factor")).cast(S.MONEY)
    return closed.select(*site, "month", F.col("name").alias("group"), "sort", "budget", "net", remaining.alias("remaining"))


def account_posts(budget: Budget) -> DataFrame:
    """The post of each account; an account listed in several posts belongs to the first by sort order."""
    listed = budget.post_account.where(F.col("account").rlike(BUDGET_ACCOUNT)).select("account", "post_key")
    ranked = listed.join(budget.post, "post_key")
    first = F.min(F.struct("sort", "post_key", "name", "factor")).alias("first")
    return ranked.groupBy("account").agg(first).select("account", "first.*")


def _with_posts(balances: DataFrame, budget: Budget) -> DataFrame:
    # One row per admissible account code, 77,000 at most.
    posts = F.broadcast(account_posts(budget))
    return balances.where(F.col("account") != EXEMPT_ACCOUNT).join(posts, "account", "left")


def unbudgeted_accounts(balances: DataFrame, budget: Budget) -> DataFrame:
    """Accounts with movements that no post lists."""
    return _with_posts(balances, budget).where(F.col("post_key").isNull()).select(
        *site_of(balances), "account", "balance"
    )


def budget_closing(balances: DataFrame, budget: Budget, month: str) -> DataFrame:
    """Budget, actual and remaining amount per post, ordered by ``sort``."""
    site, own = site_of(balances), site_of(budget.post_budget)
    year_budget = budget.post_budget.where(F.col("year") == month[:4]).select(
        *own, "post_key", F.col("amount").alias("budget")
    )
    per_post = (
        _with_posts(balances, budget)
        .where(F.col("post_key").isNotNull())
        .groupBy(*site, "post_key", "name", "sort", "factor")
        .agg(F.sum(F.col("balance") * F.col("factor")).cast(S.MONEY).alias("net"))
    )
    budgeted = per_post.join(year_budget, [*own, "post_key"], "left").withColumn("budget", F.coalesce("budget", zero()))
    closed = budgeted.groupBy(*site, "name", "sort", "budget", "factor").agg(F.sum("net").cast(S.MONEY).alias("net"))
    remaining: Column = ((F.col("budget") - F.col("net")) * F.col("factor")).cast(S.MONEY)
    return closed.select(
        *site,
        F.lit(month).alias("month"),
        F.col("name").alias("group"),
        "sort",
        "budget",
        "net",
        remaining.alias("remaining"),
    ).orderBy(*site, "sort")


def dummy_postings(budget: Budget, month: str) -> DataFrame:
    """A posting of zero on the first account of each post, so that every post shows up in the closing."""
    first_account = budget.post_account.where(F.col("pos") == 0)
    return first_account.select(
        F.lit(f"{month[:4]}-01-01").cast("date").alias("date"),
        F.lit(DUMMY_DESCRIPTION).alias("description"),
        F.col("account").alias("debit"),
        F.col("account").alias("credit"),
        zero().alias("amount"),
    )


def _at_every_site(postings: DataFrame, journal: DataFrame) -> DataFrame:
    """``postings``, one per post, for each site of the journal."""
    sites = journal.select(*site_of(journal)).distinct()
    # One row: fewer accounts than the account pattern admits.
    listed = F.broadcast(postings.agg(F.collect_list(F.struct(*S.JOURNAL.names)).alias("postings")))
    return sites.join(listed, F.lit(True)).select(*sites.columns, F.inline("postings"))


def with_every_post(journal: DataFrame, budget: Budget, month: str) -> DataFrame:
    """The journal with a posting of zero for every post that lists an account, at every site."""
    site, dummies = site_of(journal), dummy_postings(budget, month)
    dummies = _at_every_site(dummies, journal) if site else dummies
    return journal.select(*site, *S.JOURNAL.names).unionByName(dummies)
