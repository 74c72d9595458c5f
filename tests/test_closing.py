"""Budget closing, on the posts the test journal touches."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import frame, rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import dates
from salesledger.operators import closing
from salesledger.plans.close import close_month

POSTS = [
    dict(post_key="E30", name="Ertrag Restauration", sort=1, factor=-1),
    dict(post_key="E31", name="Ertrag Vermietungen", sort=2, factor=-1),
    dict(post_key="E360", name="Spenden", sort=6, factor=-1),
    dict(post_key="A40", name="Restaurationsaufwand", sort=9, factor=1),
    dict(post_key="RX", name="Reserve", sort=26, factor=-1),
]
ACCOUNTS = {"E30": ["30100", "30200", "30700"], "E31": ["31000"], "E360": ["36000", "36001"], "A40": ["40000"]}
AMOUNTS = {"E30": 30.01, "E31": 31.01, "E360": 360.01, "RX": 1.1}

JOURNAL = [
    dict(date="2025-01-01", description="Posting 1", debit="10100", credit="30100", amount=1000),
    dict(date="2025-05-16", description="Posting 2", debit="36000", credit="30700", amount=200),
    dict(date="2025-07-20", description="Posting 3", debit="30100", credit="31000", amount=100),
]


@pytest.fixture(scope="module")
def budget(spark):
    listed = [
        dict(post_key=key, pos=i, account=account)
        for key, accounts in ACCOUNTS.items()
        for i, account in enumerate(accounts)
    ]
    amounts = [dict(year="2025", post_key=k, amount=v) for k, v in AMOUNTS.items()]
    amounts.append(dict(year="2024", post_key="E30", amount=30))
    return closing.Budget(
        frame(spark, S.POST, POSTS), frame(spark, S.POST_ACCOUNT, listed), frame(spark, S.POST_BUDGET, amounts)
    )


def close(spark, budget, month, journal=JOURNAL):
    balances = closing.account_balances(frame(spark, S.JOURNAL, journal), month)
    return rows_of(closing.budget_closing(balances, budget, month), "group", "budget", "net", "remaining")


def test_closing_up_to_may(spark, budget):
    assert close(spark, budget, "202505") == [
        ("Ertrag Restauration", 30.01, 1200.0, 1169.99),
        ("Spenden", 360.01, -200.0, -560.01),
    ]


def test_closing_up_to_july(spark, budget):
    assert close(spark, budget, "202507") == [
        ("Ertrag Restauration", 30.01, 1100.0, 1069.99),
        ("Ertrag Vermietungen", 31.01, 100.0, 68.99),
        ("Spenden", 360.01, -200.0, -560.01),
    ]


def test_every_post_with_an_account_shows_up(spark, budget):
    out = close_month(frame(spark, S.JOURNAL, JOURNAL), budget, "202505")
    assert rows_of(out, "group", "budget", "net", "remaining") == [
        ("Ertrag Restauration", 30.01, 1200.0, 1169.99),
        ("Ertrag Vermietungen", 31.01, 0.0, -31.01),
        ("Spenden", 360.01, -200.0, -560.01),
        ("Restaurationsaufwand", 0.0, 0.0, 0.0),
    ]
    dummies = closing.dummy_postings(budget, "202505")
    assert sorted(rows_of(dummies, "debit", "credit", "amount")) == [
        (a[0], a[0], 0.0) for a in sorted(ACCOUNTS.values())
    ]


def test_cut_off_and_new_year(spark, budget):
    old = [*JOURNAL, dict(date="2024-12-31", debit="40000", credit="10000", amount=5)]
    journal = frame(spark, S.JOURNAL, old)
    assert dict(rows_of(closing.account_balances(journal, "202505")))["40000"] == 5.0
    assert "40000" not in dict(rows_of(closing.account_balances(journal, "202505", since_new_year=True)))
    months = spark.createDataFrame([("202411",), ("202412",), ("202507",)], "month string")
    assert rows_of(months.select(dates.cut_off(F.col("month")))) == [
        (dt.date(2024, 12, 1),), (dt.date(2025, 1, 1),), (dt.date(2025, 8, 1),),
    ]


def test_only_budget_accounts_move(spark, budget):
    accounts = ["10000", "2000", "3000", "30000", "300", "300000", "9999", "x3000", "3000x", None, "3000\n"]
    journal = frame(spark, S.JOURNAL, [dict(date="2025-01-01", debit=a, credit="1", amount=1) for a in accounts])
    assert sorted(rows_of(closing.account_balances(journal, "202501"), "account")) == [
        ("3000",), ("30000",), ("9999",)
    ]


def test_accounts_outside_the_budget(spark, budget):
    journal = [*JOURNAL, dict(date="2025-01-01", debit="8900", credit="39999", amount=7)]
    balances = closing.account_balances(frame(spark, S.JOURNAL, journal), "202507")
    assert rows_of(closing.unbudgeted_accounts(balances, budget)) == [("39999", -7.0)]


def test_account_in_two_posts_belongs_to_the_first(spark, budget):
    twice = budget.post_account.unionByName(
        frame(spark, S.POST_ACCOUNT, [dict(post_key="A40", pos=1, account="30100")])
    )
    posts = closing.account_posts(closing.Budget(budget.post, twice, budget.post_budget))
    assert rows_of(posts.where("account = '30100'"), "post_key") == [("E30",)]


def test_movements_add_up_to_zero(spark, budget):
    inner = [r for r in JOURNAL if r["debit"][0] == "3"]
    moved = closing.journal_movements(frame(spark, S.JOURNAL, inner), "202512")
    assert moved.agg(F.sum("amount")).first()[0] == 0
