"""Reconciling, refunds, tips, commission and labels, on small hand-made reports."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import frame, rows_of
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import dates, labels
from salesledger.operators import normalize, payments, reconcile
from salesledger.operators.redact import add_rows, apply_overrides
from salesledger.plans.prepare import prepare

DAY = "24.03.2023"
ISO = "2023-03-24"


def sales(spark, *rows):
    usual = dict(
        sold_at=f"{DAY}, 12:32", kind="Verkauf", payment="MC", quantity=1, category="Alkoholfrei", sku="",
        currency="CHF", discount=0, tax=0, tax_rate="", account="a@b.ch",
    )
    filled = [{"list_price": r.get("price_gross"), "price_net": r.get("price_gross"), **r} for r in rows]
    return frame(spark, S.SALES, filled, **usual)


def transactions(spark, *rows):
    return frame(spark, S.TRANSACTIONS, list(rows), booked_at=f"{ISO} 12:32:00", kind="Umsatz", status="Erfolgreich")


def foo_sale(spark, key="TEGUCXAGDE"):
    return sales(spark, dict(transaction_id=key, description=" foo ", price_gross=16))


def foo_transaction(spark, key="TEGUCXAGDE"):
    return transactions(spark, dict(transaction_id=key, description=" foo ", amount=17, tip=1, fee=0.24))


def refund_case(spark, kind="Rückerstattung", refund=-19):
    late, early = f"{DAY}, 12:37", f"{DAY}, 12:27"
    sold = sales(
        spark,
        dict(transaction_id="R", payment="Bar", description="Hauptgang Vegi Standard", category="Mittagstisch",
             price_gross=13),
        dict(transaction_id="R", payment="Bar", description="Vorspeise/Dessert Standard", category="Mittagstisch",
             price_gross=6, quantity=2),
        dict(transaction_id="R", payment="Bar", description="", category="", price_gross=refund, kind=kind,
             sold_at=late, account=None, discount=None, tax=None),
        dict(transaction_id="K", payment="Visa - Debitkarte", description="Hauptgang Vegi Reduziert",
             category="Mittagstisch", price_gross=11, sold_at=early),
    )
    booked = transactions(
        spark,
        dict(transaction_id="R", booked_at=f"{ISO} 12:37:00", kind="Rückerstattung", status=None, amount=-19),
        dict(transaction_id="R", description="1 x Hauptgang", amount=19, tip=0, fee=0),
        dict(transaction_id="K", booked_at=f"{ISO} 12:27:00", description="1 x Hauptgang", amount=11, tip=0, fee=0.17),
    )
    return sold, booked


LABELLED = ["description", "price_gross", "commission", "topic", "owner", "purpose"]


def test_tip_and_commission_are_split(spark):
    out = prepare(foo_sale(spark), foo_transaction(spark)).orderBy("description")
    assert out.columns == S.INTERMEDIATE.names
    assert rows_of(out, *LABELLED) == [
        ("Trinkgeld", 1.0, 0.0141, "MiTi", "MiTi", "Tip"),
        ("foo", 16.0, 0.2259, "MiTi", "LoLa", "Consumption"),
    ]
    assert rows_of(out, "date", "time", "type", "payment_method", "quantity", "account", "comment") == [
        (dt.date(2023, 3, 24), "12:32:00", "Sales", "Card", 1, "a@b.ch", None)
    ] * 2


def test_commission_shares_add_up_to_the_fee(spark):
    total = prepare(foo_sale(spark), foo_transaction(spark)).agg(F.sum("commission")).first()[0]
    assert abs(float(total) - 0.24) < 0.0001


def test_last_shift_change_counts(spark):
    sold = sales(
        spark,
        dict(transaction_id="T1", payment="Bar", description="SCHICHTWECHSEL", category="Schichtwechsel",
             price_gross=0.01, sold_at=f"{DAY}, 12:27"),
        dict(transaction_id="T2", description="Kaffee", category="Heissgetränke", price_gross=3.5),
        dict(transaction_id="T3", payment="Bar", description="SCHICHTWECHSEL", category="Schichtwechsel",
             price_gross=0.01, sold_at=f"{DAY}, 12:37"),
    )
    booked = transactions(
        spark,
        dict(transaction_id="T1", booked_at=f"{ISO} 12:27:00", description="SCHICHTWECHSEL", amount=0.01, tip=0, fee=0),
        dict(transaction_id="T2", description="Kaffee", amount=3.5, tip=0, fee=0.05),
        dict(transaction_id="T3", booked_at=f"{ISO} 12:37:00", description="SCHICHTWECHSEL", amount=0.01, tip=0, fee=0),
    )
    out = prepare(sold, booked).orderBy("transaction_id")
    assert rows_of(out, *LABELLED, "payment_method") == [
        ("SCHICHTWECHSEL", 0.0, 0.0, "MiTi", "LoLa", "Consumption", "Cash"),
        ("Kaffee", 3.5, 0.05, "MiTi", "LoLa", "Consumption", "Card"),
        ("SCHICHTWECHSEL", 0.0, 0.0, "MiTi", "LoLa", "Consumption", "Cash"),
    ]
    by_order = payments.shift_changes(booked, F.when(F.col("transaction_id") == "T1", 2).otherwise(1))
    assert rows_of(payments.shift_changes(booked), "shift_change") == [("12:37:00",)]
    assert rows_of(by_order, "shift_change") == [("12:27:00",)]


def test_shift_change_window_and_weekend(spark):
    def mark(booked_at):
        return dict(transaction_id=booked_at, booked_at=booked_at, description="1 x SCHICHTWECHSEL")

    stamps = ["2023-03-24 12:00:00", "2023-03-24 16:00:00", "2023-03-25 13:00:00", "2023-03-27 12:00:01",
              "2023-03-28 15:59:59"]
    found = payments.shift_changes(transactions(spark, *[mark(s) for s in stamps])).orderBy("date")
    assert rows_of(found) == [(dt.date(2023, 3, 27), "12:00:01"), (dt.date(2023, 3, 28), "15:59:59")]


@pytest.mark.parametrize("kind", ["Refund", "Rückerstattung"])
def test_refunded_transactions_disappear(spark, kind):
    sold, booked = refund_case(spark, kind)
    assert reconcile.refund_violations(sold).count() == 0
    out = prepare(sold, booked)
    assert rows_of(out, "transaction_id", *LABELLED) == [
        ("K", "Hauptgang Vegi Reduziert", 11.0, 0.17, "MiTi", "MiTi", "Consumption")
    ]
    assert rows_of(reconcile.drop_refunded_sales(sold), "transaction_id") == [("K",)]
    assert rows_of(reconcile.drop_refunded_transactions(sold, booked), "transaction_id") == [("K",)]


def test_unbalanced_refund_is_reported(spark):
    sold, _ = refund_case(spark, refund=-20)
    assert rows_of(reconcile.refund_violations(sold)) == [("R", -1.0)]


def test_missing_transactions(spark):
    same, other = foo_sale(spark), foo_sale(spark, "other")
    booked, booked_other = foo_transaction(spark), foo_transaction(spark, "other")
    assert reconcile.reconcile(same, booked).count() == 0
    assert rows_of(reconcile.missing_in_sales(other, booked)) == [("TEGUCXAGDE", 1)]
    assert rows_of(reconcile.missing_in_transactions(same, booked_other)) == [("TEGUCXAGDE", 1)]
    both = reconcile.reconcile(other, booked).orderBy("transaction_id")
    assert rows_of(both) == [("TEGUCXAGDE", "sales", 1), ("other", "transactions", 1)]


def test_planned_counts_as_present_but_carries_no_fee(spark):
    booked = foo_transaction(spark).withColumn("status", F.lit("Geplant"))
    assert reconcile.reconcile(foo_sale(spark), booked).count() == 0
    assert rows_of(prepare(foo_sale(spark), booked), *LABELLED) == [
        ("foo", 16.0, None, "Culture", "LoLa", "Consumption")
    ]


def test_refund_without_id_removes_transactions_without_id(spark):
    sold = sales(spark, dict(transaction_id=None, description="x", price_gross=1, kind="Refund"),
                 dict(transaction_id="A", description="x", price_gross=1))
    booked = transactions(spark, dict(transaction_id=None, amount=1), dict(transaction_id="A", amount=1))
    assert rows_of(reconcile.drop_refunded_transactions(sold, booked), "transaction_id") == [("A",)]
    kept = reconcile.drop_refunded_sales(sold).orderBy("transaction_id")
    assert rows_of(kept, "transaction_id") == [(None,), ("A",)]
    assert prepare(sold, booked).count() == 2


def test_tip_grain(spark):
    sold = sales(spark, dict(transaction_id="A", description="x", category="one", price_gross=5),
                 dict(transaction_id="A", description="y", category="two", price_gross=5),
                 dict(transaction_id="A", description="z", category="two", price_gross=5))
    booked = transactions(spark, dict(transaction_id="A", amount=17, tip=2, fee=0.3))
    base = payments.commission_base(booked)
    assert payments.tip_lines(sold, base).count() == 2
    assert rows_of(payments.tip_lines(sold, base, "transaction"), "category", "price_net") == [("one", 2.0)]
    with pytest.raises(ValueError):
        payments.tip_lines(sold, base, "month")


def test_transaction_booked_twice_repeats_its_lines(spark):
    booked = foo_transaction(spark).unionByName(foo_transaction(spark))
    assert rows_of(reconcile.duplicate_transactions(booked)) == [("TEGUCXAGDE", 2)]
    assert prepare(foo_sale(spark), booked).count() == 4


def test_total_of_zero_gives_no_commission(spark):
    booked = transactions(spark, dict(transaction_id="TEGUCXAGDE", amount=0, tip=0, fee=0.1))
    assert rows_of(prepare(foo_sale(spark), booked), "commission") == [(None,)]


def test_normalize(spark):
    sold = sales(spark, dict(transaction_id="A", description="Nachmittag-Abend", price_gross=5),
                 dict(transaction_id="B", description="x", price_gross=5, price_net=None),
                 dict(transaction_id="C", description=None, price_gross=5, price_net=4))
    out = normalize.normalize_sales(sold).orderBy("transaction_id")
    assert rows_of(out, "price_gross", "price_net") == [(0.0, 0.0), (5.0, 5.0), (5.0, 4.0)]
    booked = transactions(spark, dict(transaction_id="A", amount=7), dict(transaction_id="B", amount=7, net=6))
    assert rows_of(normalize.normalize_transactions(booked).orderBy("transaction_id"), "net") == [(7.0,), (6.0,)]


def test_white_space_of_any_kind_is_trimmed(spark):
    sold = sales(spark, dict(transaction_id="TEGUCXAGDE", description=" \t SCHICHTWECHSEL \n", price_gross=5))
    out = prepare(sold, foo_transaction(spark).withColumn("tip", F.lit(0).cast(S.MONEY)))
    assert rows_of(out, "description", "price_gross", "price_net") == [("SCHICHTWECHSEL", 0.0, 0.0)]


def test_dates_and_times(spark):
    texts = spark.createDataFrame(
        [("24.03.2023, 12:32", "2023-03-24 12:32:59"), ("x24.03.2023, 1", "2023-03-24"), ("24.3.2023, 12:32", None)],
        "sold_at string, booked_at string",
    )
    out = texts.select(dates.sale_date(F.col("sold_at")), dates.booking_time(F.col("booked_at")))
    day = dt.date(2023, 3, 24)
    assert rows_of(out) == [(day, "12:32:59"), (day, None), (None, None)]
    with pytest.raises(Exception, match="31"):
        spark.range(1).select(dates.sale_date(F.lit("31.02.2023, 12:00"))).collect()
    bad = transactions(spark, dict(transaction_id="A", booked_at="2023-03-24 25:00:00"),
                       dict(transaction_id="B", booked_at="2023-03-24 23:59:59"))
    assert rows_of(payments.unreadable_times(bad), "transaction_id") == [("A",)]


# (description, time, shift change, weekend, category) -> topic
TOPIC_CASES = [
    *[("X", t, "14:15:00", False, "", "Culture") for t in ("00:00:00", "05:59:59")],
    *[("X", t, "14:15:00", False, "", "MiTi") for t in ("06:00:00", "14:15:00")],
    *[("X", t, "14:15:00", True, "", "Culture") for t in ("06:00:00", "14:15:00", "14:15:01", "17:59:59")],
    *[("X", t, "14:15:00", False, "", "Cafe") for t in ("14:15:01", "17:59:59")],
    ("X", "14:28:01", "14:29:00", False, "", "MiTi"),
    ("X", "14:30:00", "14:30:00", False, "", "MiTi"),
    *[("X", t, "14:15:00", True, "", "Culture") for t in ("18:00:00", "23:59:59")],
    *[("X (PO)", t, "14:15:00", False, "", "Culture") for t in ("00:00:00", "05:59:59")],
    ("X (PO) x", "18:00:00", "14:15:00", True, "", "Culture"),
    ("X (PO)", "23:59:59", "14:15:00", True, "", "Culture"),
    *[
        ("Recircle Tupper Depot", t, "14:15:00", weekend, "", "Packaging")
        for t, weekend in (
            ("00:00:00", False), ("05:59:59", False), ("06:00:00", False), ("14:15:00", False),
            ("14:15:01", False), ("17:59:59", True), ("18:00:00", True), ("23:59:59", False),
        )
    ],
    ("Miete", "00:00:00", "14:15:00", False, "", "Rental"),
    ("Miete", "12:00:00", "14:15:00", True, "", "Rental"),
    ("Kerze 4", "09:00:00", "14:15:00", False, "", "Culture"),
    ("Kerze 2", "14:00:00", "14:15:00", True, "", "Culture"),
    ("Kerze klein", "18:00:00", "14:15:00", False, "", "Culture"),
    ("X", "14:15:01", "14:15:00", False, "Mittagstisch", "MiTi"),
    ("X", "17:59:59", "14:15:00", False, "foo (PO)", "Culture"),
    ("X", None, "14:15:00", False, "", "Culture"),
    (None, "12:00:00", "14:15:00", False, None, "MiTi"),
]


def test_topics(spark):
    schema = ("nr int, description string, time string, shift_change string, is_weekend boolean, category string, "
              "expected string")
    cases = spark.createDataFrame([(i, *case) for i, case in enumerate(TOPIC_CASES)], schema)
    out = cases.selectExpr("nr", "expected", f"{labels.TOPIC} AS topic").collect()
    assert [(r.nr, r.topic) for r in out] == [(r.nr, r.expected) for r in out]


# (description, category, gross, topic) -> owner
OWNER_CASES = [
    ("foo", "Alkoholfrei", 3.5, "Cafe", None),
    ("bar", "Heissgetränke", 6, "Packaging", None),
    ("baz", "Schichtwechsel", 0.01, "Rental", None),
    ("Dessert", "Mittagstisch", 4, "MiTi", "MiTi"),
    ("Hauptgang Vegi Standard", "Mittagstisch", 13, "MiTi", "MiTi"),
    ("unbekannte bechreibung", "Mittagstisch", 17, "MiTi", "MiTi"),
    ("bar (PO)", "Kultur Essen (PO)", 4, "Culture", "PaidOut"),
    ("foo", "Any (PO)", 7, "Culture", "PaidOut"),
    ("foo (PO) x", "", 7, "Culture", "PaidOut"),
    ("foo (PO)", "", 7, "MiTi", "LoLa"),
    ("", "", 5, "MiTi", "MiTi"),
    ("  ", "", 4.99, "MiTi", "LoLa"),
    ("Vorsp. + Hauptsp. red.", "", 1, "MiTi", "MiTi"),
    ("Vorspx + Hauptsp", "", 1, "MiTi", "LoLa"),
    *[(word, "", 1, "MiTi", "MiTi") for word in labels.KITCHEN_WORDS],
    *[(word, "", 1, "Culture", "LoLa") for word in labels.KITCHEN_WORDS],
]


def test_owners(spark):
    schema = "nr int, description string, category string, price_gross double, topic string, expected string"
    cases = spark.createDataFrame([(i, *c[:2], float(c[2]), *c[3:]) for i, c in enumerate(OWNER_CASES)], schema)
    priced = cases.withColumn("price_gross", F.col("price_gross").cast(S.MONEY))
    out = priced.selectExpr("nr", "expected", f"{labels.OWNER} AS owner").collect()
    assert [(r.nr, r.owner) for r in out] == [(r.nr, r.expected) for r in out]


def test_overrides_and_added_rows(spark):
    prepared = prepare(foo_sale(spark), foo_transaction(spark))
    edits = spark.createDataFrame(
        [("TEGUCXAGDE", "foo", "Verm", None, "Consumption", "party")],
        "transaction_id string, description string, topic string, owner string, purpose string, comment string",
    )
    out = apply_overrides(prepared, edits).orderBy("description")
    assert rows_of(out, "description", "topic", "owner", "comment") == [
        ("Trinkgeld", "MiTi", "MiTi", None), ("foo", "Verm", None, "party"),
    ]
    cash = frame(spark, S.INTERMEDIATE, [dict(date=ISO, payment_method="Cash", price_net=5, topic="Cafe")])
    assert add_rows(out, cash).count() == 3
