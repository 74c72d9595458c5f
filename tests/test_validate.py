"""Checks on the intermediate table."""

from __future__ import annotations

from conftest import frame, rows_of

from salesledger import schema as S
from salesledger.operators import validate

# field, value, is it allowed?
VALUE_CASES = [
    *[("payment_method", v, ok) for v, ok in (("Cash", True), ("Card", True), ("", False), ("Cash ", False),
                                              (" Card", False), ("xyz", False), (None, False))],
    *[("topic", v, True) for v in S.TOPICS],
    *[("topic", v, False) for v in ("PaidOut", "", "Vermiet", "xyz", None)],
    *[("owner", v, ok) for v, ok in (("LoLa", True), ("MiTi", True), ("PaidOut", True), ("", True), (None, True),
                                     ("miti", False), ("XX", False))],
    *[("purpose", v, ok) for v, ok in (("Consumption", True), ("Tip", True), ("", False), ("XX", False))],
]

# topic, owner, broken rule
OWNER_CASES = [
    ("MiTi", "LoLa", None), ("MiTi", "MiTi", None), ("Culture", "LoLa", None), ("Culture", "PaidOut", None),
    ("Cafe", "", None), ("Verm", "", None), ("Verm", None, None), ("SoFe", None, None), ("Deposit", None, None),
    ("Rental", None, None), ("Packaging", None, None),
    ("MiTi", "", "miti_without_owner"), ("MiTi", None, "miti_without_owner"),
    ("Culture", "", "culture_without_owner"), ("Culture", None, "culture_without_owner"),
    ("Cafe", "Cafe", "owner_not_allowed"), ("Verm", "MiTi", "owner_not_allowed"), ("SoFe", "LoLa", "owner_not_allowed"),
    ("Deposit", "LoLa", "owner_not_allowed"), ("Rental", "LoLa", "owner_not_allowed"),
    ("Packaging", "LoLa", "owner_not_allowed"),
]


def test_allowed_values(spark):
    for field in validate.ALLOWED:
        cases = [(v, ok) for f, v, ok in VALUE_CASES if f == field]
        df = frame(spark, S.INTERMEDIATE, [{"transaction_id": str(i), field: v} for i, (v, _) in enumerate(cases)])
        found = {int(r.transaction_id) for r in validate.invalid_values(df, field).collect()}
        assert found == {i for i, (_, ok) in enumerate(cases) if not ok}, field


def test_owner_rules(spark):
    data = [dict(transaction_id=str(i), topic=t, owner=o) for i, (t, o, _) in enumerate(OWNER_CASES)]
    found = validate.topic_owner_violations(frame(spark, S.INTERMEDIATE, data)).collect()
    expected = {(str(i), rule) for i, (_, _, rule) in enumerate(OWNER_CASES) if rule}
    assert {(r.transaction_id, r.rule) for r in found} == expected


def test_all_checks_in_one_scan(spark):
    good = dict(transaction_id="ok", date="2023-04-17", topic="Cafe", payment_method="Cash", purpose="Tip")
    bad = dict(transaction_id="bad", topic="x", owner="y", payment_method=None, purpose="")
    df = validate.violations(frame(spark, S.INTERMEDIATE, [good, bad]))
    assert {(r.transaction_id, r.rule) for r in df.collect()} == {
        ("bad", rule)
        for rule in ("invalid_topic", "invalid_owner", "invalid_payment_method", "invalid_purpose",
                     "owner_not_allowed", "missing_date")
    }


def test_rows_without_price(spark):
    data = [
        dict(description="a", price_net=0), dict(description="b"), dict(description="c", price_net=1),
        dict(description="SCHICHTWECHSEL", price_net=0), dict(description="Nachmittag-Abend"), dict(price_net=0),
    ]
    out = validate.zero_value_rows(frame(spark, S.INTERMEDIATE, data))
    assert sorted(r.description for r in out.collect()) == ["a", "b"]


def test_hints(spark):
    data = [
        dict(date="2023-03-24", topic="MiTi", owner="PaidOut", purpose="Tip", price_net=2),
        dict(date="2023-03-24", topic="Culture", owner="MiTi", purpose="Tip", price_net=3),
        dict(date="2023-03-25", topic="Rental", purpose="Tip", price_net=4),
        dict(date="2023-03-26", topic="Rental", purpose="Consumption", price_net=5),
    ]
    df = frame(spark, S.INTERMEDIATE, data)
    assert validate.unusual_owners(df).count() == 2
    tips = validate.tips_in_detail_postings(df).orderBy("date")
    assert [amount for _, amount in rows_of(tips)] == [2.0, 4.0]
