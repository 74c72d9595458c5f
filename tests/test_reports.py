"""Key figures, derived measures, total rows, reports and postings against hand-computed values."""

from __future__ import annotations

import datetime as dt

import golden as G
import pytest
from conftest import frame, rows_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesledger import schema as S
from salesledger.functions import labels
from salesledger.operators import keyfigures, measures, postings, reports
from salesledger.plans import export
from verification.naive import daily_key_figures_by_joins


def intermediate(spark, rows):
    return frame(spark, S.INTERMEDIATE, rows)


def details(spark, rows):
    return measures.details_report(keyfigures.daily_key_figures(intermediate(spark, rows)))


def money_frame(spark, names, rows, **keys):
    counts = set(S.COUNT_MEASURES)
    fields = [T.StructField("month", T.StringType()), T.StructField("date", T.DateType())]
    fields.append(T.StructField("is_total", T.BooleanType()))
    fields += [T.StructField(n, T.LongType() if n in counts else S.MONEY) for n in names]
    return frame(spark, T.StructType(fields), rows, **{"month": "202303", "is_total": False, **keys})


def values(df, names):
    return [dict(zip(names, row)) for row in rows_of(df, *names)]


def test_mixed_day(spark):
    names = [n for n in S.DETAILS_REPORT if n != "date"]
    (got,) = values(details(spark, G.MIXED_DAY), names)
    assert {n: v for n, v in got.items() if v is not None} == G.MIXED_DAY_DETAILS
    assert len(S.DETAILS_REPORT) == 76


def test_days_and_total_row(spark):
    out = measures.with_total_rows(details(spark, G.THREE_DAYS)).orderBy(F.col("date").asc_nulls_last())
    assert rows_of(out, "date", "is_total", "month") == [
        *[(dt.date.fromisoformat(d), False, "202303") for d in (G.D1, G.D2, G.D3)], (None, True, "202303"),
    ]
    names = [n for n in S.DETAILS_REPORT if n != "date"]
    got = values(out, names)
    for name, expected in G.THREE_DAYS_DETAILS.items():
        assert tuple(row[name] for row in got) == expected, name
    assert all(v is not None for v in got[3].values())


def test_each_month_has_its_own_total(spark):
    later = [{**r, "date": "2023-04-02"} for r in G.THREE_DAYS]
    out = measures.with_total_rows(details(spark, G.THREE_DAYS + later)).where("is_total")
    assert sorted(rows_of(out, "month", "su_total")) == [("202303", 520.1), ("202304", 520.1)]


def test_figure_is_zero_without_price_and_null_without_row(spark):
    data = [
        dict(date="2023-03-16", topic="Cafe", payment_method="Card", purpose="Consumption"),
        dict(date="2023-03-14", topic="Cafe", payment_method="Card", purpose="Consumption", price_net=1.3),
        dict(date="2023-03-14", topic="Cafe", payment_method="Cash", purpose="Tip", price_net=0.5),
        dict(date="2023-03-20", topic="Cafe", payment_method="Cash", purpose="Consumption", price_net=4.7),
        dict(date="2023-03-20", topic="Deposit", payment_method="Card", purpose="Consumption", price_net=100),
        dict(date="2023-03-25", topic="SoFe", payment_method="Cash", purpose="Consumption", price_net=10),
        dict(date="2023-03-26", topic="strange", payment_method="Card", purpose=None, price_net=10, commission=1),
        dict(date=None, topic="SoFe", payment_method="Cash", purpose="Consumption", price_net=10),
    ]
    out = keyfigures.daily_key_figures(intermediate(spark, data)).orderBy("date")
    got = rows_of(out, "cafe_card", "cafe_cash", "cafe_tips", "deposit_card", "sofe_cash", "lola_commission")
    assert got == [
        (1.3, None, 0.5, None, None, 0.0),
        (0.0, None, None, None, None, 0.0),
        (None, 4.7, None, 100.0, None, 0.0),
        (None, None, None, None, 10.0, 0.0),
        (None, None, None, None, None, 1.0),
    ]


def test_one_aggregate_equals_a_join_per_figure(spark):
    rows = intermediate(spark, G.MIXED_DAY + G.THREE_DAYS + G.RENTALS + G.PARTNERS)
    figures = keyfigures.FIGURES + keyfigures.UNREPORTED
    once = keyfigures.daily_key_figures(rows, figures)
    joined = daily_key_figures_by_joins(rows, figures).select(once.columns)
    assert once.exceptAll(joined).count() == 0 and joined.exceptAll(once).count() == 0


MEALS = {
    "regular": [
        "Menü", "Menü ganz", "Hauptgang", "Praktika", "Vorsp.+Hauptspeise", "Vorsp. + Hauptsp. red.",
        "Hauptspeise spezial", "Hauptsp. + Dessert", "Nur Hauptgang", "Menu (nur Hauptgang)",
        "2-Gang-Menu (mit Vorspeise oder Dessert)", "3 Gang-Menu (mit Vorspeise + Dessert)", "Seniorenmittagstisch",
        "Senioren-Mittagstisch", "Hauptgang Vegi Standard", "Hauptgang Fleisch  Standard",
    ],
    "reduced": ["Hauptgang Vegi Reduziert", "Hauptgang Fleisch  Reduziert"],
    "praktikum": ["Hauptgang Vegi Praktikum", "Hauptgang Fleisch  Praktikum"],
    "children": [
        "Kindermenü", "Kinderpasta", "Kinder-Teigwaren", "Kindermenu (kleiner Hauptgang, bis 12 Jahre)",
        "Hauptgang Vegi Kindermenu (bis 12 Jahre)", "Kinderpasta  Standard",
    ],
}


@pytest.mark.parametrize("kind", labels.MEAL_TYPES)
def test_meals(spark, kind):
    names = [(text, k) for k, texts in MEALS.items() for text in texts]
    df = spark.createDataFrame(names, "description string, kind string")
    found = df.where(labels.MEALS[kind]).collect()
    assert {(r.description, r.kind) for r in found} == {n for n in names if n[1] == kind}


def test_tips_and_lola_sales_are_no_meals(spark):
    rows = [
        G.row(G.D1, "Cash", "Menü", 5, 0, "MiTi", "MiTi", purpose="Tip"),
        G.row(G.D1, "Cash", "Menü", 5, 0, "MiTi", "LoLa"),
        G.row(G.D1, "Cash", "Menü", 5, 0, "Cafe", ""),
    ]
    out = keyfigures.daily_key_figures(intermediate(spark, rows), keyfigures.MEAL_FIGURES)
    assert rows_of(out.drop("month", "date")) == [(None,) * 5]


def test_partner_and_accounting_report(spark):
    names = [n for n in S.DETAILS_REPORT if n not in ("date", "sumup_card")]
    given = money_frame(spark, names, [{"date": G.D1, **G.DETAILS}])
    assert values(reports.partner_report(given), list(G.PARTNER)) == [G.PARTNER]
    assert values(reports.accounting_report(given), list(G.ACCOUNTING)) == [G.ACCOUNTING]
    shown = reports.named(reports.partner_report(given), S.PARTNER_REPORT)
    assert shown.columns[2:] == list(S.PARTNER_REPORT.values())


POSTING_NAMES = [n for n in S.ACCOUNTING_REPORT if n != "date"]

# changed columns -> expected (account, net, severity)
BALANCE_CASES = [
    ({}, None),
    *[
        ({name: G.BALANCED[name] + delta}, None)
        for name in ("p10920_30200", "p10920_30700", "p10920_30810", "p10920_23050", "p10920_31000", "p10920_46000",
                     "p10920_32000")
        for delta in (0.05, -0.05)
    ],
    *[({"p20051_30500": 42.49 + delta}, None) for delta in (0.05, -0.05)],
    *[
        ({name: G.BALANCED[name] + delta}, ("10920", delta, "error"))
        for name in ("p10920_30200", "p10920_30700", "p10920_30810", "p10920_23050", "p10920_31000", "p10920_46000",
                     "p10920_32000")
        for delta in (0.1, -0.06)
    ],
    ({"payment_sumup": 1334.16}, ("10920", 0.1, "error")),
    ({"p68450_10920": 17.93}, ("10920", 0.06, "error")),
    ({"p10000_20121": 0.06}, ("20121", 0.06, "error")),
    ({"p20121_10000": 100.06}, ("20121", -0.06, "error")),
    ({"p20051_10930": 148.70}, ("20051", 0.06, "info")),
    ({"p20051_30500": 42.43}, ("20051", 0.06, "info")),
    ({"p20051_30500": 42.55}, ("20051", -0.06, "info")),
    ({"p10920_30200": None, "p20121_10000": None, "p59991_20051": None}, None),
]


def test_balances(spark):
    data = [{**G.BALANCED, **change, "month": str(i), "date": G.D1} for i, (change, _) in enumerate(BALANCE_CASES)]
    rounded = [{k: round(v, 2) if isinstance(v, float) else v for k, v in row.items()} for row in data]
    found = postings.balance_violations(money_frame(spark, POSTING_NAMES, rounded))
    got = {int(m): (a, n, s) for m, a, n, s in rows_of(found, "month", "account", "net", "severity")}
    expected = {
        i: (case[0], pytest.approx(case[1]), case[2]) for i, (_, case) in enumerate(BALANCE_CASES) if case is not None
    }
    assert got == expected


def test_rounding_correction(spark):
    data = [
        {**G.BALANCED, "p20051_30500": 42.46, "month": "202411"},
        {**G.BALANCED, "p20051_30500": 42.51, "month": "202502"},
        {**G.BALANCED, "month": "202412"},
        {**G.BALANCED, "p20051_30500": 42.4, "month": "202501", "is_total": False},
    ]
    out = postings.rounding_correction(money_frame(spark, POSTING_NAMES, data, is_total=True)).orderBy("datum")
    text = "SU Rundungskorrektur 20051"
    assert rows_of(out, "datum", "beleg", "beschreibung", "kt_soll", "kt_haben", "betrag_chf") == [
        (dt.date(2024, 11, 30), None, text, "20051", "68450", 0.03),
        (dt.date(2025, 2, 28), None, text, "68450", "20051", 0.02),
    ]


LEDGER = ["datum", "beschreibung", "kt_soll", "kt_haben", "betrag_chf"]


def dated(rows):
    return sorted((dt.date.fromisoformat(d), *rest) for d, *rest in rows)


def test_rentals_replace_their_summary(spark):
    rows = intermediate(spark, G.RENTALS)
    posted = export.accounting(rows)
    assert sorted(rows_of(postings.posting_summary(posted), *LEDGER)) == dated(
        [
            (G.LAST, "SU Vermietungen bar", "10000", "31000", 700.0),
            (G.LAST, "SU Vermietungen Karte", "10920", "31000", 600.0),
            (G.LAST, "SU Kartenkommission", "68450", "10920", 9.0),
        ]
    )
    assert sorted(rows_of(postings.ledger(posted, rows), *LEDGER)) == dated(
        [
            (G.D1, "Rental A", "10920", "31000", 400.0),
            (G.D1, "Rental B", "10000", "31000", 600.0),
            (G.D2, "Rental C", "10000", "31000", 100.0),
            (G.D2, "Rental D", "10920", "31000", 200.0),
            (G.LAST, "SU Kartenkommission", "68450", "10920", 9.0),
        ]
    )


def test_partner_sales_are_posted_by_day(spark):
    rows = intermediate(spark, G.PARTNERS)
    posted = export.accounting(rows)
    daily = posted.where("NOT is_total").orderBy("date")
    assert rows_of(daily, "total_cash_debit", "p10000_20121", "p10920_20121", "p20121_10000") == [
        (-400.0, 600.0, 400.0, 1000.0), (-200.0, 100.0, 200.0, 300.0),
    ]
    assert sorted(rows_of(postings.posting_summary(posted), *LEDGER)) == dated(
        [
            (G.LAST, "SU Kooperation bar", "10000", "20121", 700.0),
            (G.LAST, "SU Kooperation Karte", "10920", "20121", 600.0),
            (G.LAST, "SU Kooperation Ausbezahlt", "20121", "10000", 1300.0),
            (G.LAST, "SU Kartenkommission", "68450", "10920", 9.0),
        ]
    )
    assert sorted(rows_of(postings.ledger(posted, rows), *LEDGER)) == dated(
        [
            (G.D1, "SU Kooperation Ausbezahlt", "20121", "10000", 1000.0),
            (G.D1, "SU Kooperation Karte", "10920", "20121", 400.0),
            (G.D1, "SU Kooperation bar", "10000", "20121", 600.0),
            (G.D2, "SU Kooperation Ausbezahlt", "20121", "10000", 300.0),
            (G.D2, "SU Kooperation Karte", "10920", "20121", 200.0),
            (G.D2, "SU Kooperation bar", "10000", "20121", 100.0),
            (G.LAST, "SU Kartenkommission", "68450", "10920", 9.0),
        ]
    )


def test_month_without_details_keeps_its_summary(spark):
    other_month = [{**r, "date": "2023-04-03"} for r in G.MIXED_DAY if r["topic"] == "SoFe"]
    rows = intermediate(spark, G.RENTALS + other_month)
    april = postings.ledger(export.accounting(rows), rows).where("month = '202304'")
    texts = sorted(r.beschreibung for r in april.collect())
    assert texts == ["SU Kartenkommission", "SU Sommerfest Karte", "SU Sommerfest bar"]


def test_payment_to_partner_has_no_date(spark):
    posted = export.accounting(intermediate(spark, G.THREE_DAYS))
    out = postings.posting_summary(posted).where("kt_soll = '10930'")
    assert rows_of(out, *LEDGER) == [(None, "SU Überweisung an MiTi", "10930", "10100", 21.7)]


def test_all_reports_run_on_a_mixed_day(spark):
    rows = intermediate(spark, G.MIXED_DAY)
    made = export.reports(export.details_with_totals(rows), rows)
    assert [made.details.count(), made.partner.count(), made.accounting.count()] == [2, 2, 2]
    assert made.ledger.count() > 0
    assert export.partner_transactions(intermediate(spark, G.MIXED_DAY)).count() == 4
