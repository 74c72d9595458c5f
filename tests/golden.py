"""Hand-made intermediate rows and the figures expected from them."""

from __future__ import annotations

D1, D2, D3, LAST = "2023-03-24", "2023-03-25", "2023-03-26", "2023-03-31"


def row(date, method, description, net, commission, topic, owner, quantity=1, purpose="Consumption"):
    return dict(
        account="a@b.ch", date=date, time="12:32:00", type="Sales", transaction_id="T", payment_method=method,
        quantity=quantity, description=description, currency="CHF", price_gross=net, price_net=net,
        commission=commission, topic=topic, owner=owner, purpose=purpose,
    )


MIXED_DAY = [
    row(D1, "Card", "Hauptgang, normal", 16, 0.2412, "MiTi", "MiTi"),
    row(D1, "Cash", "Kaffee", 3.5, 0, "MiTi", "LoLa"),
    row(D1, "Card", "Cappuccino", 20, 0.3, "MiTi", "LoLa", quantity=4),
    row(D1, "Card", "Schlüsseldepot", 100, 1.5, "Deposit", ""),
    row(D1, "Card", "Kulturevent", 400, 6, "Culture", "LoLa"),
    row(D1, "Card", "Rental fee", 500, 7.5, "Rental", ""),
    row(D1, "Card", "Sold by renter, paid out in cash", 100, 1.5, "Culture", "PaidOut"),
    row(D1, "Cash", "SoFe 1", 10, 0, "SoFe", ""),
    row(D1, "Card", "SoFe 2", 20, 0.3, "SoFe", ""),
    row(D1, "Card", "Recircle Tupper Depot", 10, 0.15, "Packaging", ""),
    row(D1, "Cash", "Recircle Tupper Depot", 20, 0, "Packaging", ""),
    row(D1, "Cash", "Hauptgang Fleisch  Reduziert", 13, 0, "MiTi", "MiTi"),
]

# Every measure that is not null; the rest of the 75 is null.
MIXED_DAY_DETAILS = dict(
    su_cash=46.5, su_card=1166, su_total=1212.5, su_tips=0, miti_cash=16.5, miti_card=36, miti_total=52.5,
    cafe_total=0, culture_card=500, culture_total=500, culture_lola_card=400, culture_lola_total=400,
    culture_paidout_card=100, culture_paidout_total=100, verm_total=0, packaging_cash=20, packaging_card=10,
    packaging_total=30, deposit_card=100, deposit_total=100, rental_card=500, rental_total=500, sofe_cash=10,
    sofe_card=20, sofe_total=30, gross_cash=46.5, sumup_cash=46.5, gross_card=1166, sumup_card=1166,
    gross_total=1212.5, tips_total=0, sumup_total=1212.5, gross_card_miti=36, miti_commission=0.24,
    net_card_miti=35.76, gross_card_lola=1130, lola_commission=17.25, lola_commission_miti=0.3, net_card_lola=1112.75,
    gross_card_total=1166, total_commission=17.49, net_card_total=1148.51, net_payment_sumup_miti=35.46,
    gross_miti_miti=29, gross_miti_lola=23.5, gross_miti_miti_card=16, net_miti_miti_card=15.76, net_miti_lola=23.2,
    contribution_miti=4.64, share_lola=18.56, sponsored_reductions=2, debt_to_miti=18.9, income_lola_miti=18.86,
    paidout_sumup=1148.51, meal_count_regular=1, meal_count_reduced=1,
)

THREE_DAYS = [
    row(D1, "Cash", "foo", 489.1, 0, "Culture", "LoLa"),
    row(D2, "Card", "Kindermenü", 20, 0.3, "MiTi", "MiTi", quantity=3),
    row(D3, "Cash", "Hauptgang Vegi Praktikum", 11, 0, "MiTi", "MiTi"),
]

# measure -> values of the three days and the total row
THREE_DAYS_DETAILS = dict(
    su_cash=(489.1, 0, 11, 500.1), su_card=(0, 20, 0, 20), su_total=(489.1, 20, 11, 520.1),
    miti_cash=(None, None, 11, 11), miti_card=(None, 20, None, 20), miti_total=(0, 20, 11, 31),
    cafe_cash=(None, None, None, 0), cafe_total=(0, 0, 0, 0), culture_cash=(489.1, None, None, 489.1),
    culture_lola_cash=(489.1, None, None, 489.1), culture_lola_total=(489.1, 0, 0, 489.1),
    gross_cash=(489.1, 0, 11, 500.1), gross_card=(0, 20, 0, 20), tips_cash=(None, None, None, 0),
    miti_commission=(None, 0.3, 0, 0.3), net_card_miti=(0, 19.7, 0, 19.7), lola_commission=(0, None, None, 0),
    lola_commission_miti=(None, None, None, 0), total_commission=(0, 0.3, 0, 0.3), net_card_total=(0, 19.7, 0, 19.7),
    net_payment_sumup_miti=(0, 19.7, 0, 19.7), gross_miti_miti=(None, 20, 11, 31),
    gross_miti_lola=(None, None, None, 0), gross_miti_miti_card=(None, 20, None, 20),
    net_miti_miti_card=(0, 19.7, 0, 19.7), sponsored_reductions=(0, 0, 2, 2), debt_to_miti=(0, 19.7, 2, 21.7),
    paidout_sumup=(0, 19.7, 0, 19.7), meal_count_regular=(None, None, None, 0),
    meal_count_children=(None, 3, None, 3), meal_count_praktikum=(None, None, 1, 1),
    total_praktikum=(None, None, 11, 11),
)


def two_days(topic, owner, texts):
    return [
        row(D1, "Cash", "Hauptgang Vegi Standard", 13, 0, "MiTi", "MiTi"),
        row(D1, "Card", texts[0], 400, 6, topic, owner),
        row(D1, "Cash", texts[1], 600, 0, topic, owner),
        row(D2, "Cash", texts[2], 100, 0, topic, owner),
        row(D2, "Card", texts[3], 200, 3, topic, owner),
    ]


RENTALS = two_days("Rental", "", ["Rental A", "Rental B", "Rental C", "Rental D"])
PARTNERS = two_days("Culture", "PaidOut", ["Buffet 1 (PO)", "Buffet 1 (PO)", "Buffet 2 (PO)", "Buffet 2 (PO)"])

# One row of details as input for the reports built from it.
DETAILS = dict(
    su_cash=289, su_card=1354, su_total=1643, su_tips=5, miti_cash=123, miti_card=191, miti_total=314, cafe_cash=29.5,
    cafe_card=20, cafe_total=49.5, culture_cash=0, culture_card=500, culture_total=500, culture_lola_cash=0,
    culture_lola_card=400, culture_lola_total=400, culture_paidout_cash=0, culture_paidout_card=100,
    culture_paidout_total=100, verm_cash=102.5, verm_card=12, verm_total=114.5, packaging_cash=20, packaging_card=10,
    packaging_total=30, deposit_cash=0, deposit_card=100, deposit_total=100, rental_cash=0, rental_card=500,
    rental_total=500, sofe_cash=10, sofe_card=20, sofe_total=30, gross_cash=685, tips_cash=4, sumup_cash=289,
    gross_card=1353, tips_card=1, gross_total=1628, tips_total=5, sumup_total=1643, gross_card_miti=191,
    miti_commission=2.75, net_card_miti=188.25, gross_card_lola=1162, lola_commission=17.99,
    lola_commission_miti=0.44, net_card_lola=1144.01, gross_card_total=1353, total_commission=20.24,
    net_card_total=1412.76, net_payment_sumup_miti=187.81, miti_tips_cash=0.5, miti_tips_card=1, miti_tips=1.5,
    cafe_tips=3.5, verm_tips=0, gross_miti_miti=261, gross_miti_lola=53, gross_miti_miti_card=167,
    net_miti_miti_card=164.25, net_miti_lola=52.56, contribution_miti=10.51, share_lola=42.05,
    sponsored_reductions=2, debt_to_miti=147.76, income_lola_miti=42.49, paidout_sumup=1413.76,
    meal_count_regular=14, meal_count_reduced=0, meal_count_children=1, meal_count_praktikum=1, total_praktikum=11,
)

PARTNER = dict(
    hauptgang=14, reduziert=1, kind=1, kueche=261, total_bar=53, anteil_lola=42.4, anteil_miti=10.6,
    einnahmen_bar=123.5, davon_tg_bar=0.5, einnahmen_karte=192, davon_tg_karte=1, total_einnahmen=314,
    kommission_bar=0.44, netto_bar=52.56, karte_miti=167, kommission_miti=2.75, netto_karte_miti=164.25,
    net_total_karte=187.81, verkauf_lola=-42.05, gesponsort=2, ueberweisung=147.76,
)

ACCOUNTING = dict(
    payment_sumup=1413.76, total_cash_debit=462, total_card_debit=1162, p10000_23050=0, p10000_30200=29.5,
    p10000_30700=102.5, p10000_30810=10, p10000_31000=0, p10000_32000=0, p10000_46000=20, p10000_20121=0,
    p10920_20121=100, p20121_10000=100, p10920_23050=100, p10920_30200=20, p10920_30700=12, p10920_30810=20,
    p10920_31000=500, p10920_32000=400, p10920_46000=10, p10920_20051=189.25, p10920_10910=0, p68450_10920=17.99,
    p59991_20051=2, p59991_20120=11, p20051_10930=147.76, p20051_30500=42.49, p10930_10100=147.76,
)

# A balanced accounting row: account 10920, 20121 and 20051 net to zero.
BALANCED = dict(
    payment_sumup=1334.26, total_cash_debit=552, total_card_debit=1162, p10000_30200=0, p10000_30700=0,
    p10000_30810=10, p10000_23050=20, p10000_31000=0, p10000_46000=0, p10000_32000=0, p10920_30200=20,
    p10920_30700=12, p10920_30810=20, p10920_23050=10, p10920_31000=100, p10920_46000=500, p10920_32000=400,
    p10000_20121=0, p10920_20121=100, p20121_10000=100, p10920_20051=189.25, p10920_10910=1, p68450_10920=17.99,
    p59991_20051=2, p59991_20120=0, p20051_10930=148.76, p20051_30500=42.49, p10930_10100=148.76,
)
