"""Schemas, allowed values and column names of the tables.

Inside the library every column has a snake_case name. The names used in files and reports, many with
blanks, slashes and brackets, appear only in the mappings below and are applied when reading or writing.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
FINE_MONEY = T.DecimalType(18, 4)

# --- fixed values: allowed values of the label columns ---------------------------------------------
PAYMENT_METHODS = ["Cash", "Card"]
TOPICS = ["MiTi", "Cafe", "Verm", "SoFe", "Deposit", "Rental", "Culture", "Packaging"]
OWNERS = ["LoLa", "MiTi", "PaidOut"]
PURPOSES = ["Consumption", "Tip"]
RECORD_TYPES = ["Sales", "Refund"]

# --- fixed values: texts found in the exports of the till --------------------------------------------
REFUND_KINDS = ["Rückerstattung", "Refund"]
SALE_KIND = "Verkauf"
CASH_PAYMENT = "Bar"
REVENUE_KIND = "Umsatz"
STATUS_DONE = "Erfolgreich"
STATUS_PLANNED = "Geplant"
SHIFT_CHANGE = "SCHICHTWECHSEL"
SHIFT_DESCRIPTIONS = ["SCHICHTWECHSEL", "Mittagstisch-Nachmittag", "Nachmittag-Abend"]
TIP_DESCRIPTION = "Trinkgeld"

# --- fixed values: file column -> (internal name, type) ------------------------------------------------------------
SALES_COLUMNS = {
    "Datum": ("sold_at", T.StringType()),
    "Typ": ("kind", T.StringType()),
    "Transaktionsnummer": ("transaction_id", T.StringType()),
    "Zahlungsmethode": ("payment", T.StringType()),
    "Menge": ("quantity", T.LongType()),
    "Beschreibung": ("description", T.StringType()),
    "Category": ("category", T.StringType()),
    "Sku": ("sku", T.StringType()),
    "Währung": ("currency", T.StringType()),
    "Preis vor Rabatt": ("list_price", MONEY),
    "Rabatt": ("discount", MONEY),
    "Preis (brutto)": ("price_gross", MONEY),
    "Preis (netto)": ("price_net", MONEY),
    "Steuer": ("tax", MONEY),
    "Steuersatz": ("tax_rate", T.StringType()),
    "Konto": ("account", T.StringType()),
}

TRANSACTION_COLUMNS = {
    "Datum": ("booked_at", T.StringType()),
    "Transaktions-ID": ("transaction_id", T.StringType()),
    "Transaktionsart": ("kind", T.StringType()),
    "Status": ("status", T.StringType()),
    "Beschreibung": ("description", T.StringType()),
    "Betrag inkl. MwSt.": ("amount", MONEY),
    "Trinkgeldbetrag": ("tip", MONEY),
    "Gebühr": ("fee", MONEY),
    "Netto": ("net", MONEY),
}

INTERMEDIATE_COLUMNS = {
    "Account": ("account", T.StringType()),
    "Date": ("date", T.DateType()),
    "Time": ("time", T.StringType()),
    "Type": ("type", T.StringType()),
    "Transaction ID": ("transaction_id", T.StringType()),
    "Payment Method": ("payment_method", T.StringType()),
    "Quantity": ("quantity", T.LongType()),
    "Description": ("description", T.StringType()),
    "Currency": ("currency", T.StringType()),
    "Price (Gross)": ("price_gross", MONEY),
    "Price (Net)": ("price_net", MONEY),
    "Commission": ("commission", FINE_MONEY),
    "Topic": ("topic", T.StringType()),
    "Owner": ("owner", T.StringType()),
    "Purpose": ("purpose", T.StringType()),
    "Comment": ("comment", T.StringType()),
}

JOURNAL_COLUMNS = {
    "Date": ("date", T.DateType()),
    "Description": ("description", T.StringType()),
    "Debit": ("debit", T.StringType()),
    "Credit": ("credit", T.StringType()),
    "Amount": ("amount", MONEY),
}


def _struct(columns: dict) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.values()])


SALES = _struct(SALES_COLUMNS)
TRANSACTIONS = _struct(TRANSACTION_COLUMNS)
INTERMEDIATE = _struct(INTERMEDIATE_COLUMNS)
JOURNAL = _struct(JOURNAL_COLUMNS)
STORED_INTERMEDIATE = T.StructType([*INTERMEDIATE.fields, T.StructField("month", T.StringType())])
PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])
"""Where a row stood in the file it was read from."""

STORED_SITES = T.StructType([*INTERMEDIATE.fields, *[T.StructField(n, T.StringType()) for n in ("site", "month")]])

POST = T.StructType(
    [
        T.StructField("post_key", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("sort", T.IntegerType()),
        T.StructField("factor", T.IntegerType()),
    ]
)
POST_ACCOUNT = T.StructType(
    [
        T.StructField("post_key", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("account", T.StringType()),
    ]
)
POST_BUDGET = T.StructType(
    [
        T.StructField("year", T.StringType()),
        T.StructField("post_key", T.StringType()),
        T.StructField("amount", MONEY),
    ]
)

# --- fixed values: columns of the details report, internal name -> report name -----------------------
DETAILS_REPORT = {
    "date": "Date",
    "su_cash": "SU Cash",
    "su_card": "SU Card",
    "su_total": "SU Total",
    "su_tips": "SU Tips",
    "miti_cash": "MiTi_Cash",
    "miti_card": "MiTi_Card",
    "miti_total": "MiTi Total",
    "cafe_cash": "Cafe_Cash",
    "cafe_card": "Cafe_Card",
    "cafe_total": "Cafe Total",
    "culture_cash": "Culture_Cash",
    "culture_card": "Culture_Card",
    "culture_total": "Culture Total",
    "culture_lola_cash": "Culture (LoLa) Cash",
    "culture_lola_card": "Culture (LoLa) Card",
    "culture_lola_total": "Culture (LoLa) Total",
    "culture_paidout_cash": "Culture (PaidOut) Cash",
    "culture_paidout_card": "Culture (PaidOut) Card",
    "culture_paidout_total": "Culture (PaidOut) Total",
    "verm_cash": "Verm_Cash",
    "verm_card": "Verm_Card",
    "verm_total": "Verm Total",
    "packaging_cash": "Packaging_Cash",
    "packaging_card": "Packaging_Card",
    "packaging_total": "Packaging Total",
    "deposit_cash": "Deposit_Cash",
    "deposit_card": "Deposit_Card",
    "deposit_total": "Deposit Total",
    "rental_cash": "Rental_Cash",
    "rental_card": "Rental_Card",
    "rental_total": "Rental Total",
    "sofe_cash": "SoFe_Cash",
    "sofe_card": "SoFe_Card",
    "sofe_total": "SoFe Total",
    "gross_cash": "Gross Cash",
    "tips_cash": "Tips_Cash",
    "sumup_cash": "SumUp Cash",
    "gross_card": "Gross Card",
    "tips_card": "Tips_Card",
    "sumup_card": "SumUp Card",
    "gross_total": "Gross Total",
    "tips_total": "Tips Total",
    "sumup_total": "SumUp Total",
    "gross_card_miti": "Gross Card MiTi",
    "miti_commission": "MiTi_Commission",
    "net_card_miti": "Net Card MiTi",
    "gross_card_lola": "Gross Card LoLa",
    "lola_commission": "LoLa_Commission",
    "lola_commission_miti": "LoLa_Commission_MiTi",
    "net_card_lola": "Net Card LoLa",
    "gross_card_total": "Gross Card Total",
    "total_commission": "Total Commission",
    "net_card_total": "Net Card Total",
    "net_payment_sumup_miti": "Net Payment SumUp MiTi",
    "miti_tips_cash": "MiTi_Tips_Cash",
    "miti_tips_card": "MiTi_Tips_Card",
    "miti_tips": "MiTi_Tips",
    "cafe_tips": "Cafe_Tips",
    "verm_tips": "Verm_Tips",
    "gross_miti_miti": "Gross MiTi (MiTi)",
    "gross_miti_lola": "Gross MiTi (LoLa)",
    "gross_miti_miti_card": "Gross MiTi (MiTi) Card",
    "net_miti_miti_card": "Net MiTi (MiTi) Card",
    "net_miti_lola": "Net MiTi (LoLa)",
    "contribution_miti": "Contribution MiTi",
    "share_lola": "Net MiTi (LoLA) - Share LoLa",
    "sponsored_reductions": "Sponsored Reductions",
    "debt_to_miti": "Debt to MiTi",
    "income_lola_miti": "Income LoLa MiTi",
    "paidout_sumup": "PaidOut Sumup",
    "meal_count_regular": "MealCount_Regular",
    "meal_count_reduced": "MealCount_Reduced",
    "meal_count_children": "MealCount_Children",
    "meal_count_praktikum": "MealCount_Praktikum",
    "total_praktikum": "Total Praktikum",
}

COUNT_MEASURES = [name for name in DETAILS_REPORT if name.startswith("meal_count_")]

# --- fixed values: columns of the partner report -----------------------------------------------------
PARTNER_REPORT = {
    "date": "Datum",
    "hauptgang": "Hauptgang",
    "reduziert": "Reduziert",
    "kind": "Kind",
    "kueche": "Küche",
    "total_bar": "Total Bar",
    "anteil_lola": "Anteil LoLa",
    "anteil_miti": "Anteil MiTi",
    "einnahmen_bar": "Einnahmen barz.",
    "davon_tg_bar": "davon TG barz.",
    "einnahmen_karte": "Einnahmen Karte",
    "davon_tg_karte": "davon TG Karte",
    "total_einnahmen": "Total Einnahmen (oT)",
    "kommission_bar": "Kommission Bar",
    "netto_bar": "Netto Bar",
    "karte_miti": "Karte MiTi",
    "kommission_miti": "Kommission MiTi",
    "netto_karte_miti": "Netto Karte MiTi",
    "net_total_karte": "Net Total Karte",
    "verkauf_lola": "Verkauf LoLa (80%)",
    "gesponsort": "Gesponsort",
    "ueberweisung": "Überweisung",
}

# --- fixed values: postings as (measure, debit account, credit account, description) -----------------
POSTINGS = [
    ("deposit_cash", "10000", "23050", "Schlüsseldepot bar"),
    ("cafe_cash", "10000", "30200", "Cafe bar"),
    ("verm_cash", "10000", "30700", "Verkäufe bei Vermietung bar"),
    ("sofe_cash", "10000", "30810", "Sommerfest bar"),
    ("rental_cash", "10000", "31000", "Vermietungen bar"),
    ("culture_lola_cash", "10000", "32000", "Kulturverkäufe bar"),
    ("packaging_cash", "10000", "46000", "Recircle bar"),
    ("culture_paidout_cash", "10000", "20121", "Kooperation bar"),
    ("culture_paidout_card", "10920", "20121", "Kooperation Karte"),
    ("culture_paidout_total", "20121", "10000", "Kooperation Ausbezahlt"),
    ("deposit_card", "10920", "23050", "Schlüsseldepot Karte"),
    ("cafe_card", "10920", "30200", "Cafe Karte"),
    ("verm_card", "10920", "30700", "Verkäufe Vermietung Karte"),
    ("sofe_card", "10920", "30810", "Sommerfest Karte"),
    ("rental_card", "10920", "31000", "Vermietungen Karte"),
    ("culture_lola_card", "10920", "32000", "Kulturverkäufe Karte"),
    ("packaging_card", "10920", "46000", "Recircle Karte"),
    ("net_card_total_miti", "10920", "20051", "Netto-Ertrag + Tips Karte MiTi"),
    ("tips_card_lola", "10920", "10910", "Tips Karte LoLa"),
    ("lola_commission", "68450", "10920", "Kartenkommission"),
    ("sponsored_reductions", "59991", "20051", "Preisreduktionen"),
    ("total_praktikum", "59991", "20120", "Essen Praktikum"),
    ("debt_to_miti", "20051", "10930", "Anteil MiTi"),
    ("income_lola_miti", "20051", "30500", "Verkäufe Mittagstisch LoLa"),
    ("debt_to_miti", "10930", "10100", "Überweisung an MiTi"),
]


def posting_column(debit: str, credit: str) -> str:
    return f"p{debit}_{credit}"


ACCOUNTING_REPORT = {
    "date": "Date",
    "payment_sumup": "Payment SumUp",
    "total_cash_debit": "Total Cash Debit",
    "total_card_debit": "Total Card Debit",
    **{posting_column(d, c): f"{d}/{c}" for _, d, c, _ in POSTINGS},
}

# --- fixed values: columns of the ledger import ------------------------------------------------------
LEDGER_REPORT = {
    "datum": "Datum",
    "beleg": "Beleg",
    "rechnung": "Rechnung",
    "beschreibung": "Beschreibung",
    "kt_soll": "KtSoll",
    "kt_haben": "KtHaben",
    "anzahl": "Anzahl",
    "einheit": "Einheit",
    "preis_einheit": "Preis/Einheit",
    "betrag_chf": "Betrag CHF",
}
