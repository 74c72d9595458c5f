"""Reports built from the details, with or without total rows: the formulas run on each row as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.money import round2, total
from salesledger.operators.measures import HOUSE_SHARE, PARTNER_SHARE

PARTNER_FORMULAS = {
    "hauptgang": "meal_count_regular",
    "reduziert": "coalesce(meal_count_reduced, 0) + coalesce(meal_count_praktikum, 0)",
    "kind": "meal_count_children",
    "kueche": "gross_miti_miti",
    "total_bar": "gross_miti_lola",
    "anteil_lola": round2(f"coalesce(gross_miti_lola, 0) * {HOUSE_SHARE}"),
    "anteil_miti": round2(f"coalesce(gross_miti_lola, 0) * {PARTNER_SHARE}"),
    "einnahmen_bar": total("miti_cash", "miti_tips_cash"),
    "davon_tg_bar": "miti_tips_cash",
    "einnahmen_karte": total("miti_card", "miti_tips_card"),
    "davon_tg_karte": "miti_tips_card",
    "total_einnahmen": "miti_total",
    "kommission_bar": "lola_commission_miti",
    "netto_bar": total("gross_miti_lola", minus=("lola_commission_miti",)),
    "karte_miti": "gross_miti_miti_card",
    "kommission_miti": "miti_commission",
    "netto_karte_miti": "net_miti_miti_card",
    "net_total_karte": "net_payment_sumup_miti",
    "verkauf_lola": round2("-coalesce(share_lola, 0)"),
    "gesponsort": "sponsored_reductions",
    "ueberweisung": "debt_to_miti",
}

ACCOUNTING_FORMULAS = {
    "payment_sumup": total("net_card_total", "tips_card"),
    "net_card_total_miti": total("net_card_miti", "miti_tips_card"),
    "tips_card_lola": total("tips_card", minus=("miti_tips_card",)),
    "total_cash_debit": total("gross_cash", minus=("miti_cash", "culture_paidout_total")),
    "total_card_debit": total("gross_card_lola", "tips_card", minus=("miti_tips_card",)),
}


def _keys(details: DataFrame) -> list[str]:
    return [name for name in ("site", "month", "is_total") if name in details.columns]


def partner_report(details: DataFrame) -> DataFrame:
    """Report for the lunch partner."""
    columns = [f"{formula} AS {name}" for name, formula in PARTNER_FORMULAS.items()]
    return details.selectExpr(*_keys(details), "date", *columns)


def accounting_report(details: DataFrame) -> DataFrame:
    """Posting columns named after debit and credit account, and three columns for reconciliation."""
    extended = details.selectExpr("*", *[f"{formula} AS {name}" for name, formula in ACCOUNTING_FORMULAS.items()])
    return extended.selectExpr(
        *_keys(details),
        "date",
        "payment_sumup",
        "total_cash_debit",
        "total_card_debit",
        *[f"{measure} AS {S.posting_column(d, c)}" for measure, d, c, _ in S.POSTINGS],
    )


def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename to the report's own column names, keeping month and total flag in front."""
    return df.select(*_keys(df), *[F.col(inner).alias(outer) for inner, outer in names.items()])
