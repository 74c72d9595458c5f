"""Measures derived from the daily key figures.

A missing figure counts as zero. Every measure is rounded to two places and later ones build on rounded ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.keys import site_of
from salesledger.functions.money import round2, total

# --- fixed values ------------------------------------------------------------------------------------
PARTNER_SHARE = "0.2"
HOUSE_SHARE = "0.8"
REDUCTION_PER_MEAL = "2"

_TOPICS = [topic.lower() for topic in S.TOPICS]

FROM_FIGURES = {
    **{f"{n}_total": total(f"{n}_cash", f"{n}_card") for n in [*_TOPICS, "culture_lola", "culture_paidout"]},
    "gross_cash": total(*[f"{t}_cash" for t in _TOPICS]),
    "gross_card": total(*[f"{t}_card" for t in _TOPICS]),
    "gross_card_miti": total("miti_card"),
    "tips_total": total("tips_cash", "tips_card"),
    "total_commission": total("miti_commission", "lola_commission"),
    "net_payment_sumup_miti": total("miti_card", "miti_tips_card", minus=("miti_total_commission",)),
    "net_miti_miti_card": total("gross_miti_miti_card", minus=("miti_commission",)),
    "net_miti_lola": total("gross_miti_lola", minus=("lola_commission_miti",)),
    "sponsored_reductions": round2(
        f"{REDUCTION_PER_MEAL} * (coalesce(meal_count_reduced, 0) + coalesce(meal_count_praktikum, 0))"
    ),
}

FROM_TOTALS = {
    "gross_card_lola": total("gross_card", minus=("miti_card",)),
    "gross_total": total("gross_cash", "gross_card"),
    "sumup_cash": total("gross_cash", "tips_cash"),
    "sumup_card": total("gross_card", "tips_card"),
    "net_card_miti": total("gross_card_miti", minus=("miti_commission",)),
    "net_card_total": total("gross_card", minus=("total_commission",)),
    "contribution_miti": round2(f"{PARTNER_SHARE} * net_miti_lola"),
    "share_lola": round2(f"{HOUSE_SHARE} * net_miti_lola"),
}

FROM_NETS = {
    "sumup_total": total("sumup_cash", "sumup_card"),
    "net_card_lola": total("gross_card_lola", minus=("lola_commission",)),
    "income_lola_miti": total("gross_miti_lola", minus=("contribution_miti",)),
    "debt_to_miti": total("net_payment_sumup_miti", "sponsored_reductions", minus=("share_lola",)),
    "paidout_sumup": total("net_card_total", "tips_card"),
    "gross_card_total": "gross_card",
    "su_cash": "sumup_cash",
    "su_card": "sumup_card",
    "su_total": total("sumup_cash", "sumup_card"),
    "su_tips": "tips_total",
}


def derive_measures(daily: DataFrame) -> DataFrame:
    """Add all totals and net values to the daily key figures."""
    for layer in (FROM_FIGURES, FROM_TOTALS, FROM_NETS):
        daily = daily.selectExpr("*", *[f"{formula} AS {name}" for name, formula in layer.items()])
    return daily


def details_report(daily: DataFrame) -> DataFrame:
    """The 76 columns of the details report, one row per day, from the daily key figures."""
    return derive_measures(daily).select(*site_of(daily), "month", *S.DETAILS_REPORT)


def with_total_rows(details: DataFrame) -> DataFrame:
    """Add one total row per month: sums of the rounded daily values, zero where no day has a value.

    The total row has no date and ``is_total`` set. Only daily rows are summed, never the sales again.
    """
    measures = [name for name in S.DETAILS_REPORT if name != "date"]
    site = site_of(details)
    period, date = [F.col(name) for name in (*site, "month")], F.col("date")
    both = details.groupingSets([[*period, date], period], *period, date).agg(
        (F.grouping("date") == 1).alias("is_total"), *[F.expr(f"sum({name}) AS {name}") for name in measures]
    )

    def filled(name: str) -> str:
        kind = "BIGINT" if name in S.COUNT_MEASURES else "DECIMAL(18, 2)"
        return f"CAST(CASE WHEN is_total THEN coalesce({name}, 0) ELSE {name} END AS {kind}) AS {name}"

    return both.selectExpr(*site, "month", "date", "is_total", *[filled(name) for name in measures])
