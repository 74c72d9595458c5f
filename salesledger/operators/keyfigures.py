"""Daily key figures.

All figures are conditional sums over the same rows by day. The rows are first summed by day and by the few labels the
conditions look at: three sums per row, and a table that no longer grows with the number of sales. The
figures are then picked from that small table. One shuffle of partial sums replaces an aggregate and a
join per figure.

A figure is null when no row matched and zero when the matching rows have no price.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions import labels
from salesledger.functions.dates import month_of
from salesledger.functions.keys import site_of


@dataclass(frozen=True)
class Figure:
    """A sum of ``measure`` (net, commission or quantity) over the rows with these labels."""

    name: str
    measure: str
    topic: str | None = None
    owner: str | None = None
    method: str | None = None
    tip: bool | None = None
    meal: str | None = None
    other: str | None = None

    def condition(self) -> str:
        parts = [
            f"{label} = '{value}'"
            for label, value in (("topic", self.topic), ("owner", self.owner), ("method", self.method))
            if value
        ]
        if self.tip is not None:
            parts.append("tip" if self.tip else "NOT tip")
        if self.meal:
            parts.append(f"meals & {_meal_bit(self.meal)} <> 0")
        if self.other:
            parts.append(self.other)
        return " AND ".join(f"({part})" for part in parts)

    def aggregate(self) -> str:
        total = f"sum(CASE WHEN {self.condition()} THEN {self.measure} END)"
        if self.measure == "quantity":
            return f"CAST({total} AS BIGINT) AS {self.name}"
        return f"CAST(bround({total}, 2) AS DECIMAL(18, 2)) AS {self.name}"


def _meal_bit(kind: str) -> int:
    return 1 << labels.MEAL_TYPES.index(kind)


def _consumption() -> list[Figure]:
    return [
        Figure(f"{topic.lower()}_{method.lower()}", "net", topic=topic, method=method, tip=False)
        for topic in S.TOPICS
        for method in S.PAYMENT_METHODS
    ]


def _culture() -> list[Figure]:
    return [
        Figure(f"culture_{o.lower()}_{m.lower()}", "net", topic="Culture", owner=o, method=m, tip=False)
        for o in ("LoLa", "PaidOut")
        for m in S.PAYMENT_METHODS
    ]


def _tips() -> list[Figure]:
    by_topic = [Figure(f"{t.lower()}_tips", "net", topic=t, tip=True) for t in ("Cafe", "MiTi", "Verm")]
    miti = [
        Figure(f"miti_tips_{m.lower()}", "net", topic="MiTi", method=m, tip=True) for m in S.PAYMENT_METHODS
    ]
    by_method = [Figure(f"tips_{m.lower()}", "net", method=m, tip=True) for m in S.PAYMENT_METHODS]
    return by_topic + miti + by_method


def _commission() -> list[Figure]:
    return [
        Figure("miti_commission", "commission", topic="MiTi", owner="MiTi"),
        Figure("lola_commission", "commission", other="topic <> 'MiTi' OR owner = 'LoLa'"),
        Figure("lola_commission_miti", "commission", topic="MiTi", owner="LoLa"),
        Figure("miti_total_commission", "commission", topic="MiTi"),
    ]


def _owned() -> list[Figure]:
    return [
        Figure("gross_miti_miti", "net", topic="MiTi", owner="MiTi", tip=False),
        Figure("gross_miti_lola", "net", topic="MiTi", owner="LoLa", tip=False),
        Figure("gross_miti_miti_card", "net", topic="MiTi", owner="MiTi", method="Card", tip=False),
    ]


def _meals() -> list[Figure]:
    counts = [
        Figure(f"meal_count_{kind}", "quantity", topic="MiTi", owner="MiTi", tip=False, meal=kind)
        for kind in labels.MEAL_TYPES
    ]
    total = Figure("total_praktikum", "net", topic="MiTi", owner="MiTi", tip=False, meal="praktikum")
    return [*counts, total]


FIGURES = [*_consumption(), *_culture(), *_tips(), *_commission(), *_owned(), *_meals()]
"""The figures the reports use."""

MEAL_FIGURES = _meals()

UNREPORTED = [
    *[
        Figure(f"{t.lower()}_total_commission", "commission", topic=t)
        for t in ("Deposit", "Packaging", "Rental", "Culture")
    ],
    Figure("gross_miti_lola_cash", "net", topic="MiTi", owner="LoLa", method="Cash", tip=False),
]
"""Figures that are defined but appear in no report; computed on request only."""


def _known(name: str, allowed: list[str], alias: str) -> str:
    """Values outside the list become one group, so the summed table stays small whatever the input holds."""
    listed = ", ".join(f"'{value}'" for value in allowed)
    return f"CASE WHEN {name} IS NULL OR {name} IN ({listed}) THEN {name} ELSE '?' END AS {alias}"


def label_sums(intermediate: DataFrame) -> DataFrame:
    """Sums by site, day and label combination: at most a few hundred rows per site and day."""
    kitchen = "topic = 'MiTi' AND owner = 'MiTi' AND purpose <> 'Tip'"
    meals = " | ".join(
        f"CASE WHEN {kitchen} AND ({labels.MEALS[kind]}) THEN {_meal_bit(kind)} ELSE 0 END"
        for kind in labels.MEAL_TYPES
    )
    site = site_of(intermediate)
    keyed = intermediate.where("date IS NOT NULL").selectExpr(
        *site,
        "date",
        _known("topic", S.TOPICS, "topic"),
        _known("owner", S.OWNERS, "owner"),
        _known("payment_method", S.PAYMENT_METHODS, "method"),
        "purpose = 'Tip' AS tip",
        f"{meals} AS meals",
        "coalesce(price_net, 0) AS net",
        "coalesce(commission, 0) AS commission",
        "coalesce(quantity, 0) AS quantity",
    )
    return keyed.groupBy(*site, "date", "topic", "owner", "method", "tip", "meals").agg(
        F.sum("net").alias("net"), F.sum("commission").alias("commission"), F.sum("quantity").alias("quantity")
    )


def daily_key_figures(intermediate: DataFrame, figures: list[Figure] | None = None) -> DataFrame:
    """One row per site and day with every key figure, and the month it belongs to."""
    chosen = FIGURES if figures is None else figures
    site = site_of(intermediate)
    daily = label_sums(intermediate).groupBy(*site, "date").agg(*[F.expr(f.aggregate()) for f in chosen])
    return daily.select(*site, month_of(F.col("date")).alias("month"), *daily.columns[len(site) :])
