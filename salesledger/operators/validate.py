"""Checks on the intermediate table. Each returns the offending rows; the caller decides whether to fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesledger import schema as S
from salesledger.functions.keys import SITE, site_of

SHOWN = [
    "date",
    "time",
    "transaction_id",
    "payment_method",
    "description",
    "price_net",
    "topic",
    "owner",
    "purpose",
    "comment",
]

ALLOWED = {
    "payment_method": S.PAYMENT_METHODS,
    "topic": S.TOPICS,
    "owner": [*S.OWNERS, ""],
    "purpose": S.PURPOSES,
}


def shown(df: DataFrame) -> list[str]:
    """The columns that tell a user which row is meant."""
    return [*site_of(df), *[name for name in S.PLACE.names if name in df.columns], *SHOWN]


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _invalid(field: str) -> Column:
    return ~_blank(field).isin(ALLOWED[field])


def _owner_rules() -> dict[str, Column]:
    no_owner = _blank("owner") == ""
    return {
        "miti_without_owner": (F.col("topic") == "MiTi") & no_owner,
        "culture_without_owner": (F.col("topic") == "Culture") & no_owner,
        "owner_not_allowed": ~F.col("topic").isin("MiTi", "Culture") & ~no_owner,
    }


def _labelled(df: DataFrame, rules: dict[str, Column], columns: list[str]) -> DataFrame:
    """One row per row and broken rule, from a single scan."""
    broken = F.filter(
        F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda r: r.isNotNull()
    )
    return df.select(*columns, F.explode(broken).alias("rule"))


def invalid_values(df: DataFrame, field: str) -> DataFrame:
    """Rows whose ``field`` is not one of the allowed values; a missing value counts as blank."""
    return df.where(_invalid(field)).select(shown(df))


def topic_owner_violations(df: DataFrame) -> DataFrame:
    """MiTi and Culture need an owner, every other topic must not have one."""
    return _labelled(df, _owner_rules(), shown(df))


def violations(df: DataFrame) -> DataFrame:
    """All checks that stop an export, in one scan."""
    rules = {f"invalid_{field}": _invalid(field) for field in ALLOWED}
    rules.update(_owner_rules())
    rules["missing_date"] = F.col("date").isNull()
    if site_of(df):
        rules["missing_site"] = F.col(SITE).isNull()
    return _labelled(df, rules, shown(df))


def zero_value_rows(df: DataFrame) -> DataFrame:
    """Rows without a net price that do not just mark a change of shift. A warning, not an error."""
    no_price = F.col("price_net").isNull() | (F.col("price_net") == 0)
    return df.where(no_price & ~F.col("description").isin(S.SHIFT_DESCRIPTIONS))


def unusual_owners(df: DataFrame) -> DataFrame:
    """Owner and topic pass the checks but the sale falls out of both owner splits."""
    miti = (F.col("topic") == "MiTi") & (F.col("owner") == "PaidOut")
    culture = (F.col("topic") == "Culture") & (F.col("owner") == "MiTi")
    return df.where(miti | culture).select(shown(df))


def tips_in_detail_postings(df: DataFrame) -> DataFrame:
    """Days whose detail postings include tips, which the monthly figures they replace leave out."""
    detail = (F.col("topic") == "Rental") | (F.col("owner") == "PaidOut")
    return (
        df.where(detail & (F.col("purpose") == "Tip"))
        .groupBy(*site_of(df), "date")
        .agg(F.coalesce(F.sum("price_net"), F.lit(0)).cast(S.MONEY).alias("tips"))
    )
