"""Heuristic labels of a sale: type, payment method, topic, owner, purpose, kind of meal.

The rules are SQL expressions over the internal column names. The first branch that is true decides; a null
condition falls through to the next one.
"""

from __future__ import annotations

from salesledger import schema as S
from salesledger.functions import dates
from salesledger.functions.text import WHITE_SPACE

# --- fixed values ------------------------------------------------------------------------------------
LUNCH_CATEGORY = "Mittagstisch"
PAID_OUT_MARK = " (PO)"
PACKAGING_PREFIX = "Recircle Tupper Depot"
CANDLE_PREFIX = "Kerze"
RENT_DESCRIPTION = "Miete"
KITCHEN_WORDS = [
    "Hauptgang",
    "Kinderteller",
    "Senioren-Mittagstisch",
    "Seniorenmittagstisch",
    "Kindermenü",
    "Kinderpasta",
    "Menü",
    "Dessert",
    "Praktik",
    "Vorspeise",
    "Vorsp. + Hauptsp.",
    "Hauptspeise",
    "Trinkgeld",
]
KITCHEN_BLANK_FROM = 5
MEAL_TYPES = ["regular", "reduced", "praktikum", "children"]


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{word}')" for word in words) + ")"


PAYMENT_METHOD = f"CASE WHEN payment = '{S.CASH_PAYMENT}' THEN 'Cash' ELSE 'Card' END"

RECORD_TYPE = f"CASE WHEN kind = '{S.SALE_KIND}' THEN 'Sales' ELSE 'Refund' END"

PURPOSE = f"CASE WHEN contains(description, '{S.TIP_DESCRIPTION}') THEN 'Tip' ELSE 'Consumption' END"

# Category and description first, then the time of day of the transaction.
TOPIC = f"""
CASE
  WHEN category = '{LUNCH_CATEGORY}' THEN 'MiTi'
  WHEN contains(category, '{PAID_OUT_MARK}') THEN 'Culture'
  WHEN startswith(description, '{PACKAGING_PREFIX}') THEN 'Packaging'
  WHEN startswith(description, '{CANDLE_PREFIX}') THEN 'Culture'
  WHEN description = '{RENT_DESCRIPTION}' THEN 'Rental'
  WHEN time < '{dates.DAY_START}' OR time >= '{dates.DAY_END}' OR is_weekend THEN 'Culture'
  WHEN NOT is_weekend AND time <= shift_change THEN 'MiTi'
  WHEN NOT is_weekend AND time > shift_change THEN 'Cafe'
  ELSE 'Culture'
END"""

# Only the topics MiTi and Culture have an owner.
OWNER = f"""
CASE
  WHEN topic NOT IN ('MiTi', 'Culture') THEN NULL
  WHEN category = '{LUNCH_CATEGORY}' THEN 'MiTi'
  WHEN contains(category, '{PAID_OUT_MARK}') THEN 'PaidOut'
  WHEN topic = 'Culture' AND contains(description, '{PAID_OUT_MARK}') THEN 'PaidOut'
  WHEN topic = 'MiTi' AND {has_any("description", KITCHEN_WORDS)} THEN 'MiTi'
  WHEN topic = 'MiTi' AND description RLIKE r'^{WHITE_SPACE}*\\z' AND price_gross >= {KITCHEN_BLANK_FROM} THEN 'MiTi'
  ELSE 'LoLa'
END"""

# A description may name several kinds of meal.
MEALS = {
    "regular": f"""
        (contains(description, 'Hauptgang') AND NOT {has_any("description", ["Kinder", "Reduziert", "Praktikum"])})
        OR {has_any("description", ["Seniorenmittagstisch", "Senioren-Mittagstisch", "Gang-Menu", "Hauptsp"])}
        OR startswith(description, 'Menü') OR startswith(description, 'Praktika')""",
    "reduced": "endswith(description, 'Reduziert')",
    "praktikum": "endswith(description, 'Praktikum')",
    "children": "contains(description, 'Kinder')",
}
