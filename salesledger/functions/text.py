"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = r"\p{IsWhite_Space}"
VISIBLE = (33, 126)
"""First and last code point of the visible ASCII characters; none of them is white space."""


def strip(column: Column) -> Column:
    """Remove all leading and trailing white space; Spark's ``trim`` removes blanks only.

    The pattern, which looks at every character, is for texts that do not begin and end with a visible ASCII character.
    """
    bare = F.ascii(F.left(column, F.lit(1))).between(*VISIBLE) & F.ascii(F.right(column, F.lit(1))).between(*VISIBLE)
    return F.when(bare, column).otherwise(F.regexp_replace(column, rf"^{WHITE_SPACE}+|{WHITE_SPACE}+\z", ""))


def group_or_null(column: Column, pattern: str) -> Column:
    """First regex group, null when the pattern does not match."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))
