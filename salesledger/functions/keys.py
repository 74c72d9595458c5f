"""The site that rows belong to, where a table has one.

With a column ``site`` in its inputs every step works on several sites at once: a transaction number, a day, a month and a
ledger account belong to one site. Without it a table is one site's. A site is never null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = "site"


def site_of(*tables: DataFrame) -> list[str]:
    """The key column that all of ``tables`` share, as a list to put before other keys."""
    have = {SITE in table.columns for table in tables}
    if len(have) > 1:
        raise ValueError("either all tables have a site or none")
    return [SITE] * have.pop()


def site_of_path(path: Column, pattern: str) -> Column:
    """Site named in the path of a file: the first group of ``pattern``; an error where it doesn't match."""
    name = F.regexp_extract(path, pattern, 1)
    return F.when(name != "", name).otherwise(F.raise_error(F.concat(F.lit("no site in the path "), path)))
