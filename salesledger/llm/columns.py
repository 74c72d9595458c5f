"""Names of columns that an operator adds for its own use beside a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """A name like ``name`` that none of ``taken`` has; Spark compares names without regard to case."""
    known = {t.lower() for t in taken}
    made = f"_{name}"
    while made.lower() in known:
        made += "_"
    return made


def quoted(name: str) -> str:
    """A column name for use inside SQL."""
    return "`" + name.replace("`", "``") + "`"
