"""Plan-time checks of names and arguments: fail before any job starts."""

from __future__ import annotations

import re
from collections.abc import Iterable

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


def check_name(name: str) -> str:
    """Accept plain identifiers only, because names cannot be bound as SQL parameters."""
    require(isinstance(name, str) and bool(_IDENTIFIER.match(name)), f"not a plain identifier: {name!r}")
    return name


def split_table(name: str) -> tuple[str, str]:
    """Split and check a `schema.table` name."""
    parts = name.split(".")
    require(len(parts) == 2, f"expected schema.table, got {name!r}")
    return check_name(parts[0]), check_name(parts[1])


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def check_key(key: Iterable[str], columns: Iterable[str]) -> list[str]:
    """A key is one or more plain column names that all exist."""
    names = [key] if isinstance(key, str) else list(key)
    require(len(names) > 0, "a key needs at least one column")
    for name in names:
        check_name(name)
    absent = sorted(set(names) - set(columns))
    require(not absent, f"key columns not found in the data: {absent}")
    return names
