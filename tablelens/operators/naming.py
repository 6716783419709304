"""Bare, unique names for tables and columns."""

from __future__ import annotations

import re
from collections.abc import Iterable


def snake_case(name: str) -> str:
    """Lower-case words joined by underscores; acronyms stay whole; a name of nothing but separators is col."""
    spaced = re.sub(r"[ .-]", "_", name)
    if spaced != spaced.upper() or spaced == spaced.lower():
        spaced = re.sub(r"([a-z])([A-Z])", r"\1_\2", spaced)
        spaced = re.sub(r"([^_])([A-Z][a-z])", r"\1_\2", spaced)
    return re.sub(r"_+", "_", spaced.lower()).strip("_") or "col"


def unique_name(base: str, taken: Iterable[str], first: int = 1) -> str:
    """base, or base with the first free number from first on."""
    used, n, name = set(taken), first, base
    while name in used:
        name, n = f"{base}_{n}", n + 1
    return name


def table_name(stem: str, taken: Iterable[str] = ()) -> str:
    """A file's stem as a table name; collisions get _2, _3."""
    name = re.sub(r"[^0-9A-Za-z_]+", "_", stem).strip("_").lower() or "table"
    return unique_name(f"t_{name}" if name[0].isdigit() else name, taken, 2)


def column_names(cells: list[str]) -> list[str]:
    """Header cells trimmed; blank ones are columnN by place; repeats, whatever their case, get _1, _2."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        base, n = cell.strip() or f"column{i}", 0
        name = base
        while name.lower() in {x.lower() for x in out}:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out
