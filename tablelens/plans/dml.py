"""CREATE, DROP, ALTER ... RENAME, INSERT, UPDATE and DELETE on the tables of a workspace, each change a version (see versions).

A row is updated or deleted if the condition is true; null leaves it alone. Rows inserted take the table's types; columns not named become null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import SKIP, arguments, install, translate
from .versions import Versioned

_ID = r'(?P<name>"[^"]+"|`[^`]+`|\w+)'
_FORMS = {
    "create": rf"create\s+(?P<replace>or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?P<kind>table|view)\s+(?P<lenient>if\s+not\s+exists\s+)?{_ID}\s+as\s+(?P<query>.+)",
    "drop": rf"drop\s+(?:table|view)\s+(?P<lenient>if\s+exists\s+)?{_ID}",
    "rename": rf'alter\s+(?:table|view)\s+{_ID}\s+rename\s+to\s+(?P<query>"[^"]+"|`[^`]+`|\w+)',
    "insert": rf"insert\s+into\s+{_ID}\s*(?:\((?P<columns>[^()]*)\)\s*)?(?P<query>(?:(?:select|values|with|from)\b|\().+)",
    "update": rf"update\s+{_ID}\s+set\s+(?P<query>.+)",
    "delete": rf"delete\s+from\s+{_ID}(?:\s+where\s+(?P<query>.+))?",
}


@dataclass
class Change:
    verb: str
    name: str
    query: str = ""
    columns: tuple[str, ...] = ()
    table: bool = False
    replace: bool = False
    lenient: bool = False


def _unquoted(name: str) -> str:
    name = name.strip()
    return name[1:-1] if name[:1] in '"`' else name


def parse(sql: str) -> Change | None:
    text = re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", "", sql, flags=re.DOTALL).rstrip().rstrip(";").rstrip()
    for verb, form in _FORMS.items():
        m = re.fullmatch(form, text, re.IGNORECASE | re.DOTALL)
        if m:
            g = m.groupdict()
            columns = tuple(_unquoted(c) for c in g["columns"].split(",")) if g.get("columns") else ()
            query = g.get("query") or ""
            return Change(verb, _unquoted(g["name"]), _unquoted(query) if verb == "rename" else query, columns, (g.get("kind") or "").lower() == "table", bool(g.get("replace")), bool(g.get("lenient")))
    return None


def _condition(df: DataFrame, text: str) -> Column:
    spark = translate(text)
    install(df.sparkSession, spark)
    return F.coalesce(F.expr(spark).cast("boolean"), F.lit(False))


def _split_where(text: str) -> tuple[str, str]:
    """Assignments and the condition, cut at the first WHERE outside quotes and parentheses."""
    masked = SKIP.sub(lambda m: "x" * len(m[0]), text)
    for m in re.finditer(r"(?<![\w.])where\b", masked, re.IGNORECASE):
        if masked[: m.start()].count("(") == masked[: m.start()].count(")"):
            return text[: m.start()], text[m.end() :]
    return text, "true"


def _assignments(text: str) -> dict[str, str]:
    """Column to expression; commas and signs in quotes and parentheses do not part."""
    held: list[str] = []
    masked = SKIP.sub(lambda m: (held.append(m[0]), f"\x00{len(held) - 1}\x00")[1], text)
    full = lambda s: re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], s).strip()
    return {_unquoted(full(c)).lower(): full(e) for c, e in (a.split("=", 1) for a in arguments(masked + ")", 0)[0])}


def changed(table: Versioned, change: Change, query: Callable[[str], DataFrame]) -> DataFrame:
    """The table after an INSERT, UPDATE or DELETE, as a version of its own."""
    df = table.at()
    if change.verb == "delete":
        hit = _condition(df, change.query) if change.query else F.lit(True)
        return table.change(hit, lambda rows: rows.filter(~hit))
    if change.verb == "update":
        text, where = _split_where(change.query)
        hit, new = _condition(df, where), _assignments(text)
        unknown = set(new) - {c.lower() for c in df.columns}
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        for e in new.values():
            install(df.sparkSession, translate(e))
        values = [F.when(hit, F.expr(translate(new[f.name.lower()])).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in new else F.col(f"`{f.name}`") for f in df.schema.fields]
        return table.change(hit, lambda rows: rows.select(*values))
    rows = query(change.query)
    names = [c.lower() for c in change.columns or df.columns]
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(names)} columns")
    rows = rows.toDF(*names)
    return table.insert(rows.select(*[(F.col(f"`{f.name.lower()}`") if f.name.lower() in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]))
