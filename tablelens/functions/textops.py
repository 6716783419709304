"""What counts as a blank at the edge of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space and separators, NEL and all Unicode separators.
BLANK = r"[\p{Z}\x09-\x0d\x1c-\x1f\x{85}]"
WIDE_BLANK = r"[\p{Z}\x{85}&&[^\x00-\x7f]]"
EDGES = rf"^{BLANK}+|{BLANK}+\z"


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def cut(c: Column) -> Column:
    """The text without blanks at its edges."""
    return F.regexp_replace(c, EDGES, "")


def strip(c: Column) -> Column:
    """The text without blanks at its edges; nothing but blanks is null."""
    return F.nullif(cut(c), F.lit(""))


def has_edge_blanks(c: Column) -> Column:
    return c.rlike(EDGES)


def has_wide_edge_blanks(c: Column) -> Column:
    """A blank beyond ASCII within the run of blanks at either edge."""
    return c.rlike(rf"^{BLANK}*{WIDE_BLANK}") | c.rlike(rf"{WIDE_BLANK}{BLANK}*\z")


def has_edge_spaces(c: Column) -> Column:
    """A space separator at either edge; tabs and line ends are none."""
    return c.rlike(r"^\p{Zs}|\p{Zs}\z")
