"""How to read a file, and what came of it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame

NUMBERS = ("first_row", "skip_rows", "skip_footer", "sample_size", "excel_header_row")


@dataclass(frozen=True)
class Options:
    """None detects. first_row: the header's record from 1, 0 for none; nullify_tokens: nulled in columns of numbers or dates.

    ignore_errors: what cannot be read is left out without a table of rejects; strict_mode off: quotes that do not fit are read as well
    as can be instead of rejected; parallel off: the file is read in one task; sample_size: records that detection looks at.
    """

    delimiter: str | None = None
    quote: str = '"'
    escape: str | None = None
    encoding: str | None = None
    first_row: int | None = None
    skip_rows: int = 0
    skip_footer: int | None = None
    ignore_errors: bool = False
    parallel: bool = True
    strict_mode: bool = True
    sample_size: int | None = None
    materialize: bool = True
    sheet: str | None = None
    name: str | None = None
    nullify_tokens: tuple[str, ...] = ("NA", "NaN")
    parquet_paths: tuple[str, ...] | None = None
    excel_header_row: int | None = None
    excel_start_col: str | None = None
    excel_end_col: str | None = None


def cleaned(raw: dict | Options | None) -> Options:
    """Options from loose values: blank or unreadable numbers detect, or are 0 for skip_rows."""
    if isinstance(raw, Options):
        return raw
    known = {f.name for f in fields(Options)}
    out = {k: v for k, v in (raw or {}).items() if k in known}
    for k in NUMBERS:
        if k in out:
            try:
                out[k] = max(0, int(str(out[k]).strip()))
            except ValueError:
                out[k] = 0 if k == "skip_rows" else None
    for k in ("delimiter", "encoding", "sheet", "name", "escape", "excel_start_col", "excel_end_col"):
        if k in out and not out[k]:
            out[k] = None
    for k in ("nullify_tokens", "parquet_paths"):
        if out.get(k) is not None:
            out[k] = tuple(out[k])
        elif k == "nullify_tokens":
            out.pop(k, None)
    return replace(Options(), **out)


@dataclass
class Load:
    """A loaded table, the records it could not take, and how it was read."""

    name: str
    df: DataFrame
    rejects: DataFrame | None = None
    format: str = "csv"
    facts: dict = field(default_factory=dict)


class LoadError(ValueError):
    """A file that cannot be read; says why."""
