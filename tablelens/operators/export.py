"""Exports: projections with renames and trimming, single files, and what to check before a database takes the rows."""

from __future__ import annotations

import re
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, textops
from ..sources import excel
from . import ddl
from .dialects import dialect
from .naming import snake_case, unique_name
from .profile import ROW

CODECS = ("snappy", "zstd", "gzip", "uncompressed")
CONTROL = re.compile(r"[\t\r\n]+")


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    sql_type: str | None = None
    nullable: bool = True


def project(df: DataFrame, mappings: list[Mapping] | None = None, trim: bool = True) -> DataFrame:
    """The mapped columns under their target names, all but the source row number by default; texts without edge blanks, all-blank ones null."""
    chosen = mappings or [Mapping(c, c) for c in df.columns if c != ROW]
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[(textops.strip(F.col(f"`{m.source}`")) if trim and m.source in text else F.col(f"`{m.source}`")).alias(m.target) for m in chosen])


def suggest_mappings(df: DataFrame, to: str = "sqlserver", trim: bool = True) -> list[Mapping]:
    """Snake-case, unique targets with sized types; a column is nullable if it has nulls or, trimmed, blank texts."""
    out: list[Mapping] = []
    for c in ddl.column_types(df, to, trim):
        out.append(Mapping(c.source, unique_name(snake_case(c.source), [m.target for m in out]), c.sql_type, c.nullable))
    return out


def mapping_ddl(mappings: list[Mapping], table: str, to: str = "sqlserver", schema: str | None = None) -> str:
    return ddl.render(table, [ddl.ColumnType(m.source, m.target, m.sql_type or dialect(to).names["unknown"], m.nullable) for m in mappings], to, schema)


def _single(df: DataFrame, path: str, write: Callable[[str, DataFrame], None], suffix: str, head: str = "") -> int:
    """Lets Spark write one part into a folder beside the target and moves it there, behind the head if there is one. Rows are counted as they are written."""
    target = Path(path)
    folder = target.parent / f".{target.name}.{uuid.uuid4().hex}"
    seen = Observation()
    try:
        write(str(folder), df.observe(seen, F.count(F.lit(1)).alias("n")))
        (part,) = [p for p in folder.iterdir() if p.name.startswith("part-") and p.name.endswith(suffix)]
        if head:
            with open(folder / "whole", "wb") as out, open(part, "rb") as body:
                out.write(head.encode())
                shutil.copyfileobj(body, out, 1 << 20)
            part = folder / "whole"
        part.replace(target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return int(seen.get["n"])


def to_flat(df: DataFrame, path: str, delimiter: str = "|", header: bool = True, quote: str = '"', null: str = "", line_end: str = "\r\n", mappings: list[Mapping] | None = None, trim: bool = True, single: bool = True) -> int:
    """Values as they are, quoted where they hold a delimiter, a quote, a line end or nothing. single=False writes a folder of parts without header."""
    out = project(df, mappings, trim)

    def shown(c: Column, t: T.DataType) -> Column:
        s = casts.number_text(c.cast("double")) if isinstance(t, T.DoubleType | T.FloatType) else c.cast("string")
        if not quote:
            return F.coalesce(s, F.lit(null))
        special = s.rlike(f"[{re.escape(delimiter + quote)}\r\n]") | (s == "") | (s == null)
        return F.when(s.isNull(), F.lit(null)).when(special, F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(quote * 2)), F.lit(quote))).otherwise(s)

    lines = out.select(F.concat_ws(delimiter, *[shown(F.col(f"`{f.name}`"), f.dataType) for f in out.schema.fields]).alias("line"))
    if not single:
        seen = Observation()
        lines.observe(seen, F.count(F.lit(1)).alias("n")).write.option("lineSep", line_end).text(path)
        return int(seen.get["n"])
    quoted = [f"{quote}{c.replace(quote, quote * 2)}{quote}" if quote and re.search(f"[{re.escape(delimiter + quote)}\r\n]", c) else c for c in out.columns]
    head = delimiter.join(quoted) + line_end if header else ""
    return _single(lines, path, lambda folder, rows: rows.coalesce(1).write.option("lineSep", line_end).text(folder), ".txt", head)


def to_parquet(df: DataFrame, path: str, compression: str = "snappy", mappings: list[Mapping] | None = None, trim: bool = True, single: bool = True) -> int:
    """One file, or with single=False a folder with a file for each task."""
    if compression not in CODECS:
        raise ValueError(f"compression is one of {', '.join(CODECS)}")
    out = project(df, mappings, trim)
    if not single:
        seen = Observation()
        out.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", compression).parquet(path)
        return int(seen.get["n"])
    return _single(out, path, lambda folder, rows: rows.coalesce(1).write.option("compression", compression).parquet(folder), ".parquet")


def to_excel(df: DataFrame, path: str, sheet: str = "Sheet1", mappings: list[Mapping] | None = None, trim: bool = True, cancelled=lambda: False, progress=lambda n: None) -> int:
    """Rows stream to the driver a partition at a time; times with a zone lose it."""
    out = project(df, mappings, trim)
    rows = ([v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v for v in r] for r in out.toLocalIterator())
    return excel.write(path, out.columns, rows, sheet, cancelled, progress)


def export(df: DataFrame, path: str, kind: str, **options) -> int:
    kinds = {"flat": to_flat, "parquet": to_parquet, "excel": to_excel}
    if kind not in kinds:
        raise ValueError(f"kind is one of {', '.join(kinds)}")
    return kinds[kind](df, path, **options)


def _fits(c: Column, sql_type: str) -> Column:
    """Whether the text can be bound to a column of the type."""
    t = sql_type.lower()
    if m := re.match(r"(?:var)?char\((\d+)\)", t):
        return F.length(c) <= int(m[1])
    if m := re.match(r"decimal\((\d+),\s*(\d+)\)", t):
        return casts.to_decimal(c, int(m[1]), int(m[2])).isNotNull()
    ranges = {"tinyint": (0, 255), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "integer": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
    if t in ranges:
        return casts.to_bigint(c).between(*ranges[t])
    if t in ("bit", "boolean"):
        return F.lower(c).isin("0", "1", "true", "false")
    if t == "date":
        return casts.to_timestamp(c).isNotNull()
    if t.startswith("datetime") or t.startswith("timestamp"):
        return casts.to_timestamp(c).isNotNull()
    return casts.to_double(c).isNotNull() if t in ("double", "float", "real") else F.lit(True)


def offending_rows(df: DataFrame, mappings: list[Mapping], n: int = 3) -> list[dict]:
    """Before an export: at most n rows with a value that its target type cannot take, or a null where none may be, and which columns."""
    tests = {}
    for m in mappings:
        c = F.col(f"`{m.source}`").cast("string")
        bad = F.lit(False) if m.sql_type is None else c.isNotNull() & ~F.coalesce(_fits(c, m.sql_type), F.lit(False))
        tests[m.source] = bad if m.nullable else bad | c.isNull()
    marks = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    bad = df.withColumn(" marked", marks).filter(F.size(" marked") > 0)
    bad = bad.orderBy(ROW) if ROW in df.columns else bad
    return [{"row": r[ROW] if ROW in df.columns else None, "marked": list(r[" marked"]), "values": {m.source: r[m.source] for m in mappings}} for r in bad.limit(n).collect()]


def blamed(message: str, df: DataFrame, mappings: list[Mapping], n: int = 3) -> list[dict]:
    """After a refused export: what the database's message blames. A target column that it quotes, or rows with a value that it quotes; without either, what offending_rows() finds."""
    quoted = {x for m in re.finditer(r"'([^']+)'|\"([^\"]+)\"|\[([^\]]+)\]|`([^`]+)`", message) for x in m.groups() if x}
    named = [m for m in mappings if m.target.lower() in {q.lower() for q in quoted} | {q.rsplit(".", 1)[-1].strip('"[]`').lower() for q in quoted}]
    found = offending_rows(df, named or mappings, n)
    if found:
        return found
    values = [q for q in quoted if q.lower() not in {m.target.lower() for m in mappings}]
    hits = [m.source for m in named or mappings]
    marks = F.filter(F.array(*[F.when(F.col(f"`{c}`").cast("string").isin(values), F.lit(c)) for c in hits]), lambda x: x.isNotNull()) if values else F.array().cast("array<string>")
    bad = df.select("*", marks.alias(" marked")).filter(F.size(" marked") > 0)
    return [{"row": r[ROW] if ROW in df.columns else None, "marked": list(r[" marked"]), "values": {m.source: r[m.source] for m in mappings}} for r in bad.limit(n).collect()] or [{"row": None, "marked": [m.source for m in named], "values": {}}][: len(named)]


def clipboard(df: DataFrame, n: int = 5000) -> str:
    """A small frame as tab-separated text: tabs and line ends within values become a blank, nulls are empty."""
    rows = [["" if v is None else CONTROL.sub(" ", str(v)) for v in r] for r in df.limit(n).collect()]
    return "\n".join("\t".join(r) for r in [df.columns, *rows])
