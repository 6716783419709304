"""Typed clones: suggestions per column, and the projection that applies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, textops
from . import infer
from .profile import ROW

#: Rows that samples of values are taken from.
LOOKED_AT = 200


@dataclass(frozen=True)
class CastSpec:
    source: str
    target: str
    cast_to: str | None = None
    strict: bool = False
    date_format: str | None = None
    via_timestamp: bool = False
    strip_blanks: bool | None = None


@dataclass(frozen=True)
class Suggestion:
    column: str
    current: str
    suggested: str | None
    date_format: str | None = None
    via_timestamp: bool = False
    strip_blanks: bool | None = None
    coverage: dict | None = None
    samples: tuple[str, ...] = ()


def first_values(df: DataFrame, columns: list[str], n: int = 3) -> dict[str, tuple[str, ...]]:
    """Of each column the first n values that are not null. One job looks at the first rows; columns that are mostly null there get their own."""
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    text = lambda c: textops.named(c).cast("string")
    rows = ordered.select(*[text(c).alias(f"c{i}") for i, c in enumerate(columns)]).limit(LOOKED_AT).collect()
    found = {c: tuple(r[i] for r in rows if r[i] is not None)[:n] for i, c in enumerate(columns)}
    for c in columns:
        if len(found[c]) < n and len(rows) == LOOKED_AT:
            found[c] = tuple(r[0] for r in ordered.filter(textops.named(c).isNotNull()).select(text(c)).limit(n).collect())
    return found


def suggest_casts(df: DataFrame, threshold: float = infer.SUGGEST, with_samples: bool = True) -> list[Suggestion]:
    """A suggestion for each column; typed columns pass through."""
    found = infer.analyze(df)
    shown = first_values(df, [f.name for f in df.schema.fields if f.name != ROW]) if with_samples else {}
    out = []
    for f in df.schema.fields:
        if f.name == ROW:
            continue
        samples = shown.get(f.name, ())
        if f.name not in found:
            out.append(Suggestion(f.name, f.dataType.simpleString(), None, samples=samples))
            continue
        best = infer.chosen(found[f.name], threshold)
        type_, fmt, via = infer.pick(found[f.name], threshold)
        out.append(Suggestion(f.name, "string", type_, fmt, via, infer.strips(found[f.name], best), found[f.name].coverage, samples))
    return out


def apply(df: DataFrame, specs: list[CastSpec], where: str | None = None) -> DataFrame:
    """The typed projection; a filter sees source names. The source row number stays first."""
    source = df.filter(F.expr(where)) if where and where.strip() else df
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    cols = [F.col(ROW)] if ROW in df.columns and all(s.source != ROW for s in specs) else []
    for s in specs:
        if s.source in text:
            c = casts.typed(textops.named(s.source), s.cast_to, s.date_format, s.via_timestamp, s.strip_blanks, s.strict)
        else:
            c = textops.named(s.source) if not s.cast_to else textops.named(s.source).cast(s.cast_to) if s.strict else textops.named(s.source).try_cast(s.cast_to.replace("VARCHAR", "string").replace("TIMESTAMP", "timestamp_ntz"))
        cols.append(c.alias(s.target))
    return source.select(*cols)


def auto_specs(df: DataFrame) -> list[CastSpec]:
    return [CastSpec(s.column, s.column, s.suggested, False, s.date_format, s.via_timestamp, s.strip_blanks) for s in suggest_casts(df, with_samples=False)]


def auto_derive(df: DataFrame) -> DataFrame:
    """All suggestions taken, failures null."""
    return apply(df, auto_specs(df))


def preview(df: DataFrame, specs: list[CastSpec], where: str | None = None, n: int = 20) -> list[dict]:
    return [r.asDict() for r in apply(df, specs, where).limit(n).collect()]
