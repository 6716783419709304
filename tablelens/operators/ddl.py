"""CREATE TABLE statements whose types fit the data: one aggregate measures all columns, then Python names the types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, textops
from . import infer
from .dialects import NO_TEXTS, Dialect, Numbers, Stamps, Texts, dialect
from .naming import snake_case, unique_name
from .profile import ROW, as_text


@dataclass(frozen=True)
class ColumnType:
    source: str
    target: str
    sql_type: str
    nullable: bool


def number_facts(s: Column) -> dict[str, Column]:
    """Of the values as text: how many, how many plain decimals, their digits, their range as whole numbers."""
    plain = F.when(s.rlike(casts.PLAIN_DECIMAL), s)
    dot = F.contains(plain, F.lit("."))
    big = casts.to_bigint(plain)
    return {
        "total": F.count(s),
        "plain": F.count(plain),
        "whole": F.max(F.length(F.substring_index(F.replace(plain, F.lit("-"), F.lit("")), ".", 1))),
        "fraction": F.max(F.when(dot, F.length(F.regexp_replace(F.substring_index(plain, ".", -1), r"0+\z", ""))).otherwise(F.when(plain.isNotNull(), 0))),
        "dot": F.max(dot.cast("int")),
        "low": F.min(big),
        "high": F.max(big),
        "fits": F.count(big),
    }


def numbers(r: dict) -> Numbers:
    if not r["total"]:
        return Numbers("int")
    if r["plain"] < r["total"]:
        return Numbers("fallback")
    p, s = infer.decimal_size(r["whole"], r["fraction"], r["dot"])
    if s == 0:
        return Numbers("int", int(r["low"]), int(r["high"])) if r["fits"] == r["total"] else Numbers("decimal", precision=min(r["whole"], 38))
    return Numbers("decimal", precision=p, scale=s)


def stamp_facts(c: Column) -> dict[str, Column]:
    return {"total": F.count(c), "first": F.min(c), "fine": F.max((F.call_function("unix_micros", c.cast("timestamp_ltz")) % 1000).cast("int")), "timed": F.count_if(infer.has_time(c))}


def stamps(r: dict) -> Stamps:
    if r["first"] is None:
        return Stamps()
    return Stamps(bool(r["fine"]), str(r["first"]) < "1753-01-01", not r["timed"])


def _plan(field: T.StructField, analysis: infer.Analysis | None, trim: bool) -> tuple[str, dict[str, Column]]:
    """What to measure of a column: a kind and its facts."""
    c, t = textops.named(field.name), field.dataType
    if isinstance(t, T.BooleanType):
        return "boolean", {}
    if isinstance(t, T.DateType):
        return "date", {}
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "stamp", stamp_facts(c)
    if isinstance(t, T.BinaryType):
        return "binary", {"longest": F.max(F.octet_length(c))}
    if isinstance(t, T.IntegralType):
        return "number", {"total": F.count(c), "plain": F.count(c), "low": F.min(c), "high": F.max(c), "fits": F.count(c), "whole": F.lit(1), "fraction": F.lit(0), "dot": F.lit(0)}
    if isinstance(t, T.DecimalType):
        return "decimal", {}
    if isinstance(t, T.DoubleType | T.FloatType):
        return "number", number_facts(as_text(c, t))
    if isinstance(t, T.NullType):
        return "text", {"a": F.lit(None).cast("int"), "b": F.lit(None).cast("int")}
    if not isinstance(t, T.StringType):
        return "unknown", {}
    if (field.metadata or {}).get("logical") == "uuid":
        return "uuid", {}
    read = textops.strip(c) if analysis and analysis.stripped else c
    sized = textops.cut(c) if trim else c
    length = {"a": F.min(F.length(sized)), "b": F.max(F.length(sized))}
    type_ = infer.pick(analysis, infer.STRICT)[0] if analysis else None
    if type_ == "BOOLEAN":
        return "text_boolean", length | {"loose": F.count_if(~F.lower(read).isin("0", "1", "true", "false"))}
    if type_ == "DATE":
        return "date", {}
    if type_ == "TIMESTAMP":
        return "stamp", stamp_facts(casts.to_timestamp(read))
    return ("number", number_facts(read)) if type_ else ("text", length)


def _name(kind: str, r: dict, t: T.DataType, d: Dialect) -> str:
    if kind == "stamp":
        return d.stamp(stamps(r))
    if kind == "binary":
        return d.binary(r["longest"])
    if kind == "number":
        return d.number(numbers(r))
    if kind == "decimal":
        return d.decimal.format(p=t.precision, s=t.scale)
    texts = NO_TEXTS if r.get("b") is None else Texts(r["a"], max(1, r["b"]))
    if kind == "text_boolean":
        return d.names["boolean"] if d.any_boolean or not r["loose"] else d.text(texts)
    return d.text(texts) if kind == "text" else d.names[kind]


def column_types(df: DataFrame, to: str = "sqlserver", trim_strings: bool = False, snake: bool = False) -> list[ColumnType]:
    """A type for each column but the source row number, from the analysis of text columns and one aggregate for all."""
    d = dialect(to)
    fields = [f for f in df.schema.fields if f.name != ROW]
    found = infer.analyze(df.select(*[textops.named(f.name) for f in fields]), strip_blanks=trim_strings)
    plans = [_plan(f, found.get(f.name), trim_strings) for f in fields]
    row: dict = {}
    for i in range(0, len(fields), infer.CHUNK):
        part = range(i, min(i + infer.CHUNK, len(fields)))
        wanted = [F.count(F.lit(1)).alias("n"), *[F.count(textops.strip(textops.named(fields[j].name)) if trim_strings and isinstance(fields[j].dataType, T.StringType) else textops.named(fields[j].name)).alias(f"{j}|full") for j in part], *[x.alias(f"{j}|{k}") for j in part for k, x in plans[j][1].items()]]
        row |= df.agg(*wanted).first().asDict()
    out: list[ColumnType] = []
    for j, f in enumerate(fields):
        r = {k: row[f"{j}|{k}"] for k in plans[j][1]}
        name = unique_name(snake_case(f.name), [c.target for c in out]) if snake else f.name
        out.append(ColumnType(f.name, name, _name(plans[j][0], r, f.dataType, d), row[f"{j}|full"] < row["n"]))
    return out


def render(table: str, columns: list[ColumnType], to: str = "sqlserver", schema: str | None = None) -> str:
    """The statement, names and types in columns of their own."""
    d = dialect(to)
    names, types = [d.quote(c.target) for c in columns], [c.sql_type for c in columns]
    wide, broad = max(map(len, names)), max(map(len, types))
    full = f"{d.quote(schema)}.{d.quote(table)}" if schema else d.quote(table)
    body = [f"{'(   ' if i == 0 else '  , '}{n:<{wide}}  {t:<{broad}}  {'    null' if c.nullable else 'not null'}" for i, (n, t, c) in enumerate(zip(names, types, columns, strict=True))]
    return "\n".join([f"create table {full}", *body, ")", ";"])


def generate(df: DataFrame, table: str, to: str = "sqlserver", trim_strings: bool = False) -> dict[str, str]:
    """The statement with source names and with snake_case names, from one analysis."""
    own = column_types(df, to, trim_strings)
    neat: list[ColumnType] = []
    for c in own:
        neat.append(ColumnType(c.source, unique_name(snake_case(c.source), [x.target for x in neat]), c.sql_type, c.nullable))
    return {"as_is": render(table, own, to), "snake_case": render(snake_case(table), neat, to)}
