"""Column profiles: one aggregate for all counts, and one small query each for top values, outliers and first rows."""

from __future__ import annotations

import datetime as dt
import math
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, textops

ROW = "_src_row_num"
# Fixed value: what counts as an address in a profile.
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\z"
#: Quantiles cut a range into so many parts, until a part has few values.
SLICES, FEW = 4096, 10_000
FINITE = 1.7976931348623157e308
SNIFFED = ("date", "timestamp", "bigint", "double", "boolean")


def kind_of(t: T.DataType) -> str:
    """numeric, varchar, temporal or other; lists of numbers are other."""
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType | T.NullType | T.VarcharType | T.CharType):
        return "varchar"
    return "temporal" if isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) else "other"


def as_text(c: Column, t: T.DataType) -> Column:
    return casts.number_text(c.cast("double")) if isinstance(t, T.DoubleType | T.FloatType) else c.cast("string")


def common_facts(c: Column) -> dict[str, Column]:
    return {"row_count": F.count(F.lit(1)), "non_null_count": F.count(c), "distinct_count": F.count_distinct(c), "min_value": F.min(c), "max_value": F.max(c)}


def numeric_facts(c: Column) -> dict[str, Column]:
    d = c.cast("double")
    return {"zero_count": F.count_if(c == 0), "negative_count": F.count_if(c < 0), "mean": F.avg(d), "stddev": F.stddev_samp(d)}


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, between neighbours where a rank falls between two values, without gathering the values.

    The range of the values is cut into SLICES like parts and counted; the part that holds each rank is cut again until it has few
    values or only one, and these few are sorted. A pass over the column for each cut; a table of SLICES counts for each reaches the driver.
    """
    values = df.select(textops.named(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    ranks = sorted({r for p in shares for r in (int((n - 1) * p), min(n - 1, int((n - 1) * p) + 1))})
    found: dict[int, float] = {}
    todo = [(low, high, 0, n, ranks)]
    while todo:
        parts = {i: p for i, p in enumerate(todo)}
        small = {i: p for i, p in parts.items() if p[3] <= FEW or p[0] == p[1] or math.nextafter(p[0], math.inf) >= p[1]}
        within = lambda p: F.col("v").between(p[0], p[1])
        if small:
            part = F.coalesce(*[F.when(within(p), i) for i, p in small.items()])
            each = values.select(part.alias("part"), "v").filter("part is not null").groupBy("part", "v").agg(F.count(F.lit(1)).alias("k")).collect()
            for i, (_, _, before, _, wanted) in small.items():
                at = before
                for r in sorted((r for r in each if r["part"] == i), key=lambda r: r["v"]):
                    found |= {w: r["v"] for w in wanted if at <= w < at + r["k"]}
                    at += r["k"]
        wide = {i: p for i, p in parts.items() if i not in small}
        todo = []
        if wide:
            bound = lambda x: min(max(x, -FINITE), FINITE) / 2  # noqa: E731  halves, as a range may be wider than the widest number
            half = F.greatest(F.lit(-FINITE), F.least(F.lit(FINITE), F.col("v"))) / 2
            cut = lambda p: F.least(F.lit(SLICES - 1), F.floor((half - F.lit(bound(p[0]))) / F.lit(max((bound(p[1]) - bound(p[0])) / SLICES, 5e-324))).cast("int"))
            key = F.coalesce(*[F.when(within(p), F.struct(F.lit(i).alias("part"), cut(p).alias("slice"))) for i, p in wide.items()])
            counts = values.select(key.alias("key"), "v").filter("key is not null").groupBy("key.part", "key.slice").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for i, (_, _, before, _, wanted) in wide.items():
                at = before
                for r in sorted((r for r in counts if r["part"] == i), key=lambda r: r["low"]):
                    mine = [w for w in wanted if at <= w < at + r["k"]]
                    if mine:
                        todo.append((r["low"], r["high"], at, r["k"], mine))
                    at += r["k"]
    out = []
    for p in shares:
        x, k = (n - 1) * p, int((n - 1) * p)
        a, b = found[k], found[min(n - 1, k + 1)]
        out.append(a if a == b or x == k else a + (b - a) * (x - k))
    return out


def varchar_facts(c: Column) -> dict[str, Column]:
    sniff = {"date": casts.to_date(c), "timestamp": casts.to_timestamp(c), "bigint": casts.to_bigint(c), "double": casts.to_double(c), "boolean": casts.to_boolean(c)}
    return {
        "min_length": F.min(F.length(c)),
        "max_length": F.max(F.length(c)),
        "empty_count": F.count_if(c == ""),
        "whitespace_only_count": F.count_if(c.rlike(r"^[ \t\n\x0b\f\r]+\z")),
        "edge_space_count": F.count_if(textops.has_edge_spaces(c)),
        "unicode_edge_count": F.count_if(textops.has_wide_edge_blanks(c)),
        "contains_space_count": F.count_if(F.instr(c, " ") > 0),
        "email_count": F.count_if(c.rlike(EMAIL)),
    } | {f"sniff_{k}": F.count(sniff[k]) for k in SNIFFED}


def temporal_facts(c: Column, as_of: Column) -> dict[str, Column]:
    return {"earliest": F.min(c), "latest": F.max(c), "future_count": F.count_if(c > as_of), "unique_years": F.count_distinct(F.year(c)), "range_days": F.datediff(F.max(c).cast("date"), F.min(c).cast("date"))}


def top_values(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """(value, count): the most frequent values as text, ties by text."""
    return df.filter(textops.named(column).isNotNull()).groupBy(as_text(textops.named(column), df.schema[column].dataType).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc("value")).limit(n)


def facts(df: DataFrame, column: str, as_of: Column | None = None) -> DataFrame:
    """One row: every metric of the column's kind, by a single pass but for the quantiles of numbers."""
    c, kind = textops.named(column), kind_of(df.schema[column].dataType)
    wanted = common_facts(c)
    if kind == "numeric":
        wanted |= numeric_facts(c)
    elif kind == "varchar":
        wanted |= varchar_facts(c.cast("string"))
    elif kind == "temporal":
        wanted |= temporal_facts(c, as_of if as_of is not None else F.current_timestamp())
    row = df.agg(*[v.alias(k) for k, v in wanted.items()])
    if kind == "numeric":
        q1, median, q3 = quantiles(df, column, [0.25, 0.5, 0.75])
        row = row.select("*", *[F.lit(v).cast("double").alias(k) for k, v in (("median", median), ("q1", q1), ("q3", q3))])
    return row


def outliers(df: DataFrame, column: str, q1: float, q3: float) -> DataFrame:
    """Rows outside 1.5 interquartile ranges beyond the quartiles."""
    spread = 1.5 * (q3 - q1)
    return df.filter((textops.named(column) < q1 - spread) | (textops.named(column) > q3 + spread))


def first_rows(df: DataFrame, column: str, lengths: dict[str, int]) -> dict[str, int | None]:
    """The smallest source row whose text has each of the lengths."""
    row = df.agg(*[F.min(F.when(F.length(textops.named(column)) == n, F.col(ROW))).alias(k) for k, n in lengths.items()]).first()
    return row.asDict()


def _share(part: int, whole: int) -> float:
    return round(100.0 * part / whole, 2) if whole else 0.0


def profile(df: DataFrame, column: str, as_of: dt.datetime | None = None) -> dict[str, Any]:
    """Everything about a column, as JSON-safe values."""
    t = df.schema[column].dataType
    kind = kind_of(t)
    row = facts(df, column, None if as_of is None else F.lit(as_of)).first().asDict()
    n, full = row["row_count"], row["non_null_count"]
    ends = df.agg(as_text(F.min(textops.named(column)), t).alias("a"), as_text(F.max(textops.named(column)), t).alias("b")).first() if kind != "other" else (None, None)
    out: dict[str, Any] = {"column": column, "kind": kind, "type": t.simpleString(), "row_count": n, "non_null_count": full, "null_count": n - full, "distinct_count": row["distinct_count"], "min": ends[0], "max": ends[1], "fill_pct": _share(full, n), "cardinality_pct": _share(row["distinct_count"], n)}
    out["top_values"] = [{"value": r["value"], "count": r["count"], "pct": _share(r["count"], full)} for r in top_values(df, column).collect()]
    if kind == "numeric":
        cut = {k: None if row[k] is None else round(row[k], 4) for k in ("mean", "median", "stddev", "q1", "q3")}
        out |= {"zero_count": row["zero_count"], "negative_count": row["negative_count"], **cut, "iqr": None, "outlier_count": 0}
        if row["q1"] is not None:
            out |= {"iqr": round(row["q3"] - row["q1"], 4), "outlier_count": outliers(df, column, row["q1"], row["q3"]).count()}
    elif kind == "varchar":
        out |= {k: row[k] for k in row if k.endswith(("_length", "_count")) and k not in ("row_count", "non_null_count", "distinct_count")}
        out |= {"sniff": {k: _share(row[f"sniff_{k}"], full) for k in SNIFFED}, "min_length_row": None, "max_length_row": None}
        if ROW in df.columns and full:
            out |= first_rows(df, column, {"min_length_row": row["min_length"], "max_length_row": row["max_length"]})
    elif kind == "temporal":
        out |= {"earliest": out["min"], "latest": out["max"], "future_count": row["future_count"], "unique_years": row["unique_years"], "range_days": row["range_days"]}
    return out


def summarize(df: DataFrame) -> DataFrame:
    """(column_name, column_type, row_count, null_count, distinct_count, min, max): a row per column.

    One pass for all but the distinct counts. Of these, values are reduced to one of each per task and column before they are shuffled, so a
    column of few values moves little and one of many is spread by value, whatever the number of columns.
    """
    cols = [c for c in df.columns if kind_of(df.schema[c].dataType) != "other"]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (F.count(textops.named(c)).alias(f"{i}|k"), as_text(F.min(textops.named(c)), df.schema[c].dataType).alias(f"{i}|a"), as_text(F.max(textops.named(c)), df.schema[c].dataType).alias(f"{i}|b"))]).first()
    # two hashes of a value stand for it: rows of fixed width
    keys = [F.when(textops.named(c).isNotNull(), F.struct(F.lit(i).alias("c"), F.xxhash64(textops.named(c)).alias("x"), F.xxhash64(F.lit(i), textops.named(c)).alias("y"))) for i, c in enumerate(cols)]
    distinct = {}
    if keys:
        each = df.select(F.explode_outer(F.array(*keys)).alias("v")).filter("v is not null").select("v.c", "v.x", "v.y").distinct()
        distinct = {r["c"]: r["d"] for r in each.groupBy("c").agg(F.count(F.lit(1)).alias("d")).collect()}
    rows = [(c, df.schema[c].dataType.simpleString(), row["n"], row["n"] - row[f"{i}|k"], distinct.get(i, 0), row[f"{i}|a"], row[f"{i}|b"]) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_type string, row_count long, null_count long, distinct_count long, min string, max string")
