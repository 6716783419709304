"""Delimited text, all columns as text, in source order.

One permissive parse keeps what can be kept: short records are filled with nulls, records with too many fields, quotes that do not fit
or bytes that are not of the encoding become rejects. What the whole file shows against what its head was taken for changes the reading: bytes
that are no UTF-8 lead to a single-byte encoding, a quote that swallows the rest of the file is read as data, a single column tries the delimiter
that comes second. What the user sets is never changed.
"""

from __future__ import annotations

from dataclasses import replace
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.naming import column_names, table_name
from ..operators.profile import ROW
from . import sniff, tokens
from .options import Load, LoadError, Options, cleaned
from .records import Quoting, _dense, in_order, lines, records
from .store import UNDEFINED, Stored, as_latin

#: A delimiter that leaves one column is given up for the runner-up if that covers as much.
RUNNER_UP = 0.9
#: Lines before the data that other files may repeat.
HEADS = 200
#: Reading quotes as data must keep so many more rows, and more than this share of them.
MORE_ROWS, MORE_SHARE, LOOKED_AT = 5, 0.01, 1000


def preview_lines(path: str, n: int = 50, options: Options | dict | None = None, spark: SparkSession | None = None) -> dict:
    """The first n raw lines and all that detection says. With a session, of a path in any store that Spark reads."""
    p, o = Stored(spark, path) if spark else sniff.Local(path), cleaned(options)
    enc = sniff.detect_encoding(p)
    head = p.head(sniff.HEAD)[0].decode(sniff.codec(o.encoding or enc.name), "replace").removeprefix("\ufeff").splitlines()[:n]
    scores = sniff.score_delimiters(p, o.encoding or enc.name, o.quote)
    delimiter = o.delimiter or (scores[0].delimiter if scores else ",")
    return {"lines": head, "encoding": enc, "delimiters": scores, "layout": sniff.detect_layout(p, o.encoding or enc.name, delimiter, o.quote)}


def _header(p: Stored, encoding: str, delimiter: str, quote: str, first_row: int) -> list[str]:
    """The header's cells; a header that the encoding cannot read is read as Windows-1252."""
    raw = p.head(sniff.HEAD)[0]
    fallback = "cp1252" if encoding == "utf-8" else sniff.codec(encoding)
    for codec, marks in ((sniff.codec(encoding), ("\ufeff",)), (fallback, ("\ufeff", "ï»¿"))):
        text = raw.decode(codec, "replace")
        for mark in marks:
            text = text.removeprefix(mark)
        found = sniff.records(text, delimiter, quote)[0][first_row - 1 : first_row]
        if found and not any("\ufffd" in v for v in found[0][1]):
            break
    if not found:
        raise LoadError(f"no record {first_row} to take names from")
    return found[0][1]


def _parsed(text: Column, width: int, q: Quoting) -> Column:
    """The record's fields; empty ones are null."""
    options = {"sep": q.delimiter, "quote": q.quote or "\u0000", "escape": q.escape or q.quote or "\u0000", "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, width + 10)), "mode": "PERMISSIVE"}
    return F.from_csv(text, ", ".join(f"c{i} string" for i in range(width)), options)


def load(spark: SparkSession, path: str, options: Options | dict | None = None, taken: list[str] = ()) -> Load:
    """A file, a folder or a pattern of files in any store that Spark reads. Files are read in the order of their names; titles and a header
    are taken from the first, and lines of other files that repeat them in the same place are left out. The driver reads a head and a tail only."""
    p, o = Stored(spark, path), cleaned(options)
    if not p.exists:
        raise LoadError(f"no file {path}")
    guess = sniff.detect_encoding(p)
    if not o.encoding and guess.big_endian:
        raise LoadError("big-endian UTF-16 is not read; save the file as UTF-8")
    encoding = (o.encoding or guess.name).lower()
    limit = o.sample_size or sniff.HEAD_RECORDS
    scores = sniff.score_delimiters(p, encoding, o.quote, limit)
    delimiter = o.delimiter or (scores[0].delimiter if scores else ",")
    head, whole = sniff.head_text(p, encoding)
    if not head.strip("\r\n"):
        raise LoadError("the file is empty")
    layout = sniff.detect_layout(p, encoding, delimiter, o.quote, limit)
    first_row = layout.first_row if o.first_row is None else o.first_row
    recs = sniff.records(head, delimiter, o.quote, None)[0]
    skipped = (first_row or 0) + o.skip_rows
    names = column_names(_header(p, encoding, delimiter, o.quote, first_row)) if first_row else [f"col_{i}" for i in range(max(len(r) for _, r in (recs[o.skip_rows :] or recs)))]
    if len(names) == 1 and not o.delimiter:
        for s in scores[1:2]:
            if s.coverage >= RUNNER_UP and s.fields > 1:
                return load(spark, path, replace(o, delimiter=s.delimiter), taken)
    line_end = "\r" if "\n" not in head and "\r" in head else "\n"
    all_ = lines(spark, p.paths, encoding, line_end, o.parallel)
    begin = recs[skipped][0] if len(recs) > skipped else head.count(line_end) + 2 if whole else recs[-1][0] + 1
    body = all_.filter(F.col("_line") >= begin) if len(p.paths) == 1 else _without_heads(all_, begin, [x.removesuffix("\r") for x in head.split(line_end)][: min(begin - 1, HEADS)])
    body = body.persist() if o.materialize else body
    try:
        if encoding == "utf-8" and guess.clean and not guess.whole and not o.encoding and not body.filter("_wrong").isEmpty():
            # the whole file is no UTF-8 after all
            undefined = not body.filter("_wrong").filter(as_latin(F.col("_raw")).rlike(UNDEFINED)).isEmpty()
            return load(spark, path, replace(o, encoding="iso-8859-1" if undefined else "cp1252"), taken)
        return _loaded(spark, p, o, taken, body, names, Quoting(delimiter, o.quote, o.escape), layout, guess, encoding, first_row)
    finally:
        body.unpersist()


def _without_heads(all_: DataFrame, begin: int, heads: list[str]) -> DataFrame:
    """Lines from begin on; of the files after the first, all but those that repeat what the first has in the same place before begin."""
    again = F.get(F.array(*map(F.lit, heads)), (F.col("_place") - 1).cast("int")) == F.regexp_replace("_raw", r"\r\z", "") if heads else F.lit(False)
    top = (F.col("_place") < begin) & ((F.col("_line") == F.col("_place")) | F.coalesce(again, F.lit(False)))
    return all_.filter(~top)


def _kinds(recs: DataFrame, width: int, q: Quoting, strict: bool) -> DataFrame:
    """recs with _n fields and the _kind of what cannot be taken."""
    n = q.count(F.col("_text"))
    kind = F.when(F.col("_wrong"), "INVALID ENCODING").when(F.col("_bad") & F.lit(strict), "UNQUOTED VALUE").when((n > width) & ~F.col("_bad"), "TOO MANY COLUMNS")
    return recs.withColumns({"_n": n, "_kind": kind})


def _loaded(spark: SparkSession, p: Stored, o: Options, taken: list[str], body: DataFrame, names: list[str], q: Quoting, layout: sniff.Layout, guess: sniff.Encoding, encoding: str, first_row: int) -> Load:
    width, loose, held = len(names), False, []
    each = _kinds(records(body, q, held), width, q, o.strict_mode)
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count("_kind").alias("bad"), F.count_if(F.col("_kind") == "UNQUOTED VALUE").alias("open"), F.count_if(F.col("_kind").isNull() & (F.col("_n") < width)).alias("short"), F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines")).first()
    seen = facts(each)
    if seen["open"]:
        bare = Quoting(q.delimiter, "")
        plain = _kinds(records(body, bare, held), width, bare, o.strict_mode)
        other = facts(plain)
        gain = (other["n"] - other["bad"]) - (seen["n"] - seen["bad"])
        if gain > max(MORE_ROWS, (other["n"] - other["bad"]) * MORE_SHARE) and not _mostly_quoted(plain, width, bare, q.quote):
            each, seen, q, loose = plain, other, bare, True
    detected = o.skip_footer is None
    footer = 0 if loose and detected else layout.footer if detected else o.skip_footer
    if footer and detected and seen["lines"] > seen["n"]:
        # a tail that begins within a value takes its lines for summary records; such a record is a line of its own
        ends = each.select("_line", "_lines").orderBy(F.desc("_line")).limit(footer).collect()
        footer = next((k for k, r in enumerate(ends) if r["_lines"] > 1), footer)
    kept = each.filter(F.col("_kind").isNull()) if seen["bad"] else each
    total = seen["n"] - seen["bad"]
    # lines that are all rows need no counting: their numbers are those of the file
    straight = len(p.paths) == 1 and not seen["bad"] and seen["lines"] == seen["n"] == body.count()
    first = body.agg(F.min("_line")).first()[0] or 1
    rows = kept.drop("_lines", "_wrong", "_bad", "_kind", "_n")
    numbered = kept.withColumn(ROW, F.col("_line") - (first - 1)) if straight else in_order(rows, ROW) if "_run" in rows.columns else _dense(rows, "_line", ROW)
    numbered = numbered.filter(F.col(ROW) <= total - footer) if footer else numbered
    df = numbered.select(ROW, _parsed(F.col("_text"), width, q).alias("r")).select(F.col(ROW).cast("long").alias(ROW), *[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    if o.materialize:  # one table stays in the cache, the one that is handed out
        first_read = df.persist()
        df = tokens.nullify(first_read, o.nullify_tokens)
        if df is not first_read:
            df = df.persist()
            df.count()
            first_read.unpersist()
        else:
            df.count()
    else:
        df = tokens.nullify(df, o.nullify_tokens)
    rejected = None
    if seen["bad"] and not o.ignore_errors:
        rejected = each.filter(F.col("_kind").isNotNull()).select(F.col("_line").alias("line"), F.col("_lines").alias("lines"), F.col("_kind").alias("error_type"), F.col("_text").alias("csv_line"))
        if o.materialize:
            rejected = rejected.persist()
            rejected.count()
    if o.materialize:  # what comes out has been read; a table that is not kept still reads them
        for spans in held:
            spans.unpersist()
    said = {"encoding": encoding, "delimiter": q.delimiter, "first_row": first_row, "footer": footer, "rejects": seen["bad"], "quotes_as_data": loose, "padded": seen["short"] > 0, "row_count": max(0, total - footer), "layout": layout.why, "encoding_why": guess.why}
    return Load(o.name or table_name(PurePosixPath(p.path.rstrip("/")).stem, taken), df, rejected, "csv", said)


def _mostly_quoted(plain: DataFrame, width: int, bare: Quoting, quote: str) -> bool:
    """Whether most values of the first rows, read with quotes as data, begin and end with a quote."""
    some = plain.filter(F.col("_kind").isNull()).orderBy("_line").limit(LOOKED_AT).select(_parsed(F.col("_text"), width, bare).alias("r")).select("r.*")
    row = some.agg(*[F.count_if(F.col(c).startswith(quote) & F.col(c).endswith(quote)).alias(f"{c}q") for c in some.columns], *[F.count(c).alias(c) for c in some.columns]).first()
    return 2 * sum(row[f"{c}q"] for c in some.columns) > sum(row[c] for c in some.columns)
