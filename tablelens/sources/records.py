"""Records of a delimited text from its lines, without reading the file in one task.

A line is a function of whether it begins within quotes: it ends outside or inside in either case. Most lines change nothing or end
outside whatever was before, so the state before each line follows from the last line that settles it and the number of lines
between that turn it over. Runs of lines that follow each other in a task are surveyed for both beginnings, a row each; the driver composes
these rows, and a second pass joins lines within quotes to the record before them as they are read. Only pieces of records that go over a run's end move.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rownum import in_file_order
from .store import as_latin

CHARSETS = {"utf-8": "UTF-8", "utf-16": "UTF-16LE", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "cp1252": "windows-1252"}
BLOCK = 1 << 16
#: Facts of records that go over a run's end are broadcast up to so many.
FEW = 500_000


@dataclass(frozen=True)
class Quoting:
    """What a line looks like. Patterns are possessive: each is decided in one pass."""

    delimiter: str
    quote: str
    escape: str | None = None

    @property
    def _body(self) -> str:
        q, e = re.escape(self.quote), re.escape(self.escape or self.quote)
        return f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+" if e == q else f"[^{q}{e}]*+(?:{e}(?s:.)[^{q}{e}]*+)*+"

    @property
    def _fields(self) -> str:
        """Whole fields, each with the delimiter after it."""
        q, d = re.escape(self.quote), re.escape(self.delimiter)
        return f"(?:(?:{q}{self._body}{q}|(?!{q})[^{d}]*+){d})*+"

    @property
    def _rest(self) -> str:
        """A last field that is whole."""
        q, d = re.escape(self.quote), re.escape(self.delimiter)
        return rf"(?:{q}{self._body}{q}|(?!{q})[^{d}]*+)\r?\z"

    @property
    def opening(self) -> str:
        """From outside quotes: the line's last field is left open."""
        return rf"\A{self._fields}{re.escape(self.quote)}{self._body}\z"

    @property
    def sound(self) -> str:
        """From outside quotes: all fields are as they should be."""
        return rf"\A{self._fields}{self._rest}"

    @property
    def staying(self) -> str:
        """From within quotes: the line ends within quotes."""
        q, d = re.escape(self.quote), re.escape(self.delimiter)
        return rf"\A{self._body}(?:\z|{q}{d}{self._fields}{q}{self._body}\z)"

    @property
    def closing(self) -> str:
        """From within quotes: the quoted field ends and what follows is as it should be."""
        q, d = re.escape(self.quote), re.escape(self.delimiter)
        return rf"\A{self._body}{q}(?:\r?\z|{d}{self._fields}{self._rest})"

    def opens(self, line: Column) -> Column:
        return line.rlike(self.opening)

    def whole(self, line: Column) -> Column:
        return line.rlike(self.sound)

    def count(self, record: Column) -> Column:
        """How many fields: one more than delimiters outside quoted fields."""
        q = re.escape(self.quote) if self.quote else ""
        bare = F.regexp_replace(record, f"{q}{self._body}{q}", "") if q else record
        return F.length(bare) - F.length(F.replace(bare, F.lit(self.delimiter), F.lit(""))) + 1


#: Windows-1252 beyond Latin-1, fixed: what 0x80 to 0x9F stand for; U+FFFD where nothing is defined.
CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")
#: UTF-16, little-endian, as hexadecimal digits: units that are no half of a pair, and whole pairs.
_UNIT, _PAIR = "..(?:[0-9A-CEF].|D[0-7])", "..D[89AB]..D[C-F]"


def decoded(value: Column, encoding: str) -> tuple[Column, Column]:
    """The text of a line's bytes, and whether some are not of the encoding; these are U+FFFD. Settings of the session play no part."""
    charset = CHARSETS.get(encoding, encoding)
    raw = value.cast("binary")
    if charset == "UTF-8":
        return value, ~F.is_valid_utf8(value)
    if charset == "ISO-8859-1":
        return as_latin(value), F.lit(False)
    if charset == "windows-1252":
        text = F.translate(as_latin(value), CONTROLS, CP1252)
        return text, F.contains(text, F.lit("\ufffd"))
    if charset == "UTF-16LE":
        digits = F.hex(raw)
        digits = F.left(digits, F.length(digits) - F.length(digits) % 4)
        right = digits.rlike(rf"\A(?:{_UNIT}|{_PAIR})*+\z")
        # a half of a pair goes to where U+FFFD is put: what stands between whole units
        parts = F.regexp_replace(digits, rf"\G(?:({_PAIR}|{_UNIT})|..D[89A-F])", "$1,")
        mended = F.array_join(F.transform(F.split(F.regexp_replace(parts, r",\z", ""), ","), lambda u: F.when(u == "", "FDFF").otherwise(u)), "")
        return F.decode(F.unhex(F.when(right, digits).otherwise(mended)), "UTF-16LE"), ~right | (F.octet_length(raw) % 2 == 1)
    return _by_python(charset)(raw), F.contains(_by_python(charset)(raw), F.lit("\ufffd"))


def _by_python(charset: str):
    """For encodings that Spark does not know."""

    @F.pandas_udf("string")
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else bytes(b).decode(charset, "replace"))

    return read


def lines(spark: SparkSession, path: str | list[str], encoding: str, line_end: str = "\n", parallel: bool = True) -> DataFrame:
    """(_line from 1, _place, _raw, _wrong): the decoded lines in the order of files and of lines within, and whether their bytes are not of the encoding.

    _place is the line within the file.
    """
    paths = [path] if isinstance(path, str) else path
    wide = CHARSETS.get(encoding, encoding).startswith("UTF-16")
    reader = spark.read.option("lineSep", line_end)
    df = (reader.option("encoding", "UTF-16LE") if wide else reader).text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
    df = df if parallel else df.coalesce(1)
    numbered = in_file_order(df, F.col("_file"), F.col("_at"), "_line", "_place").select("_line", "_place", "value")
    raw, wrong = decoded(F.col("value"), encoding)
    raw = F.when(F.col("_place") == 1, F.regexp_replace(raw, "\\A\ufeff", "")).otherwise(raw)
    return numbered.select("_line", "_place", raw.alias("_raw"), wrong.alias("_wrong"))


def _matcher(pattern: str) -> Callable[[bytes], bool]:
    """Of a line's bytes, as Spark's rlike has it."""
    match = re.compile(pattern.replace(r"\z", r"\Z")).match
    return lambda raw: match(raw.decode("utf-8", "replace")) is not None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, np.ndarray, pa.RecordBatch]]:
    """(whether a run begins, numbers of lines, their batch): parts of batches whose lines follow each other."""
    last = None
    for b in batches:
        line = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(line) != 1) + 1).tolist(), len(line)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start < end:
                yield last is None or line[start] != last + 1, line[start:end], b.slice(start, end - start)
                last = int(line[end - 1])


def _quoted(raw: pa.Array, quote: bytes) -> tuple[list[int], list[bytes]]:
    """Places and bytes of lines with a quote."""
    at = np.flatnonzero(pc.match_substring(raw, quote).to_numpy(zero_copy_only=False))
    return at.tolist(), raw.take(pa.array(at)).to_pylist()


#: Of a run that begins outside (0) or within quotes (1): how it ends, and where the record that is open then began, null if before the run; where
#: a record from before the run ends, and whether badly.
_SURVEY = "first long, last long, after0 boolean, begin0 long, after1 boolean, begin1 long, end1 long, bad1 boolean"


def _survey(q: Quoting) -> Callable:
    quote = q.quote.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, stays, closes = map(_matcher, (q.opening, q.staying, q.closing))
        out = []
        for fresh, line, b in _runs(batches):
            if fresh:
                out.append({"first": int(line[0]), "after0": False, "begin0": None, "after1": True, "begin1": None, "end1": None, "bad1": None})
            r = out[-1]
            r["last"] = int(line[-1])
            for at, text in zip(*_quoted(b.column(1), quote), strict=True):
                then = {s: (stays if s else opens)(text) for s in {r["after0"], r["after1"]}}
                for h in "01":
                    before, after = r["after" + h], then[r["after" + h]]
                    if not before and after:
                        r["begin" + h] = int(line[at])
                    elif before and not after:
                        if h == "1" and r["begin1"] is None and r["end1"] is None:
                            r["end1"], r["bad1"] = int(line[at]), not closes(text)
                        r["begin" + h] = None
                    r["after" + h] = after
        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_pylist(out, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _SURVEY.split(", "))]))

    return run


@dataclass(frozen=True)
class _Plan:
    """What a second pass has to know: for each run, where the record that is open at its beginning began; of records over several runs, where
    they end and whether badly; an open quote that never closes, and the last line."""

    carried: dict[int, int | None]
    ends: dict[int, tuple[int, bool]]
    rest: int | None
    last: int


def _planned(found: list) -> _Plan:
    carried, ends, begun = {}, {}, None
    for r in sorted(found, key=lambda r: r["first"]):
        carried[r["first"]] = begun
        if begun is None:
            begun = r["begin0"]
        elif r["end1"] is not None:
            ends[begun] = (r["end1"], r["bad1"])
            begun = r["begin1"]
    return _Plan(carried, ends, begun, max((r["last"] for r in found), default=0))


_RECORDS = pa.schema([("_line", pa.int64()), ("_lines", pa.int64()), ("_text", pa.binary()), ("_wrong", pa.bool_()), ("_bad", pa.bool_()), ("_run", pa.int64()), ("_part", pa.int64())])


def _tidied(text: pa.Array) -> pa.Array:
    ends = pc.ends_with(text, b"\r")
    return pc.if_else(ends, pc.binary_slice(text, 0, -1), text) if pc.any(ends).as_py() else text


def _assembled(q: Quoting, plan: _Plan) -> Callable:
    """Records of the lines of each run. Of a record over several runs, pieces with the run as _part; of one whose quotes do not fit its first line only,
    as it may have swallowed any number."""
    quote = q.quote.encode()

    class Open:
        """A record that is not at its end yet; of no use are lines of one that is known to end badly."""

        def __init__(self, begin: int, first: bytes | None, wrong: bool) -> None:
            self.begin, self.first, self.first_wrong, self.wrong, self.texts = begin, first, wrong, False, []
            self.lost = begin == plan.rest or plan.ends.get(begin, (0, False))[1]

        def add(self, raw: pa.Array, wrong: np.ndarray) -> None:
            if not self.lost and len(raw):
                self.texts.append(b"\n".join(raw.to_pylist()))
                self.wrong |= bool(wrong.any())

        def whole(self, end: int, bad: bool, run: int) -> dict:
            text = self.first if bad else b"\n".join(self.texts)
            return {"_line": self.begin, "_lines": end - self.begin + 1, "_text": text.removesuffix(b"\r"), "_wrong": self.first_wrong if bad else self.wrong, "_bad": bad, "_run": run, "_part": None}

        def piece(self, run: int) -> list[dict]:
            return [] if self.lost else [{"_line": self.begin, "_lines": 0, "_text": b"\n".join(self.texts), "_wrong": self.wrong, "_bad": False, "_run": run, "_part": run}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opens, stays, closes, sound = map(_matcher, (q.opening, q.staying, q.closing, q.sound))
        now, first = None, 0
        rows = lambda found: pa.RecordBatch.from_pylist(found, _RECORDS)
        for fresh, line, b in _runs(batches):
            if fresh:
                if now:
                    yield rows(now.piece(first))
                first = int(line[0])
                begun = plan.carried[first]
                now = None if begun is None else Open(begun, None, False)
            raw, wrong = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            # a line that begins outside quotes begins a record
            inside, turns, odd, at_end = now is not None, np.zeros(len(line) + 1, np.int8), [], False
            for at, text in zip(*_quoted(raw, quote), strict=True):
                after = (stays if inside else opens)(text)
                turns[at + 1] = after != inside
                if not after and not (closes if inside else sound)(text):
                    odd.append(at)
                inside = after
            starts = np.flatnonzero((np.cumsum(turns[:-1]) + (now is not None)) % 2 == 0)
            stop = int(starts[0]) if len(starts) else len(line)
            if now:
                now.add(raw.slice(0, stop), wrong[:stop])
                if stop < len(line) or not inside:
                    at_end = bool(odd) and odd[0] == stop - 1
                    if plan.carried[first] == now.begin:
                        yield rows(now.piece(first))
                    else:
                        yield rows([now.whole(int(line[stop - 1]), at_end, first)])
                    now = None
            if not len(starts):
                continue
            tail = int(starts[-1]) if inside else len(line)
            starts = starts[:-1] if inside else starts
            if len(starts):
                bounds = np.append(starts, tail)
                ends, lone = bounds[1:] - 1, np.diff(bounds) == 1
                bad = np.isin(ends, odd)
                firsts = raw.take(pa.array(starts))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), raw), b"\n") if not lone.all() else firsts
                any_wrong = np.logical_or.reduceat(wrong[:tail], starts)
                cut = bad & ~lone
                if cut.any():
                    text, any_wrong = pc.if_else(pa.array(cut), firsts, text), np.where(cut, wrong[starts], any_wrong)
                text, n = _tidied(text), len(starts)
                got = pa.RecordBatch.from_arrays([pa.array(line[starts]), pa.array(line[ends] - line[starts] + 1), text, pa.array(any_wrong), pa.array(bad), pa.array(np.full(n, first)), pa.nulls(n, pa.int64())], schema=_RECORDS)
                yield got.filter(pc.greater(pc.binary_length(text), 0))
            if inside:
                now = Open(int(line[tail]), raw[tail].as_py(), bool(wrong[tail]))
                if now.lost:
                    yield rows([now.whole(plan.last if now.begin == plan.rest else plan.ends[now.begin][0], True, first)])
                now.add(raw.slice(tail), wrong[tail:])
        if now:
            yield rows(now.piece(first))

    return run


def _dense(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with a dense number from 1 by its ascending column: places within blocks of BLOCK values and a prefix sum over the blocks."""
    marked = df.withColumn("_blk", F.floor(F.col(by) / BLOCK))
    sizes = marked.groupBy("_blk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_blk", F.coalesce(F.sum("_n").over(W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy("_blk").orderBy(by))
    return marked.withColumn("_place", place).join(F.broadcast(offsets), "_blk").withColumn(name, (F.col("_off") + F.col("_place")).cast("long")).drop("_blk", "_off", "_place")


def records(body: DataFrame, q: Quoting, held: list[DataFrame] | None = None) -> DataFrame:
    """(_line where it begins, _lines it takes, _text, _wrong, _bad): records of lines, blank ones left out. _bad: quotes that do not fit.

    With quotes that go over lines also _run, which orders the records together with the places within it, and _over, whether it goes over a run's end. Runs are short if body's
    lines are not in order. held gets what is kept on disk for them, to be released when they have been read.
    """
    raw = F.col("_raw")
    tidy = lambda c: F.when(F.endswith(c, F.lit("\r")), F.left(c, F.length(c) - 1)).otherwise(c)
    if not q.quote or body.filter(F.contains(raw, F.lit(q.quote)) & q.opens(raw)).isEmpty():
        bad = F.lit(False) if not q.quote else F.contains(raw, F.lit(q.quote)) & ~q.whole(raw)
        return body.select("_line", F.lit(1).cast("long").alias("_lines"), tidy(raw).alias("_text"), "_wrong", bad.alias("_bad")).filter(F.col("_text") != "")
    flat = body.select(F.col("_line").cast("long"), raw.cast("binary").alias("_raw"), "_wrong")
    # a row for each run, a split of a file as a rule
    plan = _planned(flat.mapInArrow(_survey(q), _SURVEY).collect())
    made = flat.mapInArrow(_assembled(q, plan), "_line long, _lines long, _text binary, _wrong boolean, _bad boolean, _run long, _part long").withColumn("_text", F.col("_text").cast("string")).persist(StorageLevel.DISK_ONLY)
    if held is not None:
        held.append(made)
    whole = made.filter("_part is null").drop("_part").withColumn("_over", F.lit(False))
    over = body.sparkSession.createDataFrame([(begin, end - begin + 1) for begin, (end, bad) in plan.ends.items() if not bad], "_line long, _all long")
    pieces = made.filter("_part is not null").select("_line", "_text", "_wrong", "_part").join(F.broadcast(over) if len(plan.ends) <= FEW else over.hint("merge"), "_line")
    pieces = pieces.groupBy("_line").agg(F.first("_all").alias("_lines"), F.array_sort(F.collect_list(F.struct("_part", "_text"))).alias("_of"), F.max("_wrong").alias("_wrong"))
    text = tidy(F.array_join(F.transform("_of", lambda x: x["_text"]), "\n"))
    return whole.unionByName(pieces.select("_line", "_lines", text.alias("_text"), "_wrong", F.lit(False).alias("_bad"), F.col("_line").alias("_run"), F.lit(True).alias("_over")))


def in_order(recs: DataFrame, name: str) -> DataFrame:
    """Some of records() that have a _run, with dense numbers from 1. A row for each run and each record that goes over a run's end is counted; texts do not move."""
    placed = recs.withColumn("_m", F.monotonically_increasing_id())
    # a record that goes over a run's end is the last to begin in it
    sizes = placed.groupBy("_run").agg(F.min("_m").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(sizes.select("_run", "_low", before.alias("_before"))), "_run")
    return out.withColumn(name, F.col("_before") + 1 + F.when(F.col("_over"), 0).otherwise(F.col("_m") - F.col("_low"))).drop("_run", "_over", "_m", "_low", "_before")
