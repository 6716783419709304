"""User SQL: results with paging, cancelling, typed nulls, and rewrites of constructs that Spark spells otherwise."""

from __future__ import annotations

import glob
import hashlib
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ordered
from ..operators.derive import auto_derive
from ..operators.profile import ROW, summarize
from ..scratch import materialize, work_dir
from ..session import recursion, semantics
from ..sources import delimited, excel
from .dialect import SKIP, File, by_name, files, install, translate

WINDOW = 500
RECURSIVE = re.compile(r"\bwith\s+recursive\b", re.IGNORECASE)
RESULT_WORDS = ("SELECT", "WITH", "FROM", "VALUES", "TABLE", "DESCRIBE", "SUMMARIZE")


def bare(sql: str) -> str:
    """The statement after leading comments, blanks and parentheses."""
    return re.sub(r"\A(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?(?:\*/|\Z)|\()+", "", sql, flags=re.DOTALL)


def gives_rows(sql: str) -> bool:
    return bare(sql).upper().startswith(RESULT_WORDS)


def statements(sql: str) -> list[str]:
    """The text cut at semicolons outside quotes and comments."""
    masked = SKIP.sub(lambda m: "x" * len(m[0]) if m[0][0] in "'\"`" else " " * len(m[0]), sql)
    out, start = [], 0
    for m in re.finditer(";", masked + ";"):
        if masked[start : m.start()].strip():
            out.append(sql[start : m.start()].strip())
        start = m.end()
    return out


def _typed(t: T.DataType) -> T.DataType:
    if isinstance(t, T.NullType):
        return T.StringType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_typed(t.elementType), t.containsNull)
    if isinstance(t, T.MapType):
        return T.MapType(_typed(t.keyType), _typed(t.valueType), t.valueContainsNull)
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _typed(f.dataType), f.nullable, f.metadata) for f in t.fields])
    return t


def without_nulls_type(df: DataFrame) -> DataFrame:
    """Untyped nulls as text, at any depth."""
    new = [_typed(f.dataType) for f in df.schema.fields]
    if new == [f.dataType for f in df.schema.fields]:
        return df
    return df.select(*[F.col(f"`{f.name}`").cast(t).alias(f.name) for f, t in zip(df.schema.fields, new, strict=True)])


def statement(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A statement in Spark's own words that gives rows. One that calls itself is run at once, as Spark holds it to a million rows else."""
    found = without_nulls_type(spark.sql(text, **tables))
    if not RECURSIVE.search(SKIP.sub(" ", text)):
        return found
    with recursion(spark):
        return materialize(found, work_dir(spark))


def json_safe(v):
    return v if v is None or isinstance(v, bool | int | float | str) else str(v)


class Frames:
    """What a statement's text asks of DataFrame operators: each takes parts of it, (what leads, FROM and WHERE), and gives the name of a view, or
    None where it does not apply."""

    def __init__(self, runner: Runner, tables: dict[str, DataFrame]):
        self.runner, self.tables = runner, tables

    def _frame(self, part: tuple[str, str], items: str = "*") -> DataFrame | None:
        """Items of a part of the statement; None where it does not stand by itself."""
        try:
            text = translate(f"{part[0]} select {items} {part[1]}", lambda q: self.runner.spark.sql(q, **self.tables).columns)
            install(self.runner.spark, text)
            return self.runner.spark.sql(text, **self.tables)
        except AnalysisException:
            return None

    def _view(self, df: DataFrame) -> str:
        name = f"_frame_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _with(self, part: tuple[str, str], wanted: list[str]) -> tuple[DataFrame, list[str]] | None:
        """The columns of a part and, as _e0, _e1 and so on, what is wanted of it; and its own columns' names."""
        own = self._frame(part)
        if own is None or any(c.startswith("_e") or c in ("_left", "_right", "_number") for c in own.columns):
            return None
        more = self._frame(part, ", ".join(["*", *(f"{e} as _e{i}" for i, e in enumerate(wanted))]))
        return None if more is None else (more, own.columns)

    def asof(self, left: tuple[str, str], right: tuple[str, str], keys: list[tuple[str, str]], at: tuple[str, str], how: str, outer: bool) -> tuple[str, list[str]] | None:
        sides = self._with(left, [*(a for a, _ in keys), at[0]]), self._with(right, [*(b for _, b in keys), at[1]])
        if None in sides:
            return None
        (a, own), (b, columns) = sides
        found = ordered.asof(a, b, [(F.col(f"_e{i}"), F.col(f"_e{i}")) for i in range(len(keys))], (F.col(f"_e{len(keys)}"), F.col(f"_e{len(keys)}")), how, self.runner.bin_rows)
        found = found if outer else found.filter(F.col("_right").isNotNull())
        return self._view(found.select(*[F.col("_left").getField(c).alias(c) for c in own], "_right")), columns

    def positional(self, left: tuple[str, str], right: tuple[str, str]) -> tuple[str, list[str], list[str]] | None:
        a, b = self._frame(left), self._frame(right)
        return None if a is None or b is None else (self._view(ordered.positional(a, b)), a.columns, b.columns)

    def intervals(self, left: tuple[str, str], right: tuple[str, str], keys: list[tuple[str, str]], bounds: tuple[str, str, str], closed: tuple[bool, bool], flip: bool) -> tuple[str, list[str], list[str]] | None:
        """bounds: the point, and what it is above and below; flip if the point is the right relation's."""
        point, low, high = bounds
        wanted = [[a for a, _ in keys], [b for _, b in keys]]
        wanted[flip].append(point)
        wanted[not flip] += [low, high]
        sides = self._with(left, wanted[0]), self._with(right, wanted[1])
        if None in sides:
            return None
        (a, own), (b, columns) = sides
        k = len(keys)
        numbers = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
        used = [a.schema[f"_e{i}"].dataType for i in range(k, len(wanted[0]))] + [b.schema[f"_e{i}"].dataType for i in range(k, len(wanted[1]))]
        if not all(isinstance(t, numbers) for t in used) or len({isinstance(t, T.NumericType) or type(t) for t in used}) > 1:
            return None
        points, others = (b, a) if flip else (a, b)
        pairs = [(F.col(f"_e{i}"), F.col(f"_e{i}")) for i in range(k)]
        found = ordered.interval_join(points, others, pairs, F.col(f"_e{k}"), F.col(f"_e{k}"), F.col(f"_e{k + 1}"), closed)
        found = found.select(F.col("_right").alias("_left"), F.col("_left").alias("_right")) if flip else found
        return self._view(found), own, columns

    def numbered(self, part: tuple[str, str]) -> str | None:
        df = self._frame(part)
        return None if df is None or "_number" in df.columns else self._view(ordered.numbered(df, "_number"))

    def _large(self, df: DataFrame, keys: list[str]) -> bool:
        """Whether a key has more rows than one task should sort."""
        return bool(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > self.runner.bin_rows).take(1))

    def running(self, part: tuple[str, str], keys: list[str], order: str, wanted: list[tuple[str, str]]) -> tuple[str, list[str]] | None:
        """wanted: kinds of running values and what they are of."""
        side = self._with(part, [*keys, order, *(of for _, of in wanted)])
        if side is None:
            return None
        df, own = side
        k = len(keys)
        if not self._large(df, [f"_e{i}" for i in range(k)]):
            return None
        names = [f"_running{uuid.uuid4().hex[:8]}" for _ in wanted]
        values = {n: ordered.Running(kind, F.col(f"_e{k + 1 + i}")) for i, (n, (kind, _)) in enumerate(zip(names, wanted, strict=True))}
        found = ordered.running(df, [F.col(f"_e{i}") for i in range(k)], F.col(f"_e{k}"), values, self.runner.bin_rows)
        return self._view(found.select(*[f"`{c}`" for c in own], *names)), names

    def quantiles(self, part: tuple[str, str], keys: list[str], value: str, shares: list[float]) -> str | None:
        df = self._frame(part, ", ".join([*(f"{k} as _k{i}" for i, k in enumerate(keys)), f"{value} as _x"]))
        if df is None or not isinstance(df.schema["_x"].dataType, T.NumericType):
            return None
        names = [f"_k{i}" for i in range(len(keys))]
        groups, top = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)), F.max("_n")).first()
        if not groups or top <= self.runner.bin_rows:
            return None
        found = ordered.quantiles(df, [F.col(n) for n in names], F.col("_x"), shares, self.runner.bin_rows)
        # all rows meet their group's: where groups are few, no row is dealt out by them
        return self._view(F.broadcast(found) if groups * (len(keys) + len(shares)) <= ordered.FEW else found)


@dataclass
class Runner:
    """Runs one statement at a time and holds its result until the next. Pages beyond the first keep it in the cache."""

    spark: SparkSession
    result: DataFrame | None = None
    running: bool = False
    tag: str = field(default_factory=lambda: f"sql-{uuid.uuid4().hex}")
    #: Rows of a key that one task sorts at most; larger keys are cut by ranges of the order.
    bin_rows: int = ordered.LIMIT

    def query(self, sql: str, **tables: DataFrame) -> DataFrame:
        """A statement that gives rows; tables stand in it as {name}. It means the same in any session: casts and divisions that fail give null."""
        with semantics(self.spark):
            return self._query(sql, **tables)

    def _query(self, sql: str, **tables: DataFrame) -> DataFrame:
        sql = sql.strip().rstrip(";")
        first, *others = by_name(sql)
        if others:
            out = self._query(first[0], **tables)
            for branch, keep in others:
                out = out.unionByName(self._query(branch, **tables), allowMissingColumns=True)
                out = out if keep else out.distinct()
            return out
        text = translate(self._with_files(sql), lambda q: self.spark.sql(q, **tables).columns, Frames(self, tables))
        install(self.spark, text)
        if m := re.match(r"summarize\s+(.*)", bare(text), re.IGNORECASE | re.DOTALL):
            source = m[1].strip()
            return summarize(self.spark.sql(source) if gives_rows(source) else self.spark.table(source))
        return statement(self.spark, text, **tables)

    def _with_files(self, sql: str) -> str:
        """Files named in the statement become views. Columns of text files get types, as the dialect's reader gives them."""
        for f in reversed(files(sql)):
            view = f"__file_{hashlib.md5(repr((f.kind, f.paths, f.options)).encode()).hexdigest()}"
            self._read(f).createOrReplaceTempView(view)
            sql = f"{sql[: f.start]} {view} {sql[f.end :]}"
        return sql

    def _read(self, f: File) -> DataFrame:
        if f.kind in ("parquet", "json"):
            return self.spark.read.format(f.kind).load(list(f.paths))
        if f.kind not in ("csv", "xlsx"):
            raise ValueError(f"{f.paths[0]}: no reader for {f.kind}")
        options = {k: v for k, v in f.options.items() if k not in ("all_varchar", "header")}
        if f.options.get("header") is False:
            options["first_row"] = 0
        found: list[DataFrame] = []
        for path in (p for x in f.paths for p in (sorted(glob.glob(x)) or [x])):
            load = delimited.load(self.spark, path, options) if f.kind == "csv" else excel.load_sheet(self.spark, path, options=options)
            found.append(load.df.drop(ROW))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
        return df if f.options.get("all_varchar") else auto_derive(df)

    def run(self, sql: str, window: int = WINDOW, change: Callable[[str], bool] | None = None) -> dict:
        """Statements that give no rows are offered to change first. ok, columns, the first rows, row_count, truncated, elapsed_ms; or ok false and the error."""
        began = time.monotonic()
        self.drop()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)  # tags of the context, unlike those of the session, can be cancelled from any thread
        self.running = True
        try:
            if not gives_rows(sql):
                for one in statements(sql):
                    if change is not None and change(one):
                        continue
                    with semantics(self.spark):
                        text = translate(one)
                        install(self.spark, text)
                        self.spark.sql(text).collect()
                return {"ok": True, "columns": [], "rows": [], "row_count": 0, "truncated": False, "elapsed_ms": int(1000 * (time.monotonic() - began))}
            self.result = self.query(sql)
            # the first window needs no more than its rows; what is beyond is worked out when it is asked for
            with semantics(self.spark):
                rows = self.page(0, window + 1)
            more = len(rows) > window
            return {"ok": True, "columns": [self.result.columns[i] for i in self.shown()], "rows": rows[:window], "row_count": None if more else len(rows), "truncated": more, "elapsed_ms": int(1000 * (time.monotonic() - began))}
        except Exception as e:  # noqa: BLE001  any failure of the user's statement is its answer
            self.drop()
            return {"ok": False, "error": str(e).split("\n\nJVM stacktrace")[0], "elapsed_ms": int(1000 * (time.monotonic() - began))}
        finally:
            self.running = False
            context.removeJobTag(self.tag)

    def page(self, offset: int, limit: int) -> list[list]:
        if self.result is None:
            return []
        if offset and not self.result.is_cached:
            self.result.persist()
        some = self.result.offset(offset) if offset else self.result
        shown = self.shown()
        return [[json_safe(r[i]) for i in shown] for r in some.limit(limit).collect()]

    def shown(self) -> list[int]:
        """Places of the columns to show: row numbers that came along with others are hidden, one from each table of a join."""
        own = [] if self.result is None else self.result.columns
        rest = [i for i, c in enumerate(own) if not re.fullmatch(rf"{ROW}(_\d+)?", c)]
        return rest or list(range(len(own)))

    def count(self) -> int:
        """The rows of the whole result."""
        return 0 if self.result is None else self.result.persist().count()

    def progress(self) -> dict:
        """From another thread: tasks of the running statement that are done, running and in all, and the share that is done."""
        tracker, tasks = self.spark.sparkContext.statusTracker(), [0, 0, 0]
        for stage in tracker.getActiveStageIds():
            info = tracker.getStageInfo(stage)
            if info is not None:
                tasks = [a + b for a, b in zip(tasks, (info.numCompletedTasks, info.numActiveTasks, info.numTasks), strict=True)]
        return {"done": tasks[0], "running": tasks[1], "tasks": tasks[2], "percent": round(100.0 * tasks[0] / tasks[2], 1) if tasks[2] else None}

    def cancel(self) -> int:
        """From another thread: 1 if a statement was running, whose jobs are now cancelled."""
        was = int(self.running)
        self.spark.sparkContext.cancelJobsWithTag(self.tag)
        return was

    def drop(self) -> None:
        if self.result is not None:
            self.result.unpersist()
            self.result = None
