"""Named tables of a session: loading, listing, paging, renaming, and saving query results."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, export, profile
from ..operators.naming import unique_name
from ..operators.profile import ROW
from ..session import semantics
from ..sources import delimited, excel, parquet
from ..sources.options import Load, Options, cleaned
from . import dml
from .sqlrun import Runner, json_safe, without_nulls_type
from .versions import Versioned


class Workspace:
    """Tables are temp views, so SQL sees them under their names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.runner = spark, {}, Runner(spark)
        self.rejects: dict[str, DataFrame] = {}
        self.versions: dict[str, Versioned] = {}

    def register(self, name: str, df: DataFrame, persist: bool = False) -> str:
        df = without_nulls_type(df)
        df = df.persist() if persist else df
        df.createOrReplaceTempView(f"`{name}`")
        self.tables[name] = df
        return name

    def _take(self, load: Load) -> str:
        self.register(load.name, load.df)
        if load.rejects is not None:
            self.rejects[load.name] = load.rejects
            self.register(f"{load.name}__rejects", load.rejects)
        return load.name

    def load_file(self, path: str, options: Options | dict | None = None) -> Load:
        """By suffix; a file named like a workbook that is none is read as text."""
        o, suffix, taken = cleaned(options), Path(path).suffix.lower(), list(self.tables)
        if suffix == ".parquet":
            got = parquet.load(self.spark, path, o, taken)
        elif suffix in (".xlsx", ".xlsm", ".xls") and excel.is_workbook(path):
            got = excel.load_sheet(self.spark, path, None, o, taken)
        else:
            got = delimited.load(self.spark, path, o, taken)
        got.name = unique_name(got.name, self.tables, 2)
        self._take(got)
        return got

    def load_workbook(self, path: str, specs: list[dict]) -> list[str]:
        return [self._take(x) for x in excel.load_workbook(self.spark, path, specs)]

    def list_tables(self) -> list[dict]:
        return [{"name": n, "rows": df.count(), "columns": len(df.columns)} for n, df in sorted(self.tables.items()) if not n.startswith("__")]

    def schema(self, name: str) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.tables[name].schema.fields]

    def rows(self, name: str, offset: int = 0, limit: int = 500, sort: str | None = None, descending: bool = False) -> list[list]:
        """A window of the table: by row number where there is one and no sort; sorted numbers come as numbers, nulls last."""
        df = self.tables[name]
        if sort:
            number = F.col(f"`{sort}`").try_cast("double")
            keys = [number.desc_nulls_last(), F.col(f"`{sort}`").desc_nulls_last()] if descending else [number.asc_nulls_last(), F.col(f"`{sort}`").asc_nulls_last()]
            df = df.orderBy(*keys).offset(offset).limit(limit)
        elif ROW in df.columns:
            df = df.filter((F.col(ROW) > offset) & (F.col(ROW) <= offset + limit)).orderBy(ROW)
        else:
            df = df.offset(offset).limit(limit)
        return [[json_safe(v) for v in r] for r in df.collect()]

    def pivot_row(self, name: str, row: int) -> list[tuple[int, str, object]]:
        """A source row as (place, column, value)."""
        df = self.tables[name]
        got = df.filter(F.col(ROW) == row).limit(1).collect() if ROW in df.columns else df.offset(row - 1).limit(1).collect()
        return [(i, c, json_safe(v)) for r in got for i, (c, v) in enumerate(zip(df.columns, r, strict=True), 1)]

    def rename(self, old: str, new: str) -> bool:
        if old not in self.tables or new in self.tables:
            return False
        if old in self.versions:
            self.versions[new] = self.versions.pop(old)
        self.register(new, self.tables.pop(old))
        self.spark.catalog.dropTempView(old)
        return True

    def drop(self, name: str) -> bool:
        if name not in self.tables:
            return False
        self.tables.pop(name).unpersist()
        if name in self.versions:
            self.versions.pop(name).drop()
        if name in self.rejects:
            self.rejects.pop(name).unpersist()
        self.spark.catalog.dropTempView(name)
        return True

    def materialize(self, name: str) -> bool:
        if name not in self.tables:
            return False
        self.register(name, self.tables[name], persist=True)
        self.tables[name].count()
        return True

    def run_sql(self, sql: str) -> dict:
        """One query, or statements that change tables of the workspace; others go to the session."""
        return self.runner.run(sql, change=self._change)

    def _change(self, sql: str) -> bool:
        """A change of a table registers its new version under the name. False if the statement is none of these."""
        change = dml.parse(sql)
        if change is None:
            return False
        if change.verb == "create":
            if change.name in self.tables and not change.replace:
                if change.lenient:
                    return True
                raise ValueError(f"{change.name} exists")
            made = self.runner.query(change.query)
            self.versions.pop(change.name, None)  # its files stay until the driver ends, as the new table may read them
            self.register(change.name, made, persist=change.table)
        elif change.verb == "drop":
            if not self.drop(change.name) and not change.lenient:
                raise ValueError(f"{change.name} is unknown")
        elif change.name not in self.tables:
            return False
        elif change.verb == "rename":
            if not self.rename(change.name, change.query):
                raise ValueError(f"{change.query} exists")
        else:
            with semantics(self.spark):
                held = self.versions.get(change.name)
                if held is None:  # the first change writes the table
                    held = self.versions[change.name] = Versioned.of(self.tables[change.name])
                self.register(change.name, dml.changed(held, change, self.runner.query))
        return True

    def version(self, name: str, number: int = -1) -> DataFrame:
        """A changed table as of a version, from 0, before its first change, to the last."""
        return self.versions[name].at(number) if name in self.versions else self.tables[name]

    def cancel_sql(self) -> int:
        return self.runner.cancel()

    def save_query(self, sql: str, name: str) -> int:
        self.register(name, self.runner.query(sql), persist=True)
        return self.tables[name].count()

    def profile_column(self, name: str, column: str) -> dict:
        return profile.profile(self.tables[name], column)

    def profile_query(self, sql: str, column: str) -> dict:
        return profile.profile(self.runner.query(sql), column)

    def suggest_casts(self, name: str) -> list:
        return derive.suggest_casts(self.tables[name])

    def derive(self, name: str, new: str, specs: list[derive.CastSpec], where: str | None = None) -> int:
        self.register(new, derive.apply(self.tables[name], specs, where), persist=True)
        return self.tables[new].count()

    def auto_derive(self, name: str, new: str) -> int:
        return self.derive(name, new, derive.auto_specs(self.tables[name]))

    def export(self, name: str, path: str, kind: str, **options) -> int:
        return export.export(self.tables[name], path, kind, **options)

    def export_query(self, sql: str, path: str, kind: str, **options) -> int:
        return export.export(self.runner.query(sql), path, kind, **options)
