"""Tables that statements change: each change is a version, a list of Parquet files of which only those with touched rows are written anew.

A version is read from its own files, so that a thousand changes are no longer to plan than one, earlier versions stay readable, and a lost
executor costs its tasks only. Files are in the folder that the cluster shares, and go with the table. The driver holds a name for each file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

#: An insert into a table of more files than this writes the table anew.
MANY_FILES = 64


@dataclass
class Versioned:
    """The versions of one table. Columns are stored by their places, as names may hold anything."""

    spark: SparkSession
    schema: T.StructType
    path: str
    versions: list[tuple[str, ...]] = field(default_factory=list)
    #: What each version had to write: files kept, files written.
    costs: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame) -> Versioned:
        made = cls(df.sparkSession, df.schema, scratch.work_dir(df.sparkSession))
        made._add((), df)
        return made

    def _stored(self) -> T.StructType:
        return T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(self.schema.fields)])

    def _read(self, files: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(self._stored()).parquet(*files) if files else self.spark.createDataFrame([], self._stored())

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(self.schema.fields)])

    def _write(self, df: DataFrame) -> tuple[str, ...]:
        folder = f"{self.path}/{len(self.versions)}"
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.mode("overwrite").parquet(folder)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return tuple(sorted(s.getPath().toString() for s in found if s.getPath().getName().endswith(".parquet")))

    def _add(self, kept: tuple[str, ...], new: DataFrame | None) -> DataFrame:
        written = () if new is None else self._write(new)
        self.versions.append((*kept, *written))
        self.costs.append((len(kept), len(written)))
        return self.at()

    def at(self, version: int = -1) -> DataFrame:
        """The table as of a version, the last by default."""
        return self._named(self._read(self.versions[version]))

    def insert(self, rows: DataFrame) -> DataFrame:
        files = self.versions[-1]
        if len(files) > MANY_FILES:  # many small inserts: once in a while all goes together
            return self._add((), self.at().unionByName(rows))
        return self._add(files, rows)

    def change(self, hit: Column, rewrite: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of files in which some are hit go through rewrite; the other files stay. hit and rewrite are of the table's own columns."""
        if not self.versions[-1]:
            return self._add((), None)
        file = "_file"
        while file in {f.name.lower() for f in self.schema.fields}:
            file = f"_{file}"
        rows = self._read(self.versions[-1]).select(F.col("_metadata.file_path").alias(file), *[F.col(f"c{i}").alias(f.name) for i, f in enumerate(self.schema.fields)])
        touched = {r[0] for r in rows.filter(hit).select(file).distinct().collect()}  # names of files at most
        uri = lambda f: self.spark._jvm.org.apache.hadoop.fs.Path(f).toUri().toString()
        old = tuple(f for f in self.versions[-1] if uri(f) in touched)
        if not old:
            return self._add(self.versions[-1], None)
        return self._add(tuple(f for f in self.versions[-1] if f not in old), rewrite(self._named(self._read(old))))

    def drop(self) -> None:
        scratch.drop(self.spark, self.path)
        self.versions.clear()
