"""Parquet files with their row numbers."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.naming import table_name
from ..operators.profile import ROW
from .options import Load, LoadError, Options, cleaned


#: Signs that file metadata leaves as they are.
SAFE = "/:@!$&'()*+,;=-._~"


def siblings(path: str) -> dict:
    """The Parquet files of a file's folder, sorted, and their bytes."""
    found = sorted(p for p in Path(path).parent.iterdir() if p.is_file() and p.suffix.lower() == ".parquet")
    return {"paths": [str(p) for p in found], "bytes": sum(p.stat().st_size for p in found)}


def read_numbered(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' rows, columns united by name, numbered in the order of the list. Offsets are a row per file."""
    df = spark.read.option("mergeSchema", True).parquet(*paths)
    if len(paths) == 1:
        return df.select((F.col("_metadata.row_index") + 1).alias(ROW), *[F.col(f"`{c}`") for c in df.columns])
    # a row for each file, by the path as Spark names it, so that the plan does not grow with the files
    named = spark.createDataFrame([(_name_of(p), i) for i, p in enumerate(paths)], "_name string, _rank int")
    marked = df.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("_name"), F.col("_metadata.row_index").alias("_index")).join(F.broadcast(named), "_name")
    sizes = marked.groupBy("_rank").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_rank", F.coalesce(F.sum("_n").over(W.orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.join(F.broadcast(offsets), "_rank").select((F.col("_before") + F.col("_index") + 1).alias(ROW), *[F.col(f"`{c}`") for c in df.columns])


def _name_of(path: str) -> str:
    """A path as file metadata has it: escaped as in an address, with its scheme unless that is a file of this machine."""
    if "://" in path and not path.startswith("file:"):
        return path
    return quote(Path("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path).resolve().as_posix(), safe=SAFE)


def load(spark: SparkSession, path: str, options: Options | dict | None = None, taken: list[str] = ()) -> Load:
    o = cleaned(options)
    paths = list(o.parquet_paths or [path])
    if any("://" not in p and not Path(p).exists() for p in paths):
        raise LoadError(f"no file {path}")
    df = read_numbered(spark, paths)
    stem = Path(path).parent.name if len(paths) > 1 else Path(path).stem
    df = df.persist() if o.materialize else df
    return Load(o.name or table_name(stem, taken), df, None, "parquet", {"files": len(paths)})
