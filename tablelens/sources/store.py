"""Text files wherever Spark can read: their heads and tails on the driver, and a census of their bytes on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sniff import UNDEFINED_1252, Census

#: A character of several bytes, as UTF-8 defines it, of bytes taken for Latin-1.
_TAIL = r"[\x80-\xBF]"
CHARACTER = rf"[\xC2-\xDF]{_TAIL}|\xE0[\xA0-\xBF]{_TAIL}|[\xE1-\xEC\xEE\xEF]{_TAIL}{_TAIL}|\xED[\x80-\x9F]{_TAIL}|\xF0[\x90-\xBF]{_TAIL}{_TAIL}|[\xF1-\xF3]{_TAIL}{_TAIL}{_TAIL}|\xF4[\x80-\x8F]{_TAIL}{_TAIL}"
#: Where there is none: the beginning of one, as far as it goes, or a byte that begins none.
WRONG = rf"\xE0[\xA0-\xBF]|[\xE1-\xEC\xEE\xEF]{_TAIL}|\xED[\x80-\x9F]|\xF0[\x90-\xBF]{_TAIL}?|[\xF1-\xF3]{_TAIL}{_TAIL}?|\xF4[\x80-\x8F]{_TAIL}?|[\x80-\xFF]"
UNDEFINED = "[" + "".join(rf"\x{b:02x}" for b in sorted(UNDEFINED_1252)) + "]"


def as_latin(value: Column) -> Column:
    """The bytes as characters of the same numbers."""
    return F.decode(value.cast("binary"), "ISO-8859-1")


def byte_lines(spark: SparkSession, paths: list[str], line_end: str = "\n") -> DataFrame:
    """Lines as their bytes; what is no UTF-8 stays as it is."""
    return spark.read.option("lineSep", line_end).text(paths)


def census(spark: SparkSession, paths: list[str]) -> Census:
    """Of all bytes of the files, by one aggregate over their splits. No character and no wrong sequence goes over a line's end."""
    beyond = byte_lines(spark, paths).select(as_latin(F.col("value")).alias("v")).filter(F.col("v").rlike(r"[\x80-\xFF]"))
    broken = F.regexp_replace("v", CHARACTER, " ")
    row = beyond.agg(
        F.sum(F.regexp_count("v", F.lit(CHARACTER))).alias("good"),
        F.sum(F.regexp_count(broken, F.lit(WRONG))).alias("bad"),
        F.max(F.col("v").rlike(UNDEFINED)).alias("undefined"),
        F.max(F.col("v").rlike(r"[\x80-\x9F]")).alias("controls"),
    ).first()
    return Census(row["good"] or 0, row["bad"] or 0, bool(row["undefined"]), bool(row["controls"]))


class Stored:
    """The files that a path, a folder or a pattern names, in the order of their names, as one text. Empty and hidden ones do not count."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        conf, where = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = where.getFileSystem(conf)
        found = [s for top in self._fs.globStatus(where) or () for s in (self._fs.listStatus(top.getPath()) if top.isDirectory() else (top,))]
        shown = lambda s: s.isFile() and s.getLen() and (len(found) == 1 or s.getPath().getName()[0] not in "._")
        self.exists = bool(found)
        self._files = sorted(((s.getPath().toUri().toString(), s.getPath(), s.getLen()) for s in found if shown(s)), key=lambda x: x[0])
        self.paths = [p.toString() for _, p, _ in self._files]

    def _read(self, at: int, start: int, n: int) -> bytes:
        _, path, size = self._files[at]
        stream = self._fs.open(path)
        try:
            stream.seek(start)
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size - start)))
        finally:
            stream.close()

    def head(self, n: int) -> tuple[bytes, bool]:
        """The first bytes of the first file, and whether these are all."""
        return (self._read(0, 0, n), self._files[0][2] <= n) if self._files else (b"", True)

    def tail(self, n: int, even: bool = False) -> tuple[bytes, bool]:
        """The last bytes of the last file, and whether these are all. even: from a byte of an even place."""
        if not self._files:
            return b"", True
        start = max(0, self._files[-1][2] - n)
        start -= start % 2 if even else 0
        return self._read(len(self._files) - 1, start, n + 1), not start

    def census(self) -> Census:
        return census(self.spark, self.paths)
