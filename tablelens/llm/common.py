"""Column helpers and checkpointing shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import drop, materialize, work_dir  # noqa: F401  where the operators' intermediate results are

#: Everything in ASCII but digits and lower-case letters parts words.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space parts tokens.
SPACE_GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed, as far as comparing texts and parting them at ASCII characters goes.

    Each byte of the UTF-8 text counts as a Latin-1 character, so that the built-in lower() takes bytes of ASCII as letters. It also
    changes first bytes of longer characters, but no two of these become alike: how many bytes follow tells them apart.
    """
    return F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))


def words(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.array_remove(F.split(folded(text), WORD_GAP, -1), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def n_tokens(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has."""
    edge = (F.ltrim(F.translate(F.substring(text, 1, 1), "\t\n\x0b\x0c\r", "     ")) == "").cast("long")
    last = (F.ltrim(F.translate(F.substring(text, -1, 1), "\t\n\x0b\x0c\r", "     ")) == "").cast("long")
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.size(F.split(text, SPACE_GAP, -1)).cast("long") - edge - last)


def row_key(text: Column) -> Column:
    """With the id, tells rows apart even where ids repeat."""
    return F.xxhash64(text, F.octet_length(text))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of df's, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
