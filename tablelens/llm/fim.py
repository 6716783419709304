"""Fill-in-middle transformation: a text cut at two of its units and put in an order that has the middle last.

A unit is a run of letters A to Z in either case, or any other one character. The first pass over a text counts its units; the second
advances a lazy iterator over the same matches to the first cut and on to the other, and stops there. No list of units exists at
any time: beside the text and the output, memory is the same for a text of ten units and one of ten million.

The cuts and the form follow from a hash of the seed and the id: texts stay plain by a rate, and the others have their suffix first by another.

Edge cases: a null text counts as empty; an empty text, or one that has a sentinel in it, stays plain, so that ``restore`` gets
every text back; a null id is hashed as no digits; rows that repeat an id are cut at places of the same hash; with equal cuts the middle
is empty; an empty table stays empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textfeat import slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred of these so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def count_units(text: str) -> int:
    """The first pass."""
    return sum(1 for _ in UNIT.finditer(text))


def cut_places(text: str, low: int, high: int) -> tuple[int, int]:
    """The second pass: where the first ``low`` and the first ``high`` units end."""
    matches, first = UNIT.finditer(text), 0
    for found in islice(matches, low - 1, low) if low else ():
        first = found.end()
    last = first
    for found in islice(matches, high - low - 1, high - low) if high > low else ():
        last = found.end()
    return first, last


def draws(key: str, seed: int) -> list[int]:
    """Four numbers of 32 bits by the id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, key: str, seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)"""
    n = count_units(text)
    a, b, c, d = draws(key, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or c % 100 >= rate:
        return n, "plain", None, None, text
    low, high = cut_places(text, *sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if d % 100 < suffix_first:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: the id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in slices(batch, "_text"):
                rows = [transformed(t.as_py(), k.as_py() or "", seed, rate, suffix_first) for t, k in zip(texts, piece["_key"], strict=True)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([piece["_id"], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_key"), text_of(text_col).alias("_text"))
    return own.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restore(output: str | Column, form: str | Column) -> Column:
    """The text that was transformed. Texts with a sentinel stay plain, so that the first of each is where the parts join."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    rest = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    head = F.substring_index(rest, SUFFIX, 1)
    head = F.when(form == "psm", head).otherwise(F.substring_index(rest, PREFIX, 1))
    tail = F.substr(rest, F.char_length(head) + F.char_length(second) + F.lit(1))
    other = F.substring_index(tail, MIDDLE, 1)
    middle = F.substr(tail, F.char_length(other) + F.lit(len(MIDDLE) + 1))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, other)).otherwise(F.concat(other, middle, head))
