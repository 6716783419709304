"""Text to typed values by explicit grammars, all as Column expressions that give null for what they cannot read.

Spark's own casts accept other texts (trailing letters, bare years, times of today), so each grammar is spelt out. All
are safe in ANSI mode.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textops import strip

PLAIN_INT = r"^-?(0|[1-9]\d*)(\.0+)?\z"
PLAIN_DECIMAL = r"^-?(0|[1-9]\d*)(\.\d+)?\z"
SCIENTIFIC = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?\z"
_NUMBER = r"^[ \t\n\x0b\f\r]*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?[ \t\n\x0b\f\r]*\z"
_STAMP = r"^[ \t\n\x0b\f\r]*(\d{1,6})([-/ ])(\d{1,2})\2(\d{1,2})(?:(?:T| +)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d*))?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?|[ \t\n\x0b\f\r].*)?)?\z"
_DAY = r"^[ \t\n\x0b\f\r]*(\d{1,6})([-/ ])(\d{1,2})\2(\d{1,2})[ \t\n\x0b\f\r]*\z"

# The date formats in the order in which they are tried.
DATE_FORMATS = (
    ("%Y-%m-%d %H:%M:%S.%f", "TIMESTAMP"),
    ("%Y-%m-%d %H:%M:%S", "TIMESTAMP"),
    ("%Y-%m-%dT%H:%M:%S.%f", "TIMESTAMP"),
    ("%Y-%m-%dT%H:%M:%S", "TIMESTAMP"),
    ("%Y%m%dT%H%M%S", "TIMESTAMP"),
    ("%Y%m%d%H%M%S", "TIMESTAMP"),
    ("%m/%d/%Y %I:%M:%S %p", "TIMESTAMP"),
    ("%m/%d/%Y %H:%M:%S.%f", "TIMESTAMP"),
    ("%m/%d/%Y %H:%M:%S", "TIMESTAMP"),
    ("%m/%d/%y %H:%M:%S", "TIMESTAMP"),
    ("%m/%d/%Y %I:%M %p", "TIMESTAMP"),
    ("%Y-%m-%d", "DATE"),
    ("%Y%m%d", "DATE"),
    ("%m/%d/%y", "DATE"),
    ("%m/%d/%Y", "DATE"),
    ("%m-%d-%y", "DATE"),
    ("%m-%d-%Y", "DATE"),
    ("%d/%m/%Y", "DATE"),
    ("%b %d, %Y", "DATE"),
    ("%B %d, %Y", "DATE"),
    ("%a, %b %d, %Y", "DATE"),
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def _read(c: Column, pattern: str, groups: list[int], body: Callable[[Callable[[int], Column]], Column]) -> Column:
    """What body makes of the groups of a text that matches, else null. The text is taken apart once, however often body names a group."""
    parts = F.split(F.regexp_replace(c, pattern + r"[\s\S]*", ",".join(f"${g}" for g in groups)), ",", -1)
    made = F.get(F.transform(F.array(parts), lambda p: body(lambda g: F.get(p, F.lit(groups.index(g))))), F.lit(0))
    return F.when(c.rlike(pattern), made)


def to_bigint(c: Column) -> Column:
    """Whole numbers; fractions round half away from zero; underscores between digits and 0x are read."""
    plain = F.replace(F.trim(F.translate(c, "\t\n\x0b\f\r", "     ")), F.lit("_"), F.lit(""))
    number = F.round(plain.try_cast("decimal(38,10)")).try_cast("bigint")
    return F.when(c.rlike(_NUMBER), F.coalesce(plain.try_cast("bigint"), number)).when(c.rlike(r"^0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(c, 3, 16), 16, 10).try_cast("bigint"))


def to_double(c: Column) -> Column:
    special = c.rlike(r"(?i)^\s*[+-]?(nan|inf|infinity)\s*\z")
    plain = F.replace(F.trim(F.translate(c, "\t\n\x0b\f\r", "     ")), F.lit("_"), F.lit(""))
    return F.when(c.rlike(_NUMBER) | special, plain.try_cast("double"))


def to_decimal(c: Column, precision: int, scale: int) -> Column:
    plain = F.replace(F.trim(F.translate(c, "\t\n\x0b\f\r", "     ")), F.lit("_"), F.lit(""))
    return F.when(c.rlike(_NUMBER), plain.try_cast(f"decimal({precision},{scale})"))


def to_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("true", "t", "1", "yes", "y"), F.lit(True)).when(low.isin("false", "f", "0", "no", "n"), F.lit(False))


def to_timestamp(c: Column) -> Column:
    """The written wall time; a zone is dropped, and what follows the time after a blank is ignored."""

    def made(group: Callable[[int], Column]) -> Column:
        y, mo, d, h, mi, s = (group(g).try_cast("int") for g in (1, 3, 4, 5, 6, 7))
        micros = F.rpad(F.substring(group(8), 1, 6), 6, "0").try_cast("int")
        second = (F.coalesce(s, F.lit(0)) + F.coalesce(micros, F.lit(0)) / F.lit(1000000.0)).cast("decimal(16,6)")
        hour = F.coalesce(h, F.lit(0))
        midnight = (hour == 24) & (F.coalesce(mi, F.lit(0)) == 0) & (second == 0)
        at = F.call_function("try_make_timestamp_ntz", y, mo, d, F.when(midnight, 0).otherwise(hour), F.coalesce(mi, F.lit(0)), second)
        at = F.when(((hour < 24) | midnight) & (F.coalesce(mi, F.lit(0)) < 60) & (F.coalesce(s, F.lit(0)) < 60), at)
        return F.when(midnight, at + F.expr("interval 1 day")).otherwise(at)

    return _read(c, _STAMP, [1, 3, 4, 5, 6, 7, 8], made)


def to_date(c: Column) -> Column:
    zero = F.lit(0)

    def made(group: Callable[[int], Column]) -> Column:
        y, mo, d = (group(g).try_cast("int") for g in (1, 3, 4))
        return F.call_function("try_make_timestamp_ntz", y, mo, d, zero, zero, F.lit(0).cast("decimal(16,6)")).cast("date")

    return _read(c, _DAY, [1, 3, 4], made)


def is_iso_date(c: Column) -> Column:
    """Exactly the text that the date itself prints as."""
    return c.rlike(r"^\d{4,6}-\d{2}-\d{2}\z") & to_date(c).isNotNull()


def _compile(fmt: str) -> tuple[str, dict[str, int]]:
    """A regex with possessive digit groups, and the group of each token."""
    out, groups, n, i = r"^[ \t\n\x0b\f\r]*+", {}, 0, 0
    short = "|".join(m[:3] for m in MONTHS)
    tokens = {"Y": r"(\d{1,4}+)", "f": r"(\d{1,6}+)", "p": r"(?i:(AM|PM))", "b": rf"(?i:({short}))", "B": rf"(?i:({'|'.join(MONTHS)}))", "a": rf"(?i:({'|'.join(DAYS)}))"}
    while i < len(fmt):
        if fmt[i] == "%":
            n += 1
            groups[fmt[i + 1]] = n
            out += tokens.get(fmt[i + 1], r"(\d{1,2}+)")
            i += 2
        else:
            out += r"[ \t\n\x0b\f\r]++" if fmt[i] == " " else re.escape(fmt[i])
            i += 1
    return out + r"[ \t\n\x0b\f\r]*+\z", groups


def parse_format(c: Column, fmt: str) -> Column:
    """The text as a timestamp in a strptime-like format, or null."""
    pattern, at = _compile(fmt)

    def made(group: Callable[[int], Column]) -> Column:
        num = lambda t: group(at[t]).try_cast("int")
        text = lambda t: F.lower(group(at[t]))
        year = num("Y") if "Y" in at else num("y") + F.when(num("y") < 69, 2000).otherwise(1900)
        if "m" in at:
            month = num("m")
        else:
            month = ((F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(text("b" if "b" in at else "B"), 1, 3)) + 2) / 3).cast("int")
        hour = F.lit(0)
        if "H" in at:
            hour = num("H")
        if "I" in at:
            hour = F.when(num("I").between(1, 12), num("I") % 12 + F.when(text("p") == "pm", 12).otherwise(0))
        minute, second = (num(t) if t in at else F.lit(0) for t in "MS")
        micros = F.rpad(group(at["f"]), 6, "0").try_cast("int") if "f" in at else F.lit(0)
        seconds = (second + micros / F.lit(1000000.0)).cast("decimal(16,6)")
        stamp = F.call_function("try_make_timestamp_ntz", year, month, num("d"), hour, minute, seconds)
        return F.when((hour < 24) & (minute < 60) & (second < 60), stamp)

    return _read(c, pattern, sorted(at.values()), made)


def cast_text(c: Column, type_: str) -> Column:
    """try_cast of text to BIGINT, DOUBLE, DECIMAL(p,s), BOOLEAN, DATE, TIMESTAMP or VARCHAR."""
    t = type_.strip().upper()
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC)\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", t):
        return to_decimal(c, int(m[1]), int(m[2]))
    kinds = {"BIGINT": to_bigint, "DOUBLE": to_double, "BOOLEAN": to_boolean, "DATE": to_date, "TIMESTAMP": to_timestamp}
    if t in ("INTEGER", "INT", "SMALLINT", "TINYINT"):
        return to_bigint(c).try_cast(t)
    if t in ("VARCHAR", "STRING", "TEXT"):
        return c
    if t not in kinds:
        raise ValueError(f"no cast of text to {type_}")
    return kinds[t](c)


def typed(c: Column, type_: str | None, fmt: str | None = None, via_timestamp: bool = False, strip_blanks: bool | None = None, strict: bool = False) -> Column:
    """The cast of a typed clone: by format if given, through a timestamp if asked, again without edge blanks where the plain text fails."""
    if not type_:
        return c

    def plain(x: Column) -> Column:
        if fmt:
            return parse_format(x, fmt).cast("date" if type_.upper() == "DATE" else "timestamp_ntz")
        return to_timestamp(x).cast("date") if via_timestamp else cast_text(x, type_)

    out = plain(c) if strip_blanks is False else F.coalesce(plain(c), plain(strip(c)))
    if strict:
        bad = c.isNotNull() & out.isNull() & (F.lit(True) if strip_blanks is False else strip(c).isNotNull())
        out = F.when(bad, F.raise_error(F.concat(F.lit(f"cannot read as {type_}: "), c)).cast(_spark_type(type_))).otherwise(out)
    return out


def _spark_type(type_: str) -> str:
    return {"TIMESTAMP": "timestamp_ntz", "VARCHAR": "string"}.get(type_.upper(), type_.lower())


def number_text(c: Column) -> Column:
    """A double as text with plain notation: 10000000000.0, 1e-07, 1e+16."""
    s = c.cast("string")
    mant, exp = F.regexp_extract(s, r"^(-?[\d.]+)E(-?\d+)\z", 1), F.regexp_extract(s, r"E(-?\d+)\z", 1).try_cast("int")
    digits = F.replace(F.replace(mant, F.lit("."), F.lit("")), F.lit("-"), F.lit(""))
    digits = F.when(mant.endswith(".0"), digits.substr(F.lit(1), F.length(digits) - 1)).otherwise(digits)
    sign = F.when(mant.startswith("-"), "-").otherwise("")
    up = F.concat(sign, F.rpad(digits, 400, "0").substr(F.lit(1), exp + 1), F.lit("."), F.when(F.length(digits) > exp + 1, digits.substr(exp + 2, F.length(digits))).otherwise("0"))
    down = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    sci = F.concat(sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), digits.substr(F.lit(2), F.length(digits)))).otherwise(""), F.when(exp < 0, "e-").otherwise("e+"), F.when(F.abs(exp) < 10, "0").otherwise(""), F.abs(exp).cast("string"))
    fixed = F.when(exp.between(0, 15), up).when(exp.between(-4, -1), down).otherwise(sci)
    return F.when(s.contains("E"), fixed).otherwise(s)
