"""Placeholder texts such as NA, nulled where every other value is a number or a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import SCIENTIFIC

# Fixed value: the dates that a column may hold beside placeholders.
DATE_SHAPE = r"^(\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?|\d{1,2}/\d{1,2}/(\d{2}|\d{4})( \d{1,2}:\d{2}(:\d{2})?( ?[AP]M)?)?)\z"


TOKEN, SHAPED, OTHER = 1, 2, 4


def qualifying(df: DataFrame, tokens: tuple[str, ...]) -> list[str]:
    """Text columns that hold tokens and numbers or dates and nothing else: which classes of values occur is one mask a column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols or not tokens:
        return []
    masks = []
    for i, name in enumerate(cols):
        c = F.col(f"`{name}`")
        kind = F.when(c.isin(*tokens), TOKEN).when(c.rlike(SCIENTIFIC) | c.rlike(DATE_SHAPE), SHAPED).when(c.isNotNull(), OTHER)
        masks.append(F.bit_or(kind).alias(f"m{i}"))
    return [name for name, mask in zip(cols, df.agg(*masks).first(), strict=True) if mask == TOKEN | SHAPED]


def nullify(df: DataFrame, tokens: tuple[str, ...] = ("NA", "NaN")) -> DataFrame:
    found = qualifying(df, tokens)
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in found}) if found else df
