"""Operators that follow an order within keys, where one key may hold any share of the rows.

The rows of a key that has more than ``LIMIT`` are cut into bins by ranges of the order; equal values share a bin. Bins are worked on apart,
and what a bin hands on to those after it, a last row, a count, a sum, is one row per bin. Keys with fewer rows stay whole. A join of points
and intervals deals both to bins of the intervals' own lengths. Columns made here begin with an underscore and are held apart from the frames' own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.rownum import in_file_order

#: Rows of a key that are sorted in one task, bins of a key at most, and numbers of fixed width that are broadcast at most.
LIMIT, MOST, FEW = 2_000_000, 4096, 1_000_000
#: Bounds that a row has beside it at a time while its bin is looked up.
BLOCK = 64


def _alike(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _measure(df: DataFrame, order: str) -> Column:
    """What ranges are cut by: the order itself if quantiles can be told of it, else something that never falls as the order rises."""
    c, kind = F.col(order), df.schema[order].dataType
    if isinstance(kind, T.StringType):
        return F.conv(F.hex(F.rpad(F.substring(F.encode(c, "UTF-8"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")
    return c if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else c.cast("double")


def _below(bounds: Column, value: Column, most: int) -> Column:
    """How many of at most so many ascending bounds are below the value, by binary search; none are below null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def cut(df: DataFrame, keys: list[str], order: str, limit: int | None = None) -> tuple[DataFrame, bool]:
    """df with _bin, and whether any key is cut: -1 where it is not, else the number of the range, from 0; nulls come first.

    Counts keys when it is called; bounds, a row of at most ``MOST`` values for each key that is cut, are broadcast up to ``FEW`` values.
    """
    limit = limit or LIMIT
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > limit)
    many, top = counts.agg(F.count(F.lit(1)), F.max("_k")).first()
    if not many:
        return df.withColumn("_bin", F.lit(-1)), False
    parts = min(MOST, math.ceil(top / limit))
    apart = [f"_c{i}" for i in range(len(keys))]
    sent = (lambda x: F.broadcast(x)) if many * parts <= FEW else (lambda x: x)
    large = sent(counts.select(*[F.col(k).alias(a) for k, a in zip(keys, apart, strict=True)]))
    bounds = df.join(large, _alike(keys, apart), "left_semi").groupBy(*keys).agg(F.percentile_approx(_measure(df, order), [i / parts for i in range(1, parts)], 16 * parts).alias("_bounds"))
    bounds = bounds.select(*[F.col(k).alias(a) for k, a in zip(keys, apart, strict=True)], F.coalesce("_bounds", F.array()).alias("_bounds"))
    # every BLOCK-th bound first, and then those between two of them: a row never has all its key's bounds beside it
    ends = F.transform(F.sequence(F.lit(1), F.lit(MOST // BLOCK)), lambda i: F.get("_bounds", i * BLOCK - 1))
    blocks = bounds.select(*[F.col(a).alias(f"_{a}") for a in apart], F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(MOST // BLOCK)), lambda i: F.slice("_bounds", i * BLOCK + 1, BLOCK))).alias("_block", "_few"))
    measured = df.withColumn("_measure", _measure(df, order)).join(sent(bounds.select(*apart, ends.alias("_ends"))), _alike(keys, apart), "left")
    measured = measured.withColumn("_block_of", _below(F.col("_ends"), F.col("_measure"), MOST // BLOCK))
    measured = measured.join(sent(blocks.filter(F.size("_few") > 0)), _alike(keys, [f"_{a}" for a in apart]) & (F.col("_block_of") == F.col("_block")), "left")
    place = F.col("_block_of") * BLOCK + F.coalesce(_below(F.col("_few"), F.col("_measure"), BLOCK), F.lit(0))
    return measured.withColumn("_bin", F.when(F.col("_ends").isNull(), -1).otherwise(place)).drop("_measure", "_ends", "_block_of", "_block", "_few", *apart, *[f"_{a}" for a in apart]), True


def asof(left: DataFrame, right: DataFrame, keys: Sequence[tuple[Column, Column]], at: tuple[Column, Column], how: str = ">=", limit: int | None = None) -> DataFrame:
    """(_left, _right) as structs: each row of left with the row of right that is nearest in time among those of its keys for which left's time
    ``how`` right's time holds; _right is null without one. Null keys and times meet nothing; of several at one time any is taken."""
    later, strict = how[0] == "<", len(how) == 1
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    own = [[x[s].alias(n) for x, n in zip(keys, names, strict=False)] or [F.lit(0).alias("_k0")] for s in (0, 1)]
    # rows that a time may take come before it in the order
    rows = left.select(*own[0], at[0].alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_left"))
    held = right.select(*own[1], at[1].alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("_right")).dropna(subset=[*names, "_at"])
    both, parted = cut(rows.unionByName(held, allowMissingColumns=True), names, "_at", limit)
    way = F.col("_at").desc_nulls_last() if later else F.col("_at").asc_nulls_first()
    upto = W.partitionBy(*names, "_bin").orderBy(way, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("_right", F.last("_right", ignorenulls=True).over(upto)).filter(F.col("_left").isNotNull())
    if parted:
        end = (F.min_by if later else F.max_by)("_right", F.when(F.col("_right").isNotNull(), F.col("_at")))
        before = W.partitionBy(*names).orderBy(F.desc("_bin") if later else F.asc("_bin")).rowsBetween(W.unboundedPreceding, -1)
        hands = both.filter("_bin >= 0").groupBy(*names, "_bin").agg(end.alias("_end")).withColumn("_end", F.last("_end", ignorenulls=True).over(before))
        apart = [f"_h{i}" for i in range(len(names) + 1)]
        found = found.join(hands.toDF(*apart, "_end"), _alike([*names, "_bin"], apart), "left").withColumn("_right", F.coalesce("_right", "_end"))
    return found.select("_left", F.when(F.col("_at").isNotNull(), F.col("_right")).alias("_right"))


@dataclass(frozen=True)
class Running:
    """A running value: row_number, rank, dense_rank, count, sum, min, max, or lag of the row before. Rows of equal order share it but for row_number and lag."""

    kind: str
    of: Column | None = None


def running(df: DataFrame, keys: Sequence[Column], order: Column, wanted: dict[str, Running], limit: int | None = None) -> DataFrame:
    """df with running values over each key in ascending order, nulls first, as window functions without a frame give them."""
    names = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    own = [k.alias(n) for k, n in zip(keys, names, strict=False)] or [F.lit(0).alias("_k0")]
    values = [(w.of if w.of is not None else F.lit(1)).alias(f"_v{i}") for i, w in enumerate(wanted.values())]
    rows, parted = cut(df.select(*own, order.alias("_at"), *values, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")), names, "_at", limit)
    by = W.partitionBy(*names, "_bin").orderBy("_at")
    inner = {"row_number": lambda v: F.row_number(), "rank": lambda v: F.rank(), "dense_rank": lambda v: F.dense_rank(), "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "lag": F.lag}
    at_end = {"row_number": lambda v: F.count(F.lit(1)), "rank": lambda v: F.count(F.lit(1)), "dense_rank": lambda v: F.count_distinct("_at") + F.max(F.col("_at").isNull().cast("int")), "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "lag": lambda v: F.max_by(F.struct(v), "_at")}
    out = rows.withColumns({f"_w{i}": inner[w.kind](F.col(f"_v{i}")).over(by) for i, w in enumerate(wanted.values())})
    if parted:
        ends = rows.filter("_bin >= 0").groupBy(*names, "_bin").agg(*[at_end[w.kind](F.col(f"_v{i}")).alias(f"_e{i}") for i, w in enumerate(wanted.values())])
        before = W.partitionBy(*names).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
        carry = {"min": F.min, "max": F.max, "lag": lambda e: F.last(e, ignorenulls=True)}
        ends = ends.withColumns({f"_e{i}": carry.get(w.kind, F.sum)(F.col(f"_e{i}")).over(before) for i, w in enumerate(wanted.values())})
        apart = [f"_h{i}" for i in range(len(names) + 1)]
        out = out.withColumn("_first", F.row_number().over(by) == 1).join(ends.toDF(*apart, *[f"_e{i}" for i in range(len(wanted))]), _alike([*names, "_bin"], apart), "left")
        for i, w in enumerate(wanted.values()):
            here, brought = F.col(f"_w{i}"), F.col(f"_e{i}")
            both = {"min": F.least(here, brought), "max": F.greatest(here, brought)} if w.kind in ("min", "max") else {}
            if w.kind == "lag":
                both["lag"] = F.when(F.col("_first"), brought.getField(f"_v{i}")).otherwise(here)
            out = out.withColumn(f"_w{i}", both.get(w.kind, F.when(here.isNull(), brought).otherwise(here + F.coalesce(brought, F.lit(0)))))
    return out.select("_row.*", *[F.col(f"_w{i}").alias(n) for i, n in enumerate(wanted)])


def quantiles(df: DataFrame, keys: Sequence[Column], value: Column, shares: Sequence[float], limit: int | None = None) -> DataFrame:
    """(_k0, ..., _q0, ...): exact quantiles of each group, between neighbours where a rank falls between two values; nulls do not count.

    Values are counted first. Of a group with more than ``limit`` distinct ones only the bins that hold a wanted rank are sorted.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    counts = df.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], value.cast("double").alias("_x")).groupBy(*names, "_x").agg(F.count("_x").alias("_n"))
    binned, _ = cut(counts, names, "_x", limit)
    sizes = binned.groupBy(*names, "_bin").agg(F.sum("_n").alias("_in"))
    key = W.partitionBy(*names)
    sizes = sizes.withColumns({"_all": F.sum("_in").over(key), "_off": F.coalesce(F.sum("_in").over(key.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    low = [F.floor((F.col("_all") - 1) * F.lit(float(p))).cast("long") for p in shares]
    high = [F.least(x + 1, F.col("_all") - 1) for x in low]
    within = F.lit(False)
    for r in (*low, *high):
        within = within | ((r >= F.col("_off")) & (r < F.col("_off") + F.col("_in")))
    apart = [f"_h{i}" for i in range(len(names) + 1)]
    needed = sizes.filter((F.col("_all") > 0) & within).select(*[F.col(c).alias(a) for c, a in zip([*names, "_bin"], apart, strict=True)], "_all", "_off")
    few = binned.filter("_n > 0").join(needed, _alike([*names, "_bin"], apart))
    few = few.withColumn("_to", F.col("_off") + F.sum("_n").over(W.partitionBy(*names, "_bin").orderBy("_x")))
    at = lambda r: F.max(F.when((r >= F.col("_to") - F.col("_n")) & (r < F.col("_to")), F.col("_x")))
    picked = few.groupBy(*names).agg(F.max("_all").alias("_all"), *[at(r).alias(f"_{s}{i}") for s, rs in (("a", low), ("b", high)) for i, r in enumerate(rs)])
    part = [(F.col("_all") - 1) * F.lit(float(p)) for p in shares]
    mixed = [F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (x - F.floor(x))) for i, x in enumerate(part)]
    groups = counts.select(*names).distinct()
    found = picked.select(*[F.col(n).alias(a) for n, a in zip(names, apart, strict=False)], *[m.alias(f"_q{i}") for i, m in enumerate(mixed)])
    return groups.join(found, _alike(names, apart[: len(names)]), "left").select(*names, *[f"_q{i}" for i in range(len(shares))])


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with numbers from 1 as its rows come: counts of each partition and a prefix sum over them. What was shuffled is kept, so that it is counted as it is numbered."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return in_file_order(df, F.lit(0), F.lit(0), name)


def positional(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_left, _right) as structs: rows of the same place; the longer side's rest has nulls beside it. No side is numbered in one task."""
    sides = []
    for n, df in (("_left", left), ("_right", right)):
        held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(n))
        sides.append(numbered(held, "_number"))
    return sides[0].join(sides[1], "_number", "full").select("_left", "_right")


def _scale(df: DataFrame, name: str) -> Column:
    """A number that never falls as the value rises."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampType | T.TimestampNTZType):
        return F.unix_date(c.cast("date")) * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("second"), c).cast("double")
    return F.unix_date(c).cast("double") if isinstance(df.schema[name].dataType, T.DateType) else c.cast("double")


#: Lengths of intervals are told apart by every STEP-th power of two within these; longer or endless ones are a level of one bin.
FINEST, COARSEST, STEP = -20, 62, 2


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[tuple[Column, Column]], at: Column, low: Column, high: Column, closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """(_left, _right) as structs: each point with each interval of its keys that it lies in.

    An interval is dealt to the bins, two or three, that it touches on the level of its own length, and a point to its bin on each level
    that occurs; of these only one is on the interval's level, so that no pair is found twice. Nulls meet nothing.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    p = points.select(*[x.alias(n) for (x, _), n in zip(keys, names, strict=True)], at.alias("_at"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_left")).dropna(subset=[*names, "_at"])
    i = intervals.select(*[y.alias(n) for (_, y), n in zip(keys, names, strict=True)], low.alias("_low"), high.alias("_high"), F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("_right")).dropna(subset=[*names, "_low", "_high"])
    i = i.filter(F.col("_low") <= F.col("_high"))
    length = _scale(i, "_high") - _scale(i, "_low")
    level = F.when(F.isnan(length) | (length > 2.0**COARSEST), COARSEST + 1).otherwise(F.greatest(F.lit(FINEST), F.ceil(F.log2(F.greatest(length, F.lit(2.0**FINEST))) / STEP) * STEP).cast("int"))
    i = i.withColumn("_level", level.cast("int"))
    place = lambda df, c, size: F.when(F.col("_level") > COARSEST, F.lit(0)).otherwise(F.floor(_scale(df, c) / size)).cast("long")
    size = F.pow(F.lit(2.0), F.col("_level"))
    levels = [r["_level"] for r in i.select("_level").distinct().collect()]  # at most as many as there are powers
    i = i.withColumn("_bin", F.explode(F.sequence(place(i, "_low", size), place(i, "_high", size))))
    p = p.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    p = p.withColumn("_bin", place(p, "_at", size))
    # rows that are dealt out many times look no larger to the planner than they were, so it must not broadcast them
    met = p.join(i.hint("merge"), [*names, "_level", "_bin"])
    after = F.col("_at") >= F.col("_low") if closed[0] else F.col("_at") > F.col("_low")
    before = F.col("_at") <= F.col("_high") if closed[1] else F.col("_at") < F.col("_high")
    return met.filter(after & before).select("_left", "_right")
