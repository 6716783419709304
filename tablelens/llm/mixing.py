"""Mixing sources to target weights.

Each document gets a hash-random key. Keys are dealt to ranges; the sizes before each document in its source are a
prefix sum over ranges plus a running sum inside its range, so no task ever holds a source. Each source is cut at its
exact budget: whole epochs first, then documents in key order, the last one in part.

What the plan needs of a document, its key, source and size, is written to the shared folder first, so that texts are read once
unless they are kept.

Edge cases: a null source is a source of its own, sorted last; a null or empty text has size 0 and is never taken; equal
keys are ordered by id, then size, and of rows alike in all three it makes no difference which comes first; repeated rows count
each; an empty table gives no rows; other columns pass through ``mix`` unchanged, and ``mix`` and ``draw`` give results of their own names
only where docs has no such column (``mix`` refuses to keep one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialize, n_tokens, text_of, work_dir

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RESULTS = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its size, weight and target in words. The table has a row per source, summed before any shuffle.

    Targets are proportional to the weights, none above epochs times its source; the excess goes to the others until
    none is above: sources sorted by how soon they fill up, the full ones are those whose cap is below the share that
    remains for them. Sums are exact decimals.
    """
    by_source = sizes.groupBy(F.col(source_col).alias("s")).agg(F.sum(size_col).cast("decimal(38,0)").alias("n"))
    order = W.orderBy(F.col("s").asc_nulls_last())
    table = by_source.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("decimal(10,0)")).withColumn("cap", (F.col("n") * epochs).cast("decimal(38,0)"))
    fill = W.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")).asc(), F.col("s").asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    table = table.withColumns({"rest": F.sum("n").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest_w": F.sum("w").over(after)})
    table = table.withColumn("full", F.col("cap").cast("double") * F.col("rest_w").cast("double") <= F.col("w").cast("double") * F.col("rest").cast("double"))
    everything = W.partitionBy()
    open_sum, open_w = F.sum("n").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)), F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * open_sum.cast("double") / open_w.cast("double"))
    return table.select(F.col("s").alias(source_col), F.col("n").cast("long").alias("source_size"), target.alias("target"))


def random_key(id_: Column, seed: int) -> Column:
    """Hexadecimal digits that depend on the id and seed alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit(""))))


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(id, key, size, source, extra columns) with source_size, target and taken."""
    rows = sized.count()
    digits = max(1, -(-int(rows**0.5).bit_length() // 4))  # about as many ranges as documents in a range
    keyed = sized.withColumn("range", F.substring("key", 1, digits))
    targets = source_targets(sized, weights=weights, epochs=epochs).withColumnRenamed("source", "t_source")
    ranges = keyed.groupBy(F.col("source").alias("r_source"), F.col("range").alias("r_range")).agg(F.sum("size").alias("offset"))
    upto = W.partitionBy("r_source").orderBy("r_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("offset").over(upto), F.lit(0))).join(targets, F.col("r_source").eqNullSafe(F.col("t_source")), "left")
    within = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    run = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")), "left")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("before")))
    return run.select(*sized.columns, "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but results by default), and size, source_size, target and taken: how many words the mix takes from each document, repeats counted."""
    names = [c for c in docs.columns if c.lower() not in RESULTS] if keep is None else keep
    if clash := {c.lower() for c in names} & set(RESULTS):
        raise ValueError(f"rename {sorted(clash)}: the mix gives columns of these names")
    sized = docs.select(F.col(id_col).alias("id"), random_key(F.col(id_col), seed).alias("key"), F.col(source_col).alias("source"), n_tokens(text_of(text_col)).alias("size"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(names)])
    sized = sized if text_col in names else materialize(sized, work_dir(docs.sparkSession))
    mixed = plan(sized, weights, epochs)
    return mixed.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(names)], *RESULTS)


def draw(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, the last time cut at the budget; columns as in docs, whatever their names."""
    text_col = options.get("text_col", "text")
    size, taken, nth, cut = fresh(docs, "_size_of", "_taken_of", "_nth", "_cut")
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(c).alias(n) for c, n in plain.items()])
    options = {"id_col": "doc_id", "text_col": "text", "source_col": "source"} | options
    mixed = mix(renamed, **(options | {k: plain[options[k]] for k in ("id_col", "text_col", "source_col")}))
    mixed = mixed.select(*[F.col(n).alias(c) for c, n in plain.items()], F.col("size").alias(size), F.col("taken").alias(taken))
    copies = mixed.filter(F.col(taken) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = F.col(taken) - (F.col(nth) - 1) * F.col(size)
    pieces = F.regexp_extract_all(text_of(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(left >= F.col(size), F.col(text_col)).otherwise(F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), ""))
    return copies.withColumn(cut, text).select(*[F.col(cut).alias(c) if c == text_col else F.col(c) for c in docs.columns])
