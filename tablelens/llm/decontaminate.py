"""Benchmark decontamination: a broadcast hash set of normalised n-grams against every token window.

Each word is hashed once; a window's key is the hash of its words' hashes, and only windows whose first two words start one of the
benchmark's become rows: a bitmap of fixed size tells, which passes some others too and loses none. Where the benchmark's windows take at most MOST_BYTES they
are broadcast, and a key that meets one is verified by the words. Beyond, keys are joined by a shuffle: a row of fixed width for each
window, verified by a second hash of the words instead of carrying them.

Edge cases: a null or empty text has no words and no hit; an item without words is ignored; an item of fewer than
n words is a window of its own; repeated rows each get their own result row; repeated items all count; a null item id counts as
an item and is no part of the joined ids; a null document id is an id like any other; other columns of either table are ignored by
``contamination`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, row_key, text_of, words, work_dir

N = 10
#: Bits of the test for how windows start.
BITS = 1 << 20
#: The benchmark's windows are broadcast if their words and items take at most so much.
MOST_BYTES = 64 << 20


def _key(hashes: Column, start: Column, m: int, *salt: Column) -> Column:
    """The hash of m word hashes and their number."""
    return F.xxhash64(F.lit(m), *salt, *[F.get(hashes, start + j) for j in range(m)])


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def benchmark_grams(benchmark: DataFrame, n: int = N, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per distinct window: its length, words, two keys, and the items that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(text_of(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.size("w")
    windows = F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), lambda i: F.slice("w", i + 1, n))).otherwise(F.array("w"))
    grams = items.select("item", F.explode(windows).alias("g"))
    grams = grams.groupBy(F.size("g").alias("g_len"), F.array_join("g", " ").alias("g_words")).agg(F.collect_set(F.struct("item")).alias("g_items"))
    h = _hashes(F.split("g_words", " "))
    key = lambda *salt: F.coalesce(*[F.when(F.col("g_len") == m, _key(h, F.lit(0), m, *salt)) for m in range(1, n + 1)])
    return grams.withColumns({"g_key": key(), "g_second": key(F.lit("second"))})


def _start(h: Column, i: Column, m: int) -> Column:
    """What a window's first words hash to: two of them, or the only one."""
    return F.xxhash64(F.get(h, i), F.get(h, i + 1)) if m > 1 else F.xxhash64(F.get(h, i))


def _starts(grams: DataFrame) -> Column:
    """A bitmap of the hashes that windows start with, as an array literal of BITS / 64 numbers: whatever the benchmark's size, no larger."""
    h = _hashes(F.split("g_words", " "))
    of = grams.select(F.when(F.col("g_len") > 1, _start(h, F.lit(0), 2)).otherwise(_start(h, F.lit(0), 1)).alias("s"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    words_ = {r["w"]: r["b"] for r in of.groupBy(F.shiftright("s", 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int").alias("w")).agg(F.bit_or(one).alias("b")).collect()}
    return F.expr(f"cast(split('{','.join(str(words_.get(w, 0)) for w in range(BITS // 64))}', ',') as array<bigint>)")


def _may_start(starts: Column, s: Column) -> Column:
    word = F.get(starts, F.shiftright(s, 6).bitwiseAND(F.lit(BITS // 64 - 1)).cast("int"))
    return F.call_function("shiftright", word, s.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _upto(at: Column, last: Column) -> Column:
    return F.filter(at, lambda i: i <= last)


def _windows(h: Column, lengths: list[int], starts: Column, second: bool) -> Column:
    """(len, pos, key, second) of the windows of the given lengths that start as one of the benchmark does, and one of length 0 so that no document is lost."""
    none = F.lit(None).cast("long")

    def window(m: int):
        return lambda i: F.struct(F.lit(m).alias("len"), i.alias("pos"), _key(h, i, m).alias("key"), (_key(h, i, m, F.lit("second")) if second else none).alias("second"))

    own = F.array(F.struct(F.lit(0).alias("len"), F.lit(-1).alias("pos"), none.alias("key"), none.alias("second")))
    where = lambda m: F.when(F.size(h) >= m, F.filter(F.sequence(F.lit(0), F.size(h) - m), lambda i: _may_start(starts, _start(h, i, m)))).otherwise(F.array().cast("array<int>"))
    parts = [own]
    if 1 in lengths:
        parts.append(F.transform(where(1), window(1)))
    longer = [m for m in lengths if m > 1]
    if longer:
        parts.append(let(where(2), lambda at: F.concat(*[F.transform(_upto(at, F.size(h) - m) if m > 2 else at, window(m)) for m in longer])))
    return F.concat(*parts)


def _hit_words(hits: Column) -> Column:
    """How many positions the union of the windows covers."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["len"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("total"))
    return F.aggregate(F.array_sort(hits), zero, step, lambda a: a["total"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (sorted ids), spans (word positions), contaminated.

    One scan of the documents and one shuffle of a row for each document and hit. Only documents' own hits meet in a
    group, which the length of a document bounds.
    """
    grams = materialize(benchmark_grams(benchmark, n, item_col, item_text_col), work_dir(docs.sparkSession))
    said = grams.groupBy("g_len").agg(F.sum(F.octet_length("g_words") + F.octet_length(F.to_json("g_items")) + 64).alias("bytes")).collect()  # n rows at most
    lengths, small = sorted(r["g_len"] for r in said), sum(r["bytes"] for r in said) <= most_bytes
    base = docs.select(F.col(id_col).alias("_id"), row_key(text_of(text_col)).alias("_key"), words(text_of(text_col)).alias("_w"))
    starts = _starts(grams)
    of = let(_hashes(F.col("_w")), lambda h: _windows(h, lengths, starts, not small))
    windows = base.select("_id", "_key", F.size("_w").cast("long").alias("n_words"), *(["_w"] if small else []), F.explode_outer(of).alias("x"))
    windows = windows.select("_id", "_key", "n_words", *(["_w"] if small else []), "x.len", "x.pos", F.col("x.key").alias("g_key"), "x.second")
    if small:
        found = windows.join(F.broadcast(grams), "g_key", "left")
        true_hit = (F.col("len") == F.col("g_len")) & (F.array_join(F.slice("_w", F.col("pos") + 1, F.greatest(F.col("len"), F.lit(1))), " ") == F.col("g_words"))
    else:
        found = windows.join(grams.drop("g_words").hint("merge"), "g_key", "left")
        true_hit = (F.col("len") == F.col("g_len")) & (F.col("second") == F.col("g_second"))
    found = found.filter((F.col("pos") < 0) | F.coalesce(true_hit, F.lit(False)))
    hit = F.when(F.col("pos") >= 0, F.struct("pos", "len"))
    per_doc = found.groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(hit).alias("_hits"),
        F.array_distinct(F.flatten(F.collect_set("g_items"))).alias("_items"),
        F.sum((F.col("pos") < 0).cast("int")).alias("_times"),
    )
    out = per_doc.select("*", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        _hit_words(F.col("_hits")).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sort_array(F.transform("_items", lambda x: x["item"])).alias("items"),
        F.array_sort("_hits").alias("spans"),
        (F.size("_hits") > 0).alias("contaminated"),
        F.col("_key").alias("text_key"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", remove: str = "documents") -> DataFrame:
    """Documents without benchmark passages, with the columns of docs.

    remove="documents" drops each document with a hit; "spans" cuts the hit words and what stands between them.
    """
    bad_id, bad_key, spans, text = fresh(docs, "_bad_id", "_bad_key", "_bad_spans", "_text_left")
    marks = contamination(docs, benchmark, n, id_col, text_col, item_col, item_text_col).filter("contaminated").groupBy(F.col(id_col).alias(bad_id), F.col("text_key").alias(bad_key)).agg(F.first("spans").alias(spans))
    same = F.col(id_col).eqNullSafe(F.col(bad_id)) & (row_key(text_of(text_col)) == F.col(bad_key))
    if remove == "documents":
        return docs.join(marks, same, "left_anti")
    # word k of the text ends the k-th piece; pieces whose word is hit go, with the gap before them
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}]+\z"), F.lit(0))
    cut = F.array_join(F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (i >= s["pos"]) & (i < s["pos"] + s["len"]))), "")
    joined = docs.join(marks, same, "left").withColumn(text, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut))
    return joined.select(*[F.col(text).alias(c) if c == text_col else F.col(c) for c in docs.columns])
