"""Line dedup by an exact set-similarity join.

A line's set is its distinct words; of each word a 64-bit hash is kept. A later line goes if an earlier one, kept or not, has a
Jaccard similarity of at least 0.8 with it. Lines are ordered by (id, position).

1. Lines of equal sets are one class, found by key; only a class's first line goes on.
2. Words are ordered by rarity among the lines compared: by how often words of their hash's slot occur in them, then by hash. Any
   total order gives the same result.
3. Sets of up to 7 words only match sets with one word more or less: the shorter's key is among the longer's keys of all but one word.
4. Longer sets meet by a prefix filter over k neighbours in the rarity order, first pairs. A word that only x has breaks
   k of x's grams, one that only y has k - 1; with 5 a + 4 b <= n at most floor(k n / 5) of the grams of x are broken, so one
   of its first floor(k n / 5) + 1 is shared and among as many of y's. Length, position and 64 parity bits of the words
   filter what meets, wider parities, which tell long lines apart too, filter what is left, then the sets themselves decide. So few sets move.
5. In a gram's group of at most ``GROUP`` lines each meets those before it. Other grams are common: there a line meets the first and the one
   before it, and two lines whose first shared gram is common both have a common one, so all lines with one go on to grams of
   three neighbours. What has common ones again meets by its first floor(k n / 5) + 1 grams that are not common: the bound on
   broken grams holds for any choice of grams to leave out. Only lines with too few of these, or again with common ones, variants
   of one text or lines around one passage, are compared with all that share one of their floor(n / 5) + 1 words rarest among themselves,
   and what the first steps found gone asks no more.

So rows grow with the lines and their matches, and no group is collected. Comparisons within the last step can grow with the
square of a group of lines that share even their rarest words and are not alike.

Edge cases: lines without words are never removed and remove nothing, as are those of fewer than ``min_words`` distinct words. A null text
stays null; an emptied text is the empty string; rows that repeat an id are versions of one document: what goes at a position
goes in all, and the first of equal lines stays in all; a null id comes first; other columns pass through ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, folded, fresh, materialize, text_of, work_dir

NUM, DEN = 4, 5
#: Sets of at most so many words match by leaving out one word; from 8 words on two words may differ.
SHORT = 7
#: A line meets all lines before it in a gram's group of at most so many; grams of larger groups are common.
GROUP = 64
#: Words are counted by this many slots of their hashes.
SLOTS = 1 << 14
#: Neighbours in a gram, and how often lines meet by such grams, after the first time without the common ones. Sets of more than
#: SHORT words have grams enough.
GRAMS = ((2, 1), (3, 2))
#: A list of lines or grams is broadcast up to this many rows of fixed width, else joined by a shuffle.
MEMBERS = 500_000
#: The last step's lines are broadcast up to so many words in all their marks, lists of common grams up to so many places.
WORDS = 1 << 22
#: Parities of 64 bits that pairs are filtered by before their sets move; a power of two. Those in marks tell sets of up to some 100 words apart, these up to some 400.
WIDE = 4
#: Sizes and places have 16 bits in marks; lines of as many words pass all filters.
MOST = 0xFFFF
#: What words of folded text are made of, all but WORD_GAP, one by one: Java looks single characters up in a table and tries ranges one after another.
_LETTER = "[" + "".join(f"\\x{c:02x}" for c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))) + "]"


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MEMBERS else df


def lines_of(docs: DataFrame, id_col: str, text_col: str, min_words: int = 1) -> DataFrame:
    """(_id, _pos, _h1, _h2, _s): the sorted hashes of each line's distinct words, and two keys of that."""
    # outer, as Spark would else split each text a second time to see that there are lines. A row per line has its set worked out by compiled code, within a lambda it is not
    lines = docs.select(F.col(id_col).alias("_id"), F.posexplode_outer(F.split(folded(text_of(text_col)), "\n", -1)).alias("_pos", "line"))
    sets = lines.filter(F.col("line").rlike(_LETTER)).select("_id", "_pos", _word_set(F.col("line")).alias("_s"))
    sets = sets.filter(F.size("_s") >= min_words) if min_words > 1 else sets
    return sets.select("_id", "_pos", F.xxhash64("_s").alias("_h1"), F.xxhash64(F.lit(1), "_s").alias("_h2"), "_s")


def _word_set(line: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(f"{_LETTER}+"), F.lit(0)), lambda w: F.xxhash64(w))))


def _slot_ranks(lines: DataFrame, slots: int) -> Column:
    """An array literal: each slot's place when slots are ordered by how often their words occur in all lines."""
    slot = F.col("h").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")
    counts = {r["slot"]: r["n"] for r in lines.select(F.explode("_s").alias("h")).select(slot).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = [0] * slots
    for place, slot in enumerate(sorted(range(slots), key=lambda x: (counts.get(x, 0), x))):
        rank[slot] = place
    return F.expr(f"cast(split('{','.join(map(str, rank))}', ',') as array<int>)")


def _by_rarity(s: Column, ranks: Column, slots: int) -> Column:
    """The words as numbers in rarity order: the slot's rank above the other bits of the hash, so that words stay apart."""
    bits = slots.bit_length() - 1

    def code(h: Column) -> Column:
        rank = F.get(ranks, h.bitwiseAND(F.lit(slots - 1)).cast("int")) - F.lit(slots // 2)
        return F.shiftleft(rank.cast("long"), 64 - bits).bitwiseOR(F.shiftrightunsigned(h, bits))

    return F.sort_array(F.transform(s, code))


def _parity(s: Column) -> Column:
    """64 bits: whether each bit is named by an odd number of words. Two lines differ in at least as many words as bits."""
    one = F.lit(1).cast("long")
    return F.aggregate(s, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(F.call_function("shiftleft", one, F.shiftrightunsigned(h, 3).bitwiseAND(F.lit(63)).cast("int"))))


def _sketch(s: Column) -> Column:
    """WIDE parities, each of the words that two other bits of the hash send there."""

    def part(k: int) -> Column:
        return _parity(F.filter(s, lambda h: F.shiftrightunsigned(h, 9).bitwiseAND(F.lit(WIDE - 1)) == k))

    return F.array(*[part(k) for k in range(WIDE)])


def _gram(s: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(s, i + j) for j in range(k)])


def _quota(n: Column, k: int) -> Column:
    """How many grams that may be shared a line needs: one more than can be broken."""
    return F.floor(n * k / DEN).cast("int") + 1


def _at(pos: Column, n: Column, i: Column) -> Column:
    """Position, size and place in one number. It orders by position."""
    most = F.lit(MOST)
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(F.shiftleft(F.least(n, most).cast("long"), 16)).bitwiseOR(F.least(i, most).cast("long"))


def _parts(mark: Callable[[str], Column]) -> list[Column]:
    """id, pos, n, i and bits of a mark."""
    at = mark("at")
    low = at.bitwiseAND(F.lit(0xFFFFFFFF))
    return [mark("id").alias("id"), F.shiftright(at, 32).cast("int").alias("pos"), F.shiftright(low, 16).cast("int").alias("n"), low.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("i"), mark("bits").alias("bits")]


def _fits(x: Column | dict, y: Column | dict) -> Column:
    """Parity, length and positional filters of two marks' parts, the cheapest and sharpest first."""
    n, m, i, j = x["n"], y["n"], x["i"], y["i"]
    huge = (n == MOST) | (m == MOST)
    parity = F.bit_count(x["bits"].bitwiseXOR(y["bits"])) * (NUM + DEN) <= (n + m) * (DEN - NUM)
    length = F.least(n, m) * DEN >= F.greatest(n, m) * NUM
    place = (F.least(i, j) + F.least(n - i, m - j)) * (NUM + DEN) >= (n + m) * NUM
    return (parity & length & place) | huge


def _grams(sets: DataFrame, rare: Callable[[Column], Column], k: int, last: Callable[[Column], Column], *keep: str) -> DataFrame:
    """(_id, _pos, *keep, n, bits, i, gram): grams 0 to last(n) of each set. A row per gram is hashed by compiled code, which carries no array on."""
    each = sets.select("_id", "_pos", *keep, F.size("_s").alias("n"), rare(F.col("_s")).alias("o"))
    each = each.select("_id", "_pos", *keep, "n", "o", _parity(F.col("o")).alias("bits"))
    each = each.select("_id", "_pos", *keep, "n", "o", "bits", F.explode_outer(F.sequence(F.lit(0), last(F.col("n")))).alias("i"))
    return each.select("_id", "_pos", *keep, "n", "bits", "i", _gram(F.col("o"), F.col("i"), k).alias("gram"))


def _first_marks(sets: DataFrame, rare: Callable[[Column], Column], k: int, *keep: str) -> DataFrame:
    """(gram, id, at, bits, *keep): the prefix of each set (_id, _pos, _s). rare puts words in rarity order."""
    each = _grams(sets, rare, k, lambda n: _quota(n, k) - 1, *keep)
    return each.select("gram", F.col("_id").alias("id"), _at(F.col("_pos"), F.col("n"), F.col("i") + 1).alias("at"), "bits", *keep)


def _other_marks(sets: DataFrame, rare: Callable[[Column], Column], common: DataFrame, k: int, path: str) -> tuple[DataFrame, DataFrame]:
    """Marks of the first grams that are not common, and the (_id, _pos) of sets that have too few of them. Of the grams only the places of common ones move, a list per line."""
    hits = _grams(sets, rare, k, lambda n: n - k, "_h1").join(_few(common), "gram", "left_semi")
    # versions of a line apart, repeated ones alike
    hits = hits.groupBy("_id", "_pos", "_h1").agg(F.collect_set("i").alias("o_out"))
    hits = materialize(hits.select(F.col("_id").alias("o_id"), F.col("_pos").alias("o_pos"), F.col("_h1").alias("o_h1"), "o_out"), f"{path}/hits")
    size = hits.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("o_out")), F.lit(0)).alias("places")).first()
    hits = F.broadcast(hits) if size["rows"] <= MEMBERS and size["places"] <= WORDS else hits
    each = sets.join(hits, F.col("_id").eqNullSafe(F.col("o_id")) & (F.col("_pos") == F.col("o_pos")) & (F.col("_h1") == F.col("o_h1")), "left")
    n = F.size("_s")
    each = each.select("_id", "_pos", n.alias("n"), rare(F.col("_s")).alias("o"), F.array_except(F.sequence(F.lit(0), n - k), F.coalesce("o_out", F.array().cast("array<int>"))).alias("left"))
    each = each.select("_id", "_pos", "n", "o", _parity(F.col("o")).alias("bits"), F.slice("left", F.lit(1), _quota(F.col("n"), k)).alias("left"))
    each = materialize(each, f"{path}/others")
    scant = each.filter(F.size("left") < _quota(F.col("n"), k)).select("_id", "_pos")
    each = each.select("_id", "_pos", "n", "o", "bits", F.explode("left").alias("i"))
    marks = each.select(_gram(F.col("o"), F.col("i"), k).alias("gram"), F.col("_id").alias("id"), _at(F.col("_pos"), F.col("n"), F.col("i") + 1).alias("at"), "bits")
    return marks, materialize(scant, f"{path}/scant")


def _less(df: DataFrame, lines: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows whose (_id, _pos) is not, or by how is, among lines."""
    other = lines.select(F.col("_id").alias("_o_id"), F.col("_pos").alias("_o_pos"))
    return df.join(_few(other), F.col("_id").eqNullSafe(F.col("_o_id")) & (F.col("_pos") == F.col("_o_pos")), how)


def _meet(marks: DataFrame, path: str) -> DataFrame:
    """(gram, _id, _pos, common, ys) per mark that meets a line it may match or whose gram is common, written once.

    ys are the lines before it; of a common gram's group only the first and the one before, as most variants of a text match these.
    """
    group = W.partitionBy("gram")
    order = group.orderBy("id", "at")
    shared = marks.withColumn("k", F.count(F.lit(1)).over(group)).filter("k > 1")
    shared = shared.select("gram", "at", (F.col("k") > GROUP).alias("common"), *_parts(F.col))
    y = F.struct("id", "pos", "n", "i", "bits")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # the list of a group that is not common is short, and of one that is common empty
    shared = shared.withColumns({"near": F.collect_list(F.when(~F.col("common"), y)).over(before), "head": F.first(y).over(before), "last": F.lag(y).over(order)})
    met = F.when(F.col("common"), F.array_compact(F.array("head", "last"))).otherwise(F.col("near"))
    x = {c: F.col(c) for c in ("id", "pos", "n", "i", "bits")}
    may = F.filter(met, lambda c: _fits(x, c) & ~(c["id"].eqNullSafe(x["id"]) & (c["pos"] == x["pos"])))
    ys = F.transform(may, lambda c: F.struct(F.bit_count(c["bits"].bitwiseXOR(x["bits"])).alias("differ"), c["id"].alias("id"), c["pos"].alias("pos")))
    found = shared.select("gram", F.col("id").alias("_id"), F.col("pos").alias("_pos"), "common", ys.alias("ys")).filter("common or size(ys) > 0")
    return materialize(found, path)


def _alike(pairs: DataFrame, sets: DataFrame, path: str = "") -> DataFrame:
    """Pairs (_id, _pos, y_id, y_pos) whose sizes and sketches leave a match possible. Pairs with one sketch go to the other, sent to all if they are few and there is a path to write them to; sets do not move."""
    facts = lambda c: sets.select(F.col("_id").alias(f"{c}_id"), F.col("_pos").alias(f"{c}_pos"), F.size("_s").alias(f"{c}_n"), F.col("_sketch").alias(f"{c}_k"))
    a = facts("a").join(_few(pairs), F.col("_id").eqNullSafe(F.col("a_id")) & (F.col("_pos") == F.col("a_pos"))).drop("a_id", "a_pos")
    both = facts("b").join(_few(materialize(a, path)) if path else a, F.col("y_id").eqNullSafe(F.col("b_id")) & (F.col("y_pos") == F.col("b_pos")))
    n, m = F.col("a_n"), F.col("b_n")
    differ = sum((F.bit_count(F.get("a_k", F.lit(k)).bitwiseXOR(F.get("b_k", F.lit(k)))) for k in range(WIDE)), F.lit(0))
    may = (F.least(n, m) * DEN >= F.greatest(n, m) * NUM) & (differ * (NUM + DEN) <= (n + m) * (DEN - NUM))
    return both.filter(may).select("_id", "_pos", "y_id", "y_pos").distinct()


def _similar(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """(_id, _pos) of pairs (_id, _pos, y_id, y_pos) whose sets match. Pairs go to where the sets are, so that a set moves once for its pair, and once as a partner."""
    pairs = materialize(_alike(materialize(pairs, f"{path}-pairs"), sets, f"{path}-half"), f"{path}-alike")
    a = sets.select(F.col("_id").alias("a_id"), F.col("_pos").alias("a_pos"), F.col("_s").alias("a_s"))
    a = a.join(_few(pairs), F.col("_id").eqNullSafe(F.col("a_id")) & (F.col("_pos") == F.col("a_pos"))).drop("a_id", "a_pos")
    partners = materialize(pairs.select(F.col("y_id").alias("_id"), F.col("y_pos").alias("_pos")).distinct(), f"{path}-partners")
    b = _less(sets.select("_id", "_pos", "_s"), partners, "left_semi").select(F.col("_id").alias("b_id"), F.col("_pos").alias("b_pos"), F.col("_s").alias("b_s"))
    both = a.join(b, F.col("y_id").eqNullSafe(F.col("b_id")) & (F.col("y_pos") == F.col("b_pos")))
    both = both.select("_id", "_pos", F.size("a_s").alias("n"), F.size("b_s").alias("m"), F.size(F.array_intersect("a_s", "b_s")).alias("both"))
    return both.filter(F.col("both") * DEN >= (F.col("n") + F.col("m") - F.col("both")) * NUM).select("_id", "_pos").distinct()


def _gone_of(met: DataFrame, sets: DataFrame, gone: DataFrame, again: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """gone and the lines that match one they met: first the one each is likeliest to match, then, for the rest, all. Beside it the sets of those that met and of again."""
    met = _less(met.filter("size(ys) > 0"), gone).select("_id", "_pos", "ys")
    members = met.select("_id", "_pos").union(met.select(F.explode("ys").alias("y")).select("y.id", "y.pos")).union(again).distinct()
    # all sets are read once for both
    texts = _less(sets.select("_id", "_pos", "_h1", "_s"), materialize(members, f"{path}/members"), "left_semi").withColumn("_sketch", _sketch(F.col("_s")))
    texts = materialize(texts, f"{path}/texts")
    y = lambda df: df.select("_id", "_pos", F.col("y.id").alias("y_id"), F.col("y.pos").alias("y_pos"))
    best = y(met.groupBy("_id", "_pos").agg(F.min(F.array_min("ys")).alias("y")))
    sure = materialize(_similar(best, texts, f"{path}/best"), f"{path}/sure")
    rest = y(_less(met, sure).select("_id", "_pos", F.explode("ys").alias("y"))).distinct()
    return materialize(gone.unionByName(sure).unionByName(_similar(rest, texts, f"{path}/rest")), f"{path}/gone"), texts.drop("_sketch")


def _short_gone(sets: DataFrame) -> DataFrame:
    """(_id, _pos) of sets that have a word more or less than an earlier one of at most SHORT words has or leaves."""
    n = F.size("_s")
    key = lambda s: F.struct(F.xxhash64(s).alias("g1"), F.xxhash64(F.lit(1), s).alias("g2"))
    own = sets.filter(n.between(NUM, SHORT)).select(key(F.col("_s")).alias("g"), F.col("_id").alias("y_id"), F.col("_pos").alias("y_pos"))
    without = F.transform("_s", lambda w: key(F.array_remove("_s", w)))
    longer = sets.filter(n.between(NUM + 1, SHORT + 1)).select(F.explode(without).alias("g"), "_id", "_pos")
    x, y = F.struct("_id", "_pos"), F.struct(F.col("y_id").alias("_id"), F.col("y_pos").alias("_pos"))
    both = longer.join(_few(own), "g").filter(~x.eqNullSafe(y))
    return both.select(F.greatest(x, y).alias("late")).select("late._id", "late._pos").distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, slots: int = SLOTS) -> DataFrame:
    """_removals(), written once; what led to it is deleted."""
    path, out = work_dir(docs.sparkSession), work_dir(docs.sparkSession)
    gone = materialize(_removals(docs, path, id_col, text_col, min_words, slots), out)
    drop(docs.sparkSession, path)
    return gone


def _all_gone(sets: DataFrame, ranked: Callable[[DataFrame], Callable[[Column], Column]], path: str) -> DataFrame:
    """(_id, _pos) of the class firsts (_id, _pos, _h1, _s) that match an earlier one. ranked gives the rarity order among some sets."""
    short = materialize(sets.filter(F.size("_s").between(NUM, SHORT + 1)).select("_id", "_pos", "_s"), f"{path}/short-sets")
    gone = materialize(_short_gone(short), f"{path}/short")
    rest = sets.filter(F.size("_s") > SHORT)
    for k, turns in GRAMS:
        rare = ranked(rest)
        marks, scant, common = _first_marks(rest, rare, k), None, None
        for turn in range(turns):
            at = f"{path}/{k}-{turn}"
            met = _meet(marks, f"{at}/met")
            often = met.filter("common")
            again = materialize(often.select("_id", "_pos").distinct(), f"{at}/again")
            gone, met_sets = _gone_of(met, rest, gone, again, at)
            if turn + 1 < turns:
                grams = often.select("gram").distinct()
                common = materialize(grams if common is None else common.unionByName(grams), f"{at}/common")
                rest = materialize(_less(met_sets, again, "left_semi"), f"{at}/rest")
                marks, few = _other_marks(rest, rare, common, k, at)
                scant = few if scant is None else scant.unionByName(few)
        # scant ones need not have met any
        left, of = (again, met_sets) if scant is None else (scant.unionByName(again).distinct(), rest)
        rest = materialize(_less(of, left, "left_semi"), f"{path}/{k}-left")
    return _last(rest, ranked(rest), gone, f"{path}/last")


def _last(sets: DataFrame, rare: Callable[[Column], Column], gone: DataFrame, path: str) -> DataFrame:
    """gone and the lines left that match an earlier one.

    Among themselves what they have in common is frequent, so that single words in their own rarity order tell them apart best.
    Lines that share one and pass the filters are compared in the join itself, so that only matches become rows.
    """
    marks = _first_marks(sets, rare, 1, "_s")
    marks = materialize(marks.select("gram", F.struct(*_parts(F.col), F.col("_s").alias("s")).alias("y")), f"{path}/marks")
    x = _less(marks.select(F.col("y.id").alias("_id"), F.col("y.pos").alias("_pos"), "gram", F.col("y").alias("x")), gone).select("gram", "x")
    x = materialize(x, f"{path}/late")
    few = x.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("x.s")), F.lit(0)).alias("words")).first()
    x = F.broadcast(x) if few["rows"] <= MEMBERS and few["words"] <= WORDS else x
    a, b = F.col("x"), F.col("y")
    late = F.struct(a["id"].alias("id"), a["pos"].alias("pos")) > F.struct(b["id"].alias("id"), b["pos"].alias("pos"))
    both = F.size(F.array_intersect(a["s"], b["s"]))
    match = both * DEN >= (F.size(a["s"]) + F.size(b["s"]) - both) * NUM
    found = marks.join(x, "gram").filter(_fits(a, b) & late & match).select(a["id"].alias("_id"), a["pos"].alias("_pos"))
    return materialize(gone.unionByName(found.distinct()), f"{path}/gone")


def _removals(docs: DataFrame, path: str, id_col: str, text_col: str, min_words: int, slots: int) -> DataFrame:
    """(_id, _gone): for each document that loses lines, their positions, sorted."""
    # a file's words fit one dictionary, so that a hash takes the bits of its number
    lines = materialize(lines_of(docs, id_col, text_col, min_words), f"{path}/lines", "lz4", **{"parquet.dictionary.page.size": 16 << 20})
    keys = lines.select("_id", "_pos", "_h1", "_h2")
    repeated = keys.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_pos")).alias("f"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("_h1", "_h2", "f")
    repeated = materialize(repeated, f"{path}/repeated")
    first = F.col("f").isNull() | (F.col("_id").eqNullSafe(F.col("f._id")) & (F.col("_pos") == F.col("f._pos")))
    sets = lines.join(_few(repeated), ["_h1", "_h2"], "left").filter(first).select("_id", "_pos", "_h1", "_s")

    def ranked(some: DataFrame) -> Callable[[Column], Column]:
        ranks = _slot_ranks(some, slots)
        return lambda s: _by_rarity(s, ranks, slots)

    gone = _all_gone(sets, ranked, path)
    # a line is lost if its class's first line is, or if it is not the first
    lost = materialize(_less(keys, gone, "left_semi").select("_h1", "_h2").distinct(), f"{path}/lost")
    again = keys.join(_few(repeated), ["_h1", "_h2"]).filter(~first).select("_id", "_pos")
    with_first = keys.join(_few(lost), ["_h1", "_h2"], "left_semi").select("_id", "_pos")
    return again.unionByName(with_first).groupBy("_id").agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))


def line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: the id, n_lines, n_removed, removed (positions from 0)."""
    gone = removals(docs, id_col, text_col, **options)
    own = docs.select(F.col(id_col).alias("_own"), F.size(F.split(text_of(text_col), "\n", -1)).cast("long").alias("n_lines"))
    out = own.join(gone, F.col("_own").eqNullSafe(F.col("_id")), "left")
    # rows that repeat an id with another text may be shorter
    spots = F.filter(F.coalesce("_gone", F.array().cast("array<int>")), lambda p: p < F.col("n_lines"))
    return out.select(F.col("_own").alias(id_col), "n_lines", F.size(spots).cast("long").alias("n_removed"), spots.alias("removed"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without the lines that repeat earlier ones, with the columns of docs."""
    gone_id, gone_at = fresh(docs, "_gone_id", "_gone_at")
    gone = removals(docs, id_col, text_col, **options)
    # texts stay where they are unless many lines go; a position has four bytes, far less than a row
    size = gone.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("_gone")), F.lit(0)).alias("spots")).first()
    few = size["rows"] <= MEMBERS and size["spots"] <= 8 * MEMBERS
    gone = gone.select(F.col("_id").alias(gone_id), F.col("_gone").alias(gone_at))
    joined = docs.join(F.broadcast(gone) if few else gone, F.col(id_col).eqNullSafe(F.col(gone_id)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(gone_at, i)), "\n")
    return joined.select(*[F.when(F.col(gone_at).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(left).alias(c) if c == text_col else F.col(c) for c in docs.columns])
