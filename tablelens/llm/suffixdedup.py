"""Suffix-array dedup: bytes covered by a string of ``n`` bytes that also starts in a document of a smaller id are removed.

1. Every window of n bytes has an anchor: of its ``GRAM``-byte strings the one whose hash is least, the leftmost of equals. Equal windows
   have equal anchors at equal places. Neighbouring windows with one anchor are a unit, some sixteen windows and one row.
2. A unit whose anchor string no document of another id has is unique, and gone after one shuffle by anchor. A batch knows its
   own repeated anchors: it sends one witness of each, and the units themselves to any task, so that no anchor gathers more rows than
   there are batches.
3. Units of equal bytes are one class with its smallest id. A class alone with its anchor is settled.
4. The windows of the other classes are suffixes to sort: per anchor and place of the anchor, by a radix sort of their bytes from the first on,
   some at a time, which goes on only with those that are alike so far. Equal suffixes get the smallest id of their classes. Anchors with more than
   ``CHUNK`` classes are sorted in chunks, and what the chunks found is combined by the windows' bytes.
5. Each unit loses the windows whose smallest id is below its document's. Where they are applied, the unit's bytes are hashed again, so
   that only the text that was judged is cut.

Hashes are 64-bit polynomials, none of them part of the sort; a class has the anchor's and the unit's, of different bases.

Edge cases: a null or empty text has no bytes and stays empty; texts shorter than n lose nothing; rows that repeat an id are
versions of one document, which lose nothing to each other and each what a smaller id has; a null id is smaller than all others;
texts are cut at bytes, so that what is kept is binary and may break a character; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, text_of, work_dir
from .textfeat import slices

#: Bytes of an anchor.
GRAM = 20
#: Bytes of text that are hashed at once; longer texts go in blocks, whose windows overlap.
BLOCK = 50_000
#: Classes of an anchor that are sorted in one task, and bytes that are sorted at once unless one chunk has more.
CHUNK, SORTED = 1 << 14, 1 << 18
#: Units whose bytes are cut out at once.
UNITS = 50_000
#: Parts of a unit's place: 14 bits of its row's hash; its start, 31 bits; how many windows it has and where its anchor is, 8 bits each. Above
#: them is, until units are judged, what the row is.
ROW_BITS, FLAG_AT = 14, 61

_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Of a unit's row: a candidate, known to repeat, or a witness that an anchor repeats.
ASKS, REPEATS, WITNESS = 0, 1, 2


@lru_cache(4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base modulo 2**64, and their inverses."""

    def up(b: int) -> np.ndarray:
        out, have = np.ones(n + 1, np.uint64), 1
        while have <= n:
            more = min(have, n + 1 - have)
            out[have : have + more] = out[:more] * np.uint64(b)
            b, have = b * b % 2**64, have + more
        return out

    return up(base), up(pow(base, -1, 2**64))


class Hashes:
    """Polynomial hashes of all substrings of some bytes, from the hashes of its prefixes."""

    def __init__(self, data: np.ndarray, base: int = _BASE):
        room = 1 << max(20, (len(data) - 1).bit_length())
        self.up, self.down = _powers(base, room)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def units(data: np.ndarray, offsets: np.ndarray, n: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, key, hash) of the units of texts one after another: key is the anchor's hash, hash the unit's, anchor its place in the unit."""
    wide, low, parts = n - gram + 1, np.uint64((1 << 24) - 1), []
    for at in range(0, max(0, len(data) - n + 1), BLOCK):
        block = data[at : at + BLOCK + n - 1]
        grams = Hashes(block)
        key = (grams.sums[gram:] - grams.sums[:-gram]) * grams.down[: len(block) - gram + 1]
        least, have = (_mixed(key) & ~low) | np.arange(len(key), dtype=np.uint64), 1
        while have < wide:
            step = min(have, wide - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        anchor = (least & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        # windows within the anchor's text
        text = np.searchsorted(offsets, anchor + at, side="right") - 1
        first, last = np.maximum(first, offsets[text] - at), np.minimum(last, offsets[text + 1] - n - at)
        text, first, last, anchor = (x[first <= last] for x in (text, first, last, anchor))
        whole = Hashes(block, _OTHER).of(first, last + n) ^ (last + n - first).astype(np.uint64)
        parts.append((text, first + at - offsets[text], last - first + 1, anchor - first, key[anchor], whole))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, t) for t in [np.int64] * 4 + [np.uint64] * 2)


def _place(start: np.ndarray, count: np.ndarray, anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
    return (row << 47) | (start << 16) | (count << 8) | anchor


def _codes(ids: pa.Array) -> np.ndarray:
    """Numbers of the distinct ids, null one of them, in no order."""
    coded = ids.dictionary_encode(null_encoding="encode")
    return np.asarray((coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded).indices, dtype=np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values one after another, and where each begins and the last ends."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _all_units(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """(_id, _key, _unit, _at) of all units; of an anchor that ids of one batch share a witness beside them."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_text"):
                data, offsets = _bytes(texts)
                of, start, count, anchor, key, unit = units(data, offsets, n, gram)
                at = _place(start, count, anchor, np.asarray(piece.column("_row"), dtype=np.int64)[of])
                code = _codes(piece.column("_id"))[of]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0])) if len(order) else order
                several = np.zeros(0, bool)
                if len(first):
                    several = np.minimum.reduceat(code[order], first) != np.maximum.reduceat(code[order], first)
                flag = np.empty(len(key), np.int64)
                flag[order] = np.repeat(several, np.diff(np.append(first, len(order)))) * REPEATS
                shown = order[first[several]]
                every = np.concatenate([np.arange(len(key)), shown])
                flag = np.concatenate([flag, np.full(len(shown), WITNESS, np.int64)])
                ids = piece.column("_id").take(pa.array(of[every]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key[every].view(np.int64)), pa.array(unit[every].view(np.int64)), pa.array(at[every] | flag << FLAG_AT)], names=["_id", "_key", "_unit", "_at"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"_id {kind}, _key long, _unit long, _at long")


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of _key, those whose key has several ids or a witness, and those known to repeat."""
    open_rows = None

    def judged(rows: pa.Table) -> pa.Table:
        key, flag, code = np.asarray(rows["_key"].combine_chunks()), np.asarray(rows["_at"].combine_chunks()) >> FLAG_AT, _codes(rows["_id"].combine_chunks())
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        live = (np.minimum.reduceat(code, first) != np.maximum.reduceat(code, first)) | (np.maximum.reduceat(flag, first) == WITNESS)
        return rows.filter(pa.array(np.repeat(live, np.diff(np.append(first, len(key)))) & (flag == ASKS)))

    def unmarked(rows: pa.Table) -> list[pa.RecordBatch]:
        return rows.set_column(3, "_at", pc.bit_wise_and(rows["_at"], (1 << FLAG_AT) - 1)).to_batches()

    for batch in batches:
        known = pa.array(np.asarray(batch["_at"]) >> FLAG_AT == REPEATS)
        out, asks = [pa.Table.from_batches([batch]).filter(known)], pa.Table.from_batches([batch]).filter(pc.invert(known))
        asks = asks if open_rows is None else pa.concat_tables([open_rows, asks])
        if asks.num_rows:
            key = np.asarray(asks["_key"].combine_chunks())
            cut = int(np.searchsorted(key, key[-1]))
            open_rows = asks.slice(cut)
            if cut:
                out.append(judged(asks.slice(0, cut)))
        for t in out:
            yield from unmarked(t)
    if open_rows is not None:
        yield from unmarked(judged(open_rows))


def extension(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to most, the suffixes from a and from b have in common, by binary search over their prefixes' hashes. suffix_sort, which goes by bytes, does without."""
    out = np.full(len(a), most, np.int64)
    a_sum, a_down, b_sum, b_down = hashes.sums[a], hashes.down[a], hashes.sums[b], hashes.down[b]
    # most are alike to the end, or not
    differ = np.flatnonzero((hashes.sums[a + most] - a_sum) * a_down != (hashes.sums[b + most] - b_sum) * b_down)
    a, b, a_sum, a_down, b_sum, b_down = (x[differ] for x in (a, b, a_sum, a_down, b_sum, b_down))
    low, high = np.zeros(len(a), np.int64), np.full(len(a), most - 1, np.int64)
    for _ in range(int(most - 1).bit_length()):
        mid = (low + high + 1) >> 1
        same = (hashes.sums[a + mid] - a_sum) * a_down == (hashes.sums[b + mid] - b_sum) * b_down
        np.copyto(low, mid, where=same)
        np.copyto(high, mid - 1, where=~same)
    out[differ] = low
    return out


def suffix_sort(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, by group and then by their first n bytes, and for each in that order whether it equals the one before.

    A radix sort from the first byte on: a turn sorts those still in a run of equals, all runs at once, by as many of their next bytes as
    fit one number beside the run's own. Bytes alone decide.
    """
    order = np.argsort(groups, kind="stable")
    at, group = starts[order], groups[order]
    new = np.append(np.ones(min(1, len(order)), bool), group[1:] != group[:-1])
    words = np.ndarray(len(data) + 1, ">u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each place on
    done = 0
    while done < n:
        alone = new.copy()
        alone[:-1] &= new[1:]
        rows = np.flatnonzero(~alone)
        if not rows.size:
            break
        run = np.cumsum(new[rows])
        wide = min(n - done, (64 - int(run[-1]).bit_length()) // 8)
        value = run.astype(np.uint64) << np.uint64(8 * wide) | words[at[rows] + done].astype(np.uint64) >> np.uint64(64 - 8 * wide)
        by = np.argsort(value)
        value, moved = value[by], rows[by]
        order[rows], at[rows] = order[moved], at[moved]
        new[rows[1:]] |= value[1:] != value[:-1]
        done += wide
    return order, ~new


def _settle(n: int):
    """Sorts the windows of classes that come in the order of (_key, _chunk): (_key, _unit, _from, _to, _low, _window).

    _low is the smallest id that has any window of _from to _to. Of a chunk that is not its anchor's only one, windows come one by one, with their bytes.
    """

    def of(rows: pa.Table) -> pa.RecordBatch:
        data, offsets = _bytes(rows["_bytes"].combine_chunks())
        key, chunk, chunks = (np.asarray(rows[c].combine_chunks()) for c in ("_key", "_chunk", "_chunks"))
        anchor, ids = np.asarray(rows["_anchor"].combine_chunks(), dtype=np.int64), rows["_id"].combine_chunks()
        count = np.diff(offsets) - n + 1
        owner = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        block = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
        groups = block[owner] * 256 + anchor[owner] - nth
        order, same = suffix_sort(data, offsets[owner] + nth, groups, n)
        rank = np.asarray(pc.rank(ids, null_placement="at_start", tiebreaker="dense"), dtype=np.int64)
        low = np.minimum.reduceat(rank[owner[order]], np.flatnonzero(~same))[np.cumsum(~same) - 1]
        least = np.empty(len(order), np.int64)
        least[order] = low
        has = np.full(rank.max() + 1, 0)
        has[rank] = np.arange(len(rank))
        shown = (chunks > 1)[owner]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | shown[1:]]))
        last = np.append(first[1:], len(owner)) - 1
        at = offsets[owner[first]] + nth[first]
        seen = [data[s : s + n].tobytes() if x else None for s, x in zip(at.tolist(), shown[first].tolist(), strict=True)] if shown.any() else [None] * len(first)
        take = pa.array(owner[first])
        columns = [rows["_key"].combine_chunks().take(take), rows["_unit"].combine_chunks().take(take), pa.array(nth[first], pa.int32()), pa.array(nth[last], pa.int32()), ids.take(pa.array(has[least[first]])), pa.array(seen, pa.binary()), pa.array(anchor[owner[first]] - nth[first], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["_key", "_unit", "_from", "_to", "_low", "_window", "_anchor"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held, size = [*held, t], size + t["_bytes"].nbytes
            if size < SORTED:
                continue
            rows = pa.concat_tables(held)
            key, chunk = np.asarray(rows["_key"].combine_chunks()), np.asarray(rows["_chunk"].combine_chunks())
            cut = int(np.flatnonzero((key != key[-1]) | (chunk != chunk[-1])).max(initial=-1)) + 1
            if cut:
                yield of(rows.slice(0, cut))
            held, size = [rows.slice(cut)], rows.slice(cut)["_bytes"].nbytes
        rows = pa.concat_tables(held) if held else None
        if rows is not None and rows.num_rows:
            yield of(rows)

    return run


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes one after another as binary values of these sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the units of each text."""
    for batch in batches:
        data, offsets = _bytes(batch["_text"])
        lists, asked = batch["_asked"], batch["_asked"].flatten()
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
        start, size = (np.asarray(asked.field(c), dtype=np.int64) for c in ("start", "size"))
        start = start + offsets[owner]
        for at in range(0, len(asked), UNITS):
            part = asked.slice(at, UNITS)
            s, k = start[at : at + UNITS], size[at : at + UNITS]
            spots = np.arange(k.sum()) + np.repeat(s - np.cumsum(k) + k, k)
            yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("id", "key", "unit", "anchor", "chunk", "chunks")), _binaries(data[spots], k)], names=["_id", "_key", "_unit", "_anchor", "_chunk", "_chunks", "_bytes"])


def _apply(n: int):
    """Cuts the judged windows out of each text: (id, n_bytes, starts and ends of what goes, kept). Texts are worked on together, in pieces of bounded bytes."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_text"):
                data, offsets = _bytes(texts)
                lists, gone = piece["_gone"], piece["_gone"].flatten()
                owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
                at, unit, low, high = (np.asarray(gone.field(c), dtype=np.int64) for c in ("at", "unit", "low", "high"))
                s, size = (at >> 16 & 0x7FFFFFFF) + offsets[owner], (at >> 8 & 0xFF) + n - 1
                fits = s + size <= offsets[owner + 1]
                s, size, unit, low, high = s[fits], size[fits], unit[fits], low[fits], high[fits]
                same = (Hashes(data, _OTHER).of(s, s + size) ^ size.astype(np.uint64)).view(np.int64) == unit if len(s) else np.zeros(0, bool)
                steps = np.bincount((s + low)[same], minlength=len(data) + 1) - np.bincount((s + high + n)[same], minlength=len(data) + 1)
                covered = np.cumsum(steps[:-1]) > 0
                first, last = covered.copy(), covered.copy()
                first[1:] &= ~covered[:-1]
                last[:-1] &= ~covered[1:]
                full = np.flatnonzero(np.diff(offsets))  # runs do not go over from a text to the next
                first[offsets[full]] = covered[offsets[full]]
                last[offsets[full + 1] - 1] = covered[offsets[full + 1] - 1]
                start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
                of = np.searchsorted(offsets, start, side="right") - 1
                upto = np.concatenate([[0], np.cumsum(covered)])[offsets]
                runs = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
                spots = (pa.ListArray.from_arrays(pa.array(runs), pa.array(x - offsets[of])) for x in (start, end))
                yield pa.RecordBatch.from_arrays([piece["_id"], pa.array(np.diff(offsets)), *spots, _binaries(data[~covered], np.diff(offsets) - np.diff(upto))], names=["_id", "n_bytes", "_start", "_end", "kept"])

    return run


def _windows_gone(docs: DataFrame, path: str, n: int, gram: int, chunk: int) -> DataFrame:
    """(_id, _row, _gone): for each document that loses bytes the windows that go, by unit."""
    way = F.when(F.shiftright("_at", FLAG_AT) == REPEATS, F.xxhash64("_unit", "_at")).otherwise(F.col("_key"))
    kind = docs.schema["_id"].dataType.simpleString()
    found = _all_units(docs, n, gram).repartition(way).sortWithinPartitions("_key")
    live = materialize(found.mapInArrow(_repeating, f"_id {kind}, _key long, _unit long, _at long"), f"{path}/live")

    # of numbers alone, so that they are kept in hash tables and not sorted; a null id, which min leaves out, is the smallest
    lows = live.groupBy("_key", "_unit").agg(F.min("_id").alias("id"), F.min_by("_at", "_id").alias("at"), F.min(F.when(F.col("_id").isNull(), F.col("_at"))).alias("null_at"))
    low = F.struct(F.when(F.col("null_at").isNull(), F.col("id")).alias("_id"), F.coalesce("null_at", "at").alias("_at"))
    classes = materialize(lows.select("_key", "_unit", low.alias("low")), f"{path}/classes")
    several = materialize(classes.groupBy("_key").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1"), f"{path}/several")
    chunks = F.ceil(F.col("_k") / chunk).cast("int")
    at = F.col("low._at")
    asked = F.struct(
        F.col("low._id").alias("id"), F.col("_key").alias("key"), F.col("_unit").alias("unit"), at.bitwiseAND(255).cast("int").alias("anchor"),
        F.pmod(F.col("_unit"), chunks).cast("int").alias("chunk"), chunks.alias("chunks"), F.shiftright(at, 16).bitwiseAND(0x7FFFFFFF).alias("start"), (F.shiftright(at, 8).bitwiseAND(255) + n - 1).alias("size"),
    )
    row = F.shiftright(at, 47).cast("int").alias("_c_row")
    reps = classes.join(several, "_key").groupBy(F.col("low._id").alias("_c_id"), row).agg(F.collect_list(asked).alias("_asked"))
    texts = docs.join(reps, F.col("_id").eqNullSafe(F.col("_c_id")) & (F.col("_row") == F.col("_c_row"))).select("_text", "_asked")
    cut = texts.mapInArrow(_cut_units, f"_id {kind}, _key long, _unit long, _anchor int, _chunk int, _chunks int, _bytes binary")
    dealt = cut.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk")
    sorted_ = materialize(dealt.mapInArrow(_settle(n), f"_key long, _unit long, _from int, _to int, _low {kind}, _window binary, _anchor int"), f"{path}/sorted")

    parts = sorted_.filter("_window is not null")
    lowest = parts.groupBy("_key", "_anchor", "_window").agg(F.min(F.struct("_low")).alias("_least"))
    combined = parts.drop("_low").join(lowest, ["_key", "_anchor", "_window"]).select("_key", "_unit", "_from", "_to", F.col("_least._low").alias("_low"))
    alone = classes.join(several, "_key", "left_anti")
    alone = alone.select("_key", "_unit", F.lit(0).alias("_from"), (F.shiftright(at, 8).bitwiseAND(255) - 1).cast("int").alias("_to"), F.col("low._id").alias("_low"))
    settled = alone.unionByName(sorted_.filter("_window is null").select("_key", "_unit", "_from", "_to", "_low")).unionByName(combined)
    later = F.col("_id").isNotNull() & (F.col("_low").isNull() | (F.col("_low") < F.col("_id")))
    gone = live.join(settled, ["_key", "_unit"]).filter(later)
    gone = gone.groupBy("_id", F.shiftright("_at", 47).cast("int").alias("_row")).agg(F.collect_set(F.struct(F.col("_at").alias("at"), F.col("_unit").alias("unit"), F.col("_from").alias("low"), F.col("_to").alias("high"))).alias("_gone"))
    return gone


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 50, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """Per document: the id, n_bytes, spans (array of start and end of the maximal removed runs, in bytes), kept (the bytes left)."""
    if not 1 <= gram <= n <= 255:
        raise ValueError("gram of 1 to n bytes, n of at most 255")
    text = F.encode(text_of(text_col), "UTF-8") if docs.schema[text_col].dataType.simpleString() == "string" else F.coalesce(text_col, F.lit(b""))
    own = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    own = own.withColumn("_row", F.xxhash64("_text").bitwiseAND((1 << ROW_BITS) - 1).cast("int"))
    path, out = work_dir(docs.sparkSession), work_dir(docs.sparkSession)
    gone = materialize(_windows_gone(own, path, n, gram, chunk), out)
    drop(docs.sparkSession, path)
    gone = gone.select(F.col("_id").alias("_g_id"), F.col("_row").alias("_g_row"), "_gone")
    both = own.join(gone, F.col("_id").eqNullSafe(F.col("_g_id")) & (F.col("_row") == F.col("_g_row")), "left").select("_id", "_text", "_gone")
    kind = own.schema["_id"].dataType.simpleString()
    cut = both.mapInArrow(_apply(n), f"_id {kind}, n_bytes long, _start array<long>, _end array<long>, kept binary")
    spans = F.zip_with("_start", "_end", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return cut.select(F.col("_id").alias(id_col), "n_bytes", spans.alias("spans"), "kept")
