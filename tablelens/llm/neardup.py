"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct k-word shingles. Its sketch has M registers floor(1 - log_B(min)), the minima of
exponential hashes, truncated to 0..Q+1: exponentially spaced, mergeable by maximum, and as alike as the sets are.
Registers are banded to find candidates; a joint likelihood of equal, larger and smaller registers, given both set
sizes, estimates the similarity and drops hopeless ones; the rest is verified on the full sets.

Documents of equal sets form one class, and only classes are compared. In each band a class meets the band's smallest
class, its head. Where that leaves classes outside the head's component, these strays are compared with the head's members in
blocks of bounded size, which give only the links that join components: a group of thousands of near copies makes no more rows than
it has members, and no link between components is lost.

Edge cases: a null or empty text has no shingles, is linked with nothing and stays; fewer than k words make one shingle;
a pair of similarity 0.8 shares no band with probability 5e-8;
repeated rows with one id share a class, and all of them stay if that id is the component's smallest; other columns are
ignored by ``components`` and kept by ``clean``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, row_key, text_of, work_dir
from .textfeat import hashes, owners, slices, tokens

K = 5
BANDS, ROWS = 32, 4
M = BANDS * ROWS
#: Base and largest register: with this base equal registers are as likely as the similarity.
B, Q = 1.001, 65533
#: Similarity as a fraction: linked if DEN * intersection >= NUM * union.
NUM, DEN = 80, 100
#: Estimates this far below the threshold are dropped: five standard errors of M registers, so that a pair at the threshold is lost with
#: probability 2e-7, and a likelier one less.
SLACK = 0.18
#: A list of ids is broadcast up to this many, else joined by a shuffle.
IDS = 200_000

#: Members of a head that are compared in one task are at most twice this many; elements of a 0/1 matrix's row.
BLOCK, COLUMNS = 256, 8192

_U = np.uint64
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**63, M, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, M, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and where each text's begin and end."""
    flat, bounds = tokens(texts, None)
    h, n = hashes(flat), len(bounds) - 1
    size = np.diff(bounds)
    count = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    of = np.repeat(np.arange(n), count)
    start = bounds[:-1][of] + np.arange(len(of)) - np.concatenate([[0], np.cumsum(count)])[of]
    s = np.zeros(len(of), np.uint64)
    width = np.minimum(size, k)[of]
    for j in range(k):
        at = np.minimum(start + j, max(len(h) - 1, 0))
        s = np.where(j < width, s * _U(0x9E3779B97F4A7C15) + (h[at] if len(h) else s) + _U(1), s)
    s = _mix(s)
    order = np.lexsort((s, of))
    of, s = of[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (of[1:] != of[:-1]) | (s[1:] != s[:-1])
    of, s = of[new], s[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def registers(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (texts, M); those of an empty set are 0."""
    n = len(bounds) - 1
    out = np.zeros((n, M), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    starts = bounds[:-1][full]
    for j in range(M):
        v = (s ^ _XOR[j]) * _MUL[j]
        v ^= v >> _U(29)
        v *= _U(0xBF58476D1CE4E5B9)
        least = np.minimum.reduceat(v, starts)
        e = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64)
        out[full, j] = np.clip(np.floor(1 - np.log(e) / np.log(B)), 0, Q + 1)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(texts, BANDS): a hash of each band's place and registers."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_mix(np.arange(BANDS, dtype=np.uint64) + _U(1)), (len(regs), BANDS)).copy()
    for j in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + r[:, :, j] + _U(1))
    return key.astype(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 64) -> np.ndarray:
    """The most likely similarity of each pair of register rows, of sets of na and nb elements."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    for g in np.linspace(0, 1, steps + 1):
        j = g * most
        pu, pd = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        like = up * np.log(pu) + down * np.log(pd) + same * np.log(np.maximum(1 - pu - pd, 1e-12))
        better = like > best
        best, at = np.where(better, like, best), np.where(better, j, at)
    return at


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: _id, tkey (of its text), n (set size), node (128 bits of the set), regs, bands."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                s, bounds = shingle_sets(texts, k)
                n = np.diff(bounds)
                full = n > 0
                node = np.zeros((len(n), 2), np.uint64)
                if full.any():
                    for c, salt in enumerate((_U(0x1234567), _U(0x89ABCDEF1))):
                        node[full, c] = np.add.reduceat(_mix(s + salt), bounds[:-1][full])
                regs = registers(s, bounds)
                rows = lambda a: pa.array([x.tobytes() for x in a], pa.binary())
                keys = band_keys(regs)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("tkey"), pa.array(n), rows(node), rows(regs), bands], names=["_id", "tkey", "n", "node", "regs", "bands"])

    return docs.select(F.col(id_col).alias("_id"), row_key(text_of(text_col)).alias("tkey"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, tkey long, n long, node binary, regs binary, bands array<long>")


def _likely(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) whose estimated similarity may reach the threshold."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.least("na", "nb") * den >= F.greatest("na", "nb") * num))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
            j = estimate(a, b, *(np.asarray(batch.column(c), dtype=float) for c in ("na", "nb")))
            yield batch.select(["a", "b"]).filter(pa.array(j >= num / den - SLACK))

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a binary, b binary")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, k: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """(a, s): the sorted shingle hashes of each node in nodes.a, from the text of its class."""
    need = materialize(nodes.distinct().join(classes.select(F.col("node").alias("a"), "rep"), "a").select("a", F.col("rep._id").alias("_rid"), F.col("rep.tkey").alias("_rkey")), f"{path}-need")
    rows = docs.select(F.col(id_col).alias("_rid"), row_key(text_of(text_col)).alias("_rkey"), F.col(text_col).alias("_t"))
    found = rows.join(F.broadcast(need) if need.count() <= IDS else need, rows["_rid"].eqNullSafe(need["_rid"]) & (rows["_rkey"] == need["_rkey"])).select("a", "_t")

    def sets(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                s, bounds = shingle_sets(texts, k)
                yield pa.RecordBatch.from_arrays([piece.column("a"), pa.array([s[bounds[i] : bounds[i + 1]].tobytes() for i in range(piece.num_rows)], pa.binary())], names=["a", "s"])

    # repeated rows of one id and text would give a set twice
    return materialize(found.mapInArrow(sets, "a binary, s binary").dropDuplicates(["a"]), f"{path}-sets", "lz4")


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) that are linked: by their whole shingle sets."""
    both = pairs.join(texts.withColumnRenamed("s", "sa"), "a").join(texts.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                inter = int((a[at] == b).sum())
                ok.append(den * inter >= num * (len(a) + len(b) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over the elements that both sides have."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    both = np.intersect1d(flat[0], flat[1])
    out = np.zeros((len(left), len(right)), np.float32)
    place = []
    for sets, f in zip((left, right), flat, strict=True):
        at = np.minimum(np.searchsorted(both, f), max(len(both) - 1, 0))
        hit = both[at] == f if len(both) else np.zeros(len(f), bool)
        place.append((np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], at[hit]))
    for start in range(0, len(both), COLUMNS):
        m = []
        for sets, (row, col) in zip((left, right), place, strict=True):
            one = np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32)
            now = (col >= start) & (col < start + COLUMNS)
            one[row[now], col[now] - start] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def _block_links(num: int, den: int):
    """Of a block of one head's strays and a block of its members: links between components, no more than join them."""

    def run(key, table):
        nodes, roots = table.column("node").to_pylist(), table.column("root").to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("s")]
        rows, cols = (np.flatnonzero(np.asarray(table.column(c), dtype=bool)) for c in ("as_stray", "as_member"))
        n = np.array([len(x) for x in sets])
        inter = common_counts([sets[r] for r in rows], [sets[c] for c in cols])
        linked = den * inter >= num * (n[rows][:, None] + n[cols][None, :] - inter)
        up = {r: r for r in roots}

        def find(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        out = []
        for r, c in zip(*np.nonzero(linked), strict=True):
            x, y = find(roots[rows[r]]), find(roots[cols[c]])
            if x != y:
                up[x] = y
                out.append((nodes[rows[r]], nodes[cols[c]]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return run


def _links_of_strays(known: DataFrame, docs: DataFrame, classes: DataFrame, k: int, id_col: str, text_col: str, num: int, den: int, path: str) -> DataFrame:
    """Links that the heads did not show. Classes that share a band share its head, and two members that are both in the head's component
    need no link, so the strays of each head, those outside its component, are compared with its members: in blocks of BLOCK, a
    block of strays and one of members a group of its own."""
    members = known.groupBy("head", "node").agg(F.first("root").alias("root"), F.first("hroot").alias("hroot")).withColumn("stray", F.col("root") != F.col("hroot"))
    heads = members.groupBy("head").agg(F.count(F.lit(1)).alias("k"), F.count_if("stray").alias("n")).filter("n > 0 and k > 1")
    heads = heads.select("head", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n") / BLOCK).cast("int").alias("stray_blocks"))
    members = materialize(members.join(heads, "head").select("head", "node", "root", "stray", "blocks", "stray_blocks"), f"{path}-members")
    if not members.take(1):
        return known.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    sets = _sets(members.select(F.col("node").alias("a")), docs, classes, k, id_col, text_col, path)
    held = members.join(sets.withColumnRenamed("a", "node"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    # as a member it meets all blocks of strays, as a stray all blocks of members; where both is the same group it goes once
    held = held.withColumns({"own_i": own("stray_blocks"), "own_j": own("blocks")})
    target = lambda i, j, stray, member: F.struct(i.alias("i"), j.alias("j"), stray.alias("as_stray"), member.alias("as_member"))
    met = F.transform(F.sequence(F.lit(0), F.col("stray_blocks") - 1), lambda i: target(i, F.col("own_j"), F.col("stray") & (i == F.col("own_i")), F.lit(True)))
    other = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("stray") & (j != F.col("own_j")))
    meets = F.transform(other, lambda j: target(F.col("own_i"), j, F.lit(True), F.lit(False)))
    rows = held.select("head", F.explode(F.concat(met, meets)).alias("to"), "node", "root", "s").select("head", "to.i", "to.j", "to.as_stray", "to.as_member", "node", "root", "s")
    return rows.groupBy("head", "i", "j").applyInArrow(_block_links(num, den), "a binary, b binary")


def connected(edges: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component with an edge. Alternates large and small stars; each round is joins and minima on disk in the shared folder."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{path}-0")
    before = None
    for i in range(1, most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        e = materialize(small, f"{path}-{i}")
        now = e.agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def components(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """Per document: the id, n_shingles, component_id, kept, text_key."""
    return _components(docs, work_dir(docs.sparkSession), k, id_col, text_col, num, den)


def _components(docs: DataFrame, path: str, k: int, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    sig = materialize(sketches(docs, k, id_col, text_col), f"{path}/sig")
    classes = materialize(sig.filter("n > 0").groupBy("node", "n").agg(F.min(F.struct("_id", "tkey")).alias("rep"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), f"{path}/classes")
    rows = classes.select("node", F.explode("bands").alias("band"))
    heads = rows.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = materialize(rows.join(heads, "band"), f"{path}/shared")
    first = materialize(_likely(shared.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), classes, num, den), f"{path}/first")
    first_nodes = first.select("a").union(first.select(F.col("b").alias("a")))
    links = materialize(_verified(first, _sets(first_nodes, docs, classes, k, id_col, text_col, f"{path}/v1"), num, den), f"{path}/links1")
    # what is still apart from its band's head meets the head's other members
    root = connected(links, f"{path}/c1")
    known = shared.filter("k > 2").join(root, "node", "left").select("node", "head", F.coalesce("root", "node").alias("root"))
    known = known.join(root.select(F.col("node").alias("head"), F.col("root").alias("hroot")), "head", "left").select("node", "head", "root", F.coalesce("hroot", "head").alias("hroot"))
    found = materialize(_links_of_strays(known, docs, classes, k, id_col, text_col, num, den, f"{path}/v2"), f"{path}/links2")
    if found.take(1):
        root = connected(links.unionByName(found), f"{path}/c2")
    own = classes.select("node", F.col("rep._id").alias("rep")).join(root, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    ids = root.select("node", "root").join(classes.select("node", F.col("rep._id").alias("rep")), "node").groupBy("root").agg(F.min("rep").alias("low"))
    named = own.join(ids, "root", "left").select("node", F.coalesce("low", "rep").alias("component_id"))
    out = sig.join(named, "node", "left")
    cid = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("_id").eqNullSafe(cid).alias("kept"), F.col("tkey").alias("text_key"))


def clean(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents but for all of each component that are not its smallest id, with the columns of docs."""
    path, out = work_dir(docs.sparkSession), work_dir(docs.sparkSession)
    gone_id, gone_key = fresh(docs, "_gone", "_gkey")
    gone = materialize(_components(docs, path, k, id_col, text_col, num, den).filter(~F.col("kept")).select(F.col(id_col).alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), out)
    drop(docs.sparkSession, path)
    return docs.join(F.broadcast(gone) if gone.count() <= IDS else gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (row_key(text_of(text_col)) == F.col(gone_key)), "left_anti")
