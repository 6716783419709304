"""Suffix-array dedup, fill-in-middle and vector codes against brute force, on awkward tables."""

import hashlib
import importlib.util
import math
import random
import re
import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablelens.llm import fim, suffixdedup, vectorcodes

_spec = importlib.util.spec_from_file_location("llm_brute_more", Path(__file__).with_name("test_operators.py"))
brute = importlib.util.module_from_spec(_spec)
sys.modules["llm_brute_more"] = brute
_spec.loader.exec_module(brute)
rng = random.Random(12)


def brute_repeats(rows, n=50):
    """(id, n_bytes, spans, kept) of (id, text), by a dictionary of all windows."""
    order, low = lambda i: (i is not None, i or 0), {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            if w not in low or order(i) < order(low[w]):
                low[w] = i
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for s in range(len(b) - n + 1):
            if order(low[b[s : s + n]]) < order(i):
                gone[s : s + n] = b"\1" * n
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return Counter(out)


def repeats_of(docs, **options):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixdedup.repeats(docs, **options).collect())


def corpus():
    prose = lambda n: brute.prose(n, 3000)
    passage = prose(30)
    texts = [None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 500, "ab" * 200, "é" * 40, "é" * 25, "\x00" * 60, "z" + "\x00" * 60]
    texts += [f"{prose(rng.randrange(12))} {passage[rng.randrange(60) :][: rng.randrange(48, 150)]} {prose(rng.randrange(12))}" for _ in range(60)]
    whole = prose(80)
    texts += [whole, whole, brute.edited(whole, 3), whole[:200] + "!" + whole[200:], whole[:49], whole[7:57], whole[3:52], prose(300) + passage + prose(400)]
    return texts


def test_repeats(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3], ids[12] = None, None
    docs = brute.docs_of(spark, texts, ids).repartition(5)
    again = docs.unionByName(docs.filter("doc_id % 9 = 4")).unionByName(brute.docs_of(spark, [texts[-1][20:400]], [ids[-1]]))
    for table in (docs, again):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        assert repeats_of(table) == brute_repeats(rows)
    # an anchor's classes in several chunks
    assert repeats_of(docs, chunk=2) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert repeats_of(docs, n=20, gram=7) == brute_repeats(rows, 20)
    assert suffixdedup.repeats(docs.limit(0)).count() == 0


def test_repeats_of_any_ids_and_names(spark):
    texts = corpus()[10:40]
    ids = [f"k{i:03d}" for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "name string, body string, _id int, _gone int")
    got = suffixdedup.repeats(docs, "name", "body")
    assert got.columns == ["name", "n_bytes", "spans", "kept"]
    order = {k: i for i, k in enumerate(ids)}
    want = brute_repeats([(order[i], t) for i, t in rows])
    assert Counter((order[r["name"]], r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()) == want


def test_units_cover_windows():
    """Each window has one unit; equal windows have equal anchors at equal places."""
    texts = [rng.randbytes(k) if k % 2 else bytes(rng.choice(b"ab") for _ in range(k)) for k in (0, 49, 50, 51, 400, 3000)] + [b"q" * 300]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for block in (90, 10**6):
        suffixdedup.BLOCK, old = block, suffixdedup.BLOCK
        try:
            text, start, count, anchor, key, _ = suffixdedup.units(data, offsets, 50)
        finally:
            suffixdedup.BLOCK = old
        seen, spots = {}, Counter()
        for t, s, c, a, k in zip(text, start, count, anchor, key, strict=True):
            for j in range(c):
                spots[int(t), int(s + j)] += 1
                assert seen.setdefault(texts[t][s + j : s + j + 50], (a - j, k)) == (a - j, k)
        assert spots == Counter((t, s) for t, x in enumerate(texts) for s in range(len(x) - 49))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=120), st.integers(1, 9), st.booleans())
def test_suffix_sort(data, n, collide):
    data = np.frombuffer(bytes(x % 3 for x in data), np.uint8)
    starts = np.arange(max(0, len(data) - n + 1))
    groups = starts % 3
    old = suffixdedup.extension
    if collide:  # hashes that say that all is alike
        suffixdedup.extension = lambda hashes, a, b, most: np.full(len(a), most)
    try:
        order, same = suffixdedup.suffix_sort(data, starts, groups, n)
    finally:
        suffixdedup.extension = old
    got = [(int(groups[i]), data[starts[i] : starts[i] + n].tobytes()) for i in order]
    assert sorted(order.tolist()) == starts.tolist() and got == sorted(got)
    assert same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]


def test_suffix_sort_by_bytes_alone(monkeypatch):
    """No hashes, and turns only for those that are alike so far: one number of each of distinct windows, not a binary search per turn of a mergesort."""
    monkeypatch.setattr(suffixdedup, "Hashes", None)
    data = np.random.default_rng(5).integers(0, 256, 20_000).astype(np.uint8)
    data[15_000:] = data[5_000:10_000]
    starts, groups, sorted_ = np.arange(len(data) - 49), np.zeros(len(data) - 49, np.int64), []
    real = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sorted_.append(len(x)) or real(x, *a, **k))
    order, same = suffixdedup.suffix_sort(data, starts, groups, 50)
    got = [data[i : i + 50].tobytes() for i in order]
    assert got == sorted(got) and same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]
    assert same.sum() == 4951 and sorted_[:2] == [len(starts)] * 2 and max(sorted_[2:]) <= 2 * 5_010


def test_classes_are_not_sorted(spark, monkeypatch):
    plans, real = {}, suffixdedup.materialize

    def noted(df, path, *args, **kw):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, path, *args, **kw)

    monkeypatch.setattr(suffixdedup, "materialize", noted)
    texts = corpus()[10:30]
    docs = brute.docs_of(spark, texts, [None, None, *range(len(texts) - 2)])
    assert repeats_of(docs) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert "SortAggregate" not in plans["classes"] and "HashAggregate" in plans["classes"]


def test_extension():
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    a, b = (np.array([rng.randrange(2900) for _ in range(500)]) for _ in range(2))
    got = suffixdedup.extension(suffixdedup.Hashes(data), a, b, 50)
    for x, y, k in zip(a, b, got, strict=True):
        same = [data[x + j] == data[y + j] for j in range(50)] + [False]
        assert k == same.index(False)


def brute_fim(text, key):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(units), "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out, text


def test_fim(spark):
    texts = [None, "", "a", "<P>", "x <S> y", "<M>", "<", "<P", "P>", "<<S", "S>>", "\U0001f600\U0001f600 ab\n\r\x00c", "straße Ärger", "word " * 3000, "z" * 5000] + [brute.prose(rng.randrange(30)) + rng.choice(["<", "<S", "<P", "M>", ""]) for _ in range(200)]
    ids = [None if i == 7 else i * 37 for i in range(len(texts))]
    docs = brute.docs_of(spark, texts, ids).repartition(3)
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0"))
    got = fim.transform(docs).withColumn("back", fim.restore("output", "form"))
    rows = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got.collect())
    assert rows == Counter((r.doc_id, *brute_fim(r.text, "" if r.doc_id is None else r.doc_id)) for r in docs.collect())
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "one two three", 1)], "k string, t string, n int")
    assert fim.transform(named, "k", "t").columns == ["k", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_fim_memory_is_constant():
    def peak(text):
        tracemalloc.start()
        n = fim.count_units(text)
        fim.cut_places(text, n // 3, n - 1)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak("ab, " * 500_000) < peak("ab, " * 50) + 10_000


@given(st.text(alphabet="ab<>PSM \n", max_size=30), st.integers(0, 40), st.integers(0, 40))
def test_fim_cuts(text, a, b):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    assert fim.cut_places(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """{(id, vector): code, error} and the codebooks of (id, vector), in Python's own integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[part(v, p) for _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]] for p in range(parts)]
    near = lambda v, p: min((far(part(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for _, v in kept] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v), f in zip(kept, found[p], strict=True) if f == e]
                if own:
                    books[p] = [*books[p][:e], [sum(x) // len(own) for x in zip(*own, strict=True)], *books[p][e + 1 :]]
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts))) for i, v in kept]
    return coded, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_vector_codes(spark):
    vectors = [[rng.choice([-0.25, 0.125, 0.3, rng.gauss(0, 1)]) for _ in range(32)] for _ in range(150)]
    vectors += [vectors[3], vectors[3], None, [None, *vectors[0][1:]], [math.nan, *vectors[0][1:]], [*vectors[0][1:], math.inf], [*vectors[0][1:], -math.inf], [0.5] * 16, [], [0.1] * 7]
    rows = [(None if i in (9, 11) else i // 2 if i > 140 else i * 7 % 401, v, None if i % 5 == 0 else i % 3, 1, 2) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, _id int, code int").repartition(4)
    codes = vectorcodes.fit(table)
    found = vectorcodes.label_errors(codes.rows()).collect()
    same = [(i, v) for i, v, *_ in rows if v is None or len(v) == 32]
    want, digest = brute_codes(same)
    assert Counter((r.vec_id, r.code.hex(), r.error) for r in found) == Counter(want) and codes.digest() == digest
    for r in found:
        assert r.label_error == sum(x.error for x in found if x.label == r.label)
    assert sum(r.label is None for r in found) > 5
    back = vectorcodes.restore(found[0].code, codes.books)
    assert back.shape == (32,)
    assert vectorcodes.fit(table.repartition(1)).digest() == digest


def test_vector_codes_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)], [(1, [0.5] * 10, 2)]):
        codes = vectorcodes.fit(spark.createDataFrame(rows, kind))
        assert codes.rows().count() == 0 and vectorcodes.label_errors(codes.rows()).count() == 0 and codes.digest() == hashlib.sha256(b"").hexdigest()
    three = [(i, [float(i), -1e30, *[0.0] * 14], None) for i in range(3)]
    codes = vectorcodes.fit(spark.createDataFrame(three, kind))
    assert codes.books.shape == (16, 3, 1) and {r.code[0] for r in codes.rows().collect()} == {0, 1, 2}
    assert codes.books[1].tolist() == [[-(1 << 26)]] * 3


def test_vector_blocks_hold_bounded_rows():
    ids, labels = pa.array(range(10_000)), pa.array([None] * 10_000, pa.int32())
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, 160_001, 16), pa.int32()), pa.array(np.zeros(160_000, np.float32)))
    blocks = list(vectorcodes._to_blocks(16, 16, 256)(iter([pa.RecordBatch.from_arrays([ids, labels, vec], names=["_id", "_label", "_vec"])])))
    assert [len(b["ids"][0]) for b in blocks] == [4096, 4096, 1808]


@pytest.mark.parametrize("dims", [1, 4])
def test_assign(dims):
    draw = np.random.default_rng(3)
    block, books = draw.integers(-9, 9, (2, dims, 50)).astype(np.int32), draw.integers(-9, 9, (2, 7, dims))
    index, error = vectorcodes.assign(block, books)
    far = ((block.transpose(0, 2, 1)[:, :, None, :].astype(int) - books[:, None]) ** 2).sum(axis=3)
    assert (index == far.argmin(axis=2)).all() and (error == far.min(axis=2)).all()


def test_repeats_work_grows_with_matches_not_with_pairs(spark):
    """A passage that all texts share is one class of units and a few windows a text, however many texts."""
    passage = brute.prose(40, 5000)
    texts = [f"{brute.prose(8, 90000)} {passage} {brute.prose(8, 90000)}" for _ in range(400)]
    rows = list(enumerate(texts))
    got = suffixdedup.repeats(brute.docs_of(spark, texts)).select("doc_id", F.size("spans").alias("k"), F.octet_length("kept").alias("left")).collect()
    want = {i: (len(s), len(k)) for i, _, s, k in brute_repeats(rows)}
    assert {r.doc_id: (r.k, r.left) for r in got} == want and sum(k for k, _ in want.values()) == 399
