"""The operators against brute force on small and awkward tables."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import decontaminate, licenses, linededup, media, mixing, neardup, pii, quality, toxicity, warc
from tablelens.llm.common import work_dir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, _id string, k int"
rng = random.Random(5)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(low(text))


def prose(n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t), "x", "y", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ITEMS = ["The quick brown fox jumps over the lazy dog near the river bank", "tiny item here", "", None, "Größe ÜBER alles Kelvin K zehn elf zwölf drei vier fünf sechs", "tiny item here"]
AWKWARD = [
    None,
    "",
    "   \n\t ",
    "!!! ... ***",
    "the QUICK brown fox jumps over the lazy dog near the river",
    "a tiny item here and the quick brown fox jumps over the lazy dog near",
    "größe über alles kelvin k zehn elf zwölf drei vier fünf sechs",
    "größe ÜBER alles kelvin k zehn elf zwölf drei vier fünf sechs 7",
    "tiny ITEM here",
    "tiny ITEM here",
    "x " * 30000 + "tiny item here",
    "\x00\x01 nul \U0001f600 emoji tiny item here",
]


def brute_contamination(text, items, n=10):
    w, hit, got = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        for g in {tuple(iw[i : i + n]) for i in range(max(1, len(iw) - n + 1))} if iw else ():
            for i in range(len(w) - len(g) + 1):
                if w[i] == g[0] and tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    got.add(str(item))
    return len(w), len(hit), sorted(got)


def test_decontaminate(spark):
    items = list(enumerate(ITEMS))
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = AWKWARD + [prose(20) + " " + ITEMS[0] + " " + prose(5)]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["tiny item here"], [8]))
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    want = Counter((i, n, h, tuple(g), h > 0) for i, t in [*enumerate(texts), (8, "tiny item here")] for n, h, g in [brute_contamination(t, items)])
    assert got == want
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, h, _, _ in want.elements() if not h)
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, remove="spans").collect()}
    assert len(cut) == len(texts) and cut[0] is None and all(not brute_contamination(t, [items[0]])[1] for t in cut.values()) and cut[3] == texts[3]
    assert words(cut[5]) == ["a", "and"]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert not decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count()


def brute_licenses(text):
    w = words(text)
    found = [(i, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(found), min(found, default=(None,))[0], max(found, default=(None,))[0], ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    texts = [*AWKWARD[:10], "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE cc by cc-by", "apache license", "the mit licenses", "x gnu general public license y gnu general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and added words associated documentation files (the software), to deal in the software", "mit license " * 300 + "end"]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t), i
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[14].labels == "mit" and got[14].score > 0.6 and len(got[14].spans) == 1
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs.unionByName(docs.filter("doc_id = 10"))).count() == len(texts) + 1


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_pii(text):
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ]
    for k, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m[0])]
    return [x for _, _, x in sorted(out)]


def test_pii(spark):
    texts = [
        *AWKWARD,
        "ok.a@b.co, x@y@z.com a@b.c.d@e.f @no x@b..c %d@e-.f a@b.c%d@e.f \U0001f600 q@w.ee",
        "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 1.2.3 999.1.2.3.4 1..2.3.4.5",
        "4111 1111 1111 1111, 4111-1111-1111-1112 0 00000000000000 4111  1111 1111 1111",
        "+1 (555) 555-0199 +12 3 ++1-202-555-0110- + 1 +1234567890123456789",
        "a" * 20000 + "@b." + "1" * 5000 + " " + "c." * 3000,
        'password = "d72a491f71c7584344" token: abcdefgh1 and key=short 0123456789abcdef0123456789abcdef 555-12-3456',
        "5500005555555559, " * 200,
    ]
    texts += ["".join(rng.choice("ab1@.+-( )0129 ") for _ in range(400)) for _ in range(150)]
    docs = docs_of(spark, texts)
    model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.spans(docs, model).select("doc_id", pii.written(F.col("base")).alias("base"), pii.written(F.col("spans")).alias("spans")).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i].base == ",".join(want), i
        assert set(want) <= set(filter(None, got[i].spans.split(","))), i
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[0] is None and clean[4] == texts[4] and "[CARD], " * 200 == clean[18] and "[EMAIL]" in clean[12]
    assert pii.spans(docs.limit(0), model).count() == 0
    assert pii.fit(docs.limit(0)).cuts == {"string": float("inf"), "number": float("inf")}
    with pytest.raises(ValueError):
        pii.spans(docs.withColumn("Base", F.lit(1)), model, keep=["Base"])


def pii_features(kind, match, before):
    m = re.search(r"[A-Za-z0-9_/+-]+\Z", match)[0] if kind == "secret" else match
    share = lambda cls: len(re.findall(cls, m)) / len(m)
    runs = re.findall("[0-9]+", m)
    sign = re.search(r"([\x22\x27]?)[A-Za-z0-9_/+-]+\Z", match)[1] if kind == "secret" else before[-1:]
    contact = re.search("tel|phone|call|fax|ssn|iban|account|contact|card", before.lower())
    tail = re.search(r"[0-9]+\Z", m)
    return [
        len(m), share("[0-9]"), share("[A-Z]"), share("[aeiouAEIOU]"), share("[0-9a-fA-F]"), share("[^0-9A-Za-z]"), len(set(m)) / len(m),
        len(re.split("[^0-9]+", m)), len(runs[0]) if runs else 0, len(tail[0]) if tail else 0, len(re.findall("[()]", m)), sign in ('"', "'") and sign != "", bool(contact), kind == "number",
    ]


def brute_spans(text, model):
    """All spans, by comparing each with each."""
    base = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in brute_pii(text)]
    out = []
    for kind in pii.ADDED:
        for m in re.finditer(pii.PATTERNS[kind], text):
            x = np.array([pii_features(kind, m[0], text[max(0, m.start() - pii.CONTEXT) : m.start()])], dtype=float)
            if model.trees.score(x)[0] >= model.cuts["number" if kind == "number" else "string"] and not any(s < m.end() and m.start() < e for s, _, e in base):
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    within = lambda a, b: b[0] <= a[0] and a[2] <= b[2] and (b[0], -b[2], b[1]) < (a[0], -a[2], a[1])
    return sorted([*base, *(x for x in out if not any(within(x, y) for y in out))])


def test_pii_finds_what_its_labels_did_not_say(spark):
    own = random.Random(8)
    hexes = lambda: "".join(own.choices("0123456789abcdef", k=40))
    phone = lambda: f"({own.randrange(100, 999)}) 555-{own.randrange(1000, 9999)}"
    say = lambda n: " ".join(own.choices(["message", "understanding", "of", "the", "wonderful", "connection", "a", "letters", "and_so_on", "it"], k=n))
    date = lambda: f"{own.randrange(1990, 2030)}-{own.randrange(10, 13)}-{own.randrange(10, 29)}"
    learn = [f'{say(9)} token = "{hexes()}" {say(3)} {date()} {say(4)}' if i % 3 == 0 else f"{say(6)} +1 {phone()} {say(9)}" if i % 3 == 1 else f"{say(20)} {date()}" for i in range(400)]
    model = pii.fit(docs_of(spark, learn))
    assert all(0 < c <= 1 for c in model.cuts.values())
    # a third each: keys in no assignment, phones without plus, and what only looks like either
    fresh_ = [f"{say(5)} {hexes()} {say(5)}" if i % 3 == 0 else f"{say(5)} {phone()} {say(2)}" if i % 3 == 1 else f"{say(4)} password: understanding {date()} {say(3)}" for i in range(300)]
    fresh_ += [f'mail a@b.co token = "{hexes()}" {"1" * 30} A1-{hexes()}/x {phone()} 1.2.3.4', "\U0001f600 é " + hexes() + " ü " + phone()]
    docs = docs_of(spark, fresh_)
    got = {r.doc_id: [(s["start"], s["rank"], s["end"]) for s in r.spans] for r in pii.spans(docs, model).collect()}
    kinds = lambda i: {pii.KINDS[k] for _, k, _ in got[i]}
    assert sum(bool(kinds(i) & {"hex", "token"}) for i in range(0, 300, 3)) >= 95
    assert sum("number" in kinds(i) for i in range(1, 300, 3)) >= 95
    assert sum(bool(got[i]) for i in range(2, 300, 3)) <= 5
    for i, t in enumerate(fresh_):
        assert got[i] == brute_spans(t, model), i
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    for i, t in enumerate(fresh_):
        out, at = "", 0
        for s, k, e in got[i]:
            out, at = (out + t[at:s] + f"[{pii.KINDS[k].upper()}]" if s >= at else out), max(at, e)
        assert clean[i] == out + t[at:], i


def test_pii_takes_many_spans_in_one_text(spark):
    """A hundred thousand addresses and keys in one text, in seconds."""
    key = "0123456789abcdef0123456789abcdef"
    text = "".join(f"a{i}@b.co {key} " for i in range(50_000))
    docs = docs_of(spark, [text])
    tree = pii.Boosted(0.0, 1.0, ())
    model = pii.PiiModel(tree, {"string": 0.5, "number": float("inf")})
    began = time.monotonic()
    row = pii.spans(docs, model).select(F.size("base").alias("n"), F.size("spans").alias("m"), F.get("spans", F.lit(99_999))["end"].alias("last")).first()
    assert (row.n, row.m, row.last) == (50_000, 100_000, len(text) - 1)
    assert len(pii.redact(docs, model).first().text) == 50_000 * len("[EMAIL] [HEX] ")
    assert time.monotonic() - began < 120


def test_mix(spark):
    texts = [prose(rng.randrange(1, 60)) for _ in range(300)] + [None, "", " \n ", "one", " lead trail \x0b"]
    docs = docs_of(spark, texts)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    size = {i: len(TOKEN.findall(t or "")) for i, t in enumerate(texts)}
    by = {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(size.values())
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    caps = {s: 3 * sum(r["size"] for r in by[s]) for s in order}
    while True:
        rest = total - sum(caps[s] for s in full)
        target = {s: caps[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        new = {s for s in order if s not in full and target[s] > caps[s]}
        if not new:
            break
        full |= new
    for s, own in by.items():
        assert own[0].source_size == sum(r["size"] for r in own)
        assert math.isclose(own[0].target, target[s], rel_tol=1e-9)
        assert sum(r.taken for r in own) == round(target[s])
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert sum(len(TOKEN.findall(r.text)) for r in drawn.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs_of(spark, [None, ""])).collect()] == [0, 0]


def shingles(text, k):
    w = TOKEN.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k):
    s = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(x), find(i)) for i, x in enumerate(s)]


def edited(text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [4, 5])
def test_neardup(spark, k):
    seed = prose(120, 5000)
    texts = [*AWKWARD, "one two", "One TWO", "one two three"]
    texts += [edited(seed, rng.randrange(0, 4)) for _ in range(60)]
    chain = [prose(100, 5000)]
    for _ in range(20):
        chain.append(edited(chain[-1], 2))
    texts += chain + [prose(80, 5000) for _ in range(40)]
    rng.shuffle(texts)
    docs = docs_of(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.components(docs, k).collect()}
    want = brute_components(texts, k)
    assert got == {i: (n, c, c == i) for i, (n, c) in enumerate(want)}
    left = neardup.clean(docs, k)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, (_, c) in enumerate(want) if c == i}


def test_neardup_in_small_blocks(spark, monkeypatch):
    """Heads whose strays and members take several blocks lose no link."""
    monkeypatch.setattr(neardup, "BLOCK", 2)
    own = random.Random(31)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(70):
        t = list(base)
        for _ in range(own.randrange(0, 9)):
            t[own.randrange(len(t))] = f"x{own.randrange(40)}"
        texts.append(" ".join(t))
    got = {r.doc_id: r.component_id for r in neardup.components(docs_of(spark, texts), k=2).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts, 2))} and len(set(got.values())) > 1


def test_neardup_edges(spark):
    assert neardup.components(docs_of(spark, ["a"]).limit(0)).count() == 0
    same = docs_of(spark, ["a b c d e f"] * 3, [2, 2, 9])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in neardup.components(same).collect()) == [(2, 2, True), (2, 2, True), (9, 2, False)]


def test_sketch_estimates_similarity():
    gen = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        pool = gen.integers(0, 2**63, 4000, dtype=np.uint64)
        both = int(share * 2000)
        a, b = pool[:2000], np.concatenate([pool[:both], pool[2000 : 4000 - both]])
        r = [neardup.registers(np.sort(x), np.array([0, len(x)])) for x in (a, b)]
        j = both / (4000 - both)
        assert abs(neardup.estimate(r[0], r[1], np.array([2000.0]), np.array([2000.0]))[0] - j) < 0.15
        merged = neardup.registers(np.unique(np.concatenate([a, b])), np.array([0, len(np.union1d(a, b))]))
        assert (merged == np.maximum(*r)).all()


def brute_lines(texts, least=1):
    seen, gone = [], {}
    for i, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            w = set(words(line))
            if len(w) < least:
                continue
            if any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                gone.setdefault(i, []).append(p)
            seen.append(w)
    return gone


def test_line_dedup(spark):
    base = [prose(rng.randrange(5, 40), 3000) for _ in range(30)]
    texts = [*AWKWARD[:10]]
    for _ in range(60):
        lines = [prose(rng.randrange(1, 30), 3000) for _ in range(rng.randrange(0, 4))]
        for _ in range(rng.randrange(0, 3)):
            lines.append(edited(rng.choice(base), rng.randrange(0, 4)))
        lines += ["", "short line"] if rng.random() < 0.3 else []
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts.append("\n".join(["the same line of seven words here"] * 50))
    docs = docs_of(spark, texts)
    want = brute_lines(texts)
    got = {r.doc_id: r for r in linededup.line_marks(docs).collect()}
    assert {i: r.removed for i, r in got.items() if r.removed} == want
    assert all(r.n_lines == len((texts[i] or "").split("\n")) and r.n_removed == len(r.removed) for i, r in got.items())
    left = linededup.clean(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want.get(r.doc_id, [])))
    assert linededup.line_marks(docs.limit(0)).count() == 0


def test_line_dedup_finds_all_similar_lines(spark):
    """Words from a small pool: many lines near the threshold, all of them frequent words."""
    texts = [" ".join(f"v{x}" for x in rng.sample(range(14), rng.randrange(5, 12))) for _ in range(250)]
    docs = docs_of(spark, texts)
    want = brute_lines(texts)
    for slots in (1, 16):
        assert {r.doc_id: r.removed for r in linededup.line_marks(docs, slots=slots).collect() if r.removed} == want


def test_line_dedup_of_common_grams(spark, monkeypatch):
    """Groups of variants of a few lines, larger than a line meets: all turns and the last step are needed."""
    own = random.Random(5)
    bases = [[f"b{k}w{x}" for x in range(n)] for k, n in enumerate((9, 12, 17, 24))]
    texts = []
    for _ in range(220):
        b = list(own.choice(bases))
        for _ in range(own.randrange(0, 1 + len(b) // 3)):
            b[own.randrange(len(b))] = f"x{own.randrange(40)}" if own.random() < 0.8 else f"y{own.randrange(9999)}"
        texts.append(" ".join(b))
    want = brute_lines(texts)
    docs = docs_of(spark, texts)
    monkeypatch.setattr(linededup, "GROUP", 5)
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs).collect() if r.removed} == want
    monkeypatch.setattr(linededup, "GROUP", 2)
    monkeypatch.setattr(linededup, "MOST", 10)
    monkeypatch.setattr(linededup, "MEMBERS", 0)
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs).collect() if r.removed} == want


def test_line_dedup_of_repeated_ids(spark):
    """Versions of a document: what goes at a position goes in all; nothing goes for a version of itself."""
    line = "one two three four five six seven eight nine"
    rows = [(1, f"{line}\nfirst"), (1, f"{line} ten\nother"), (1, f"{line}\nfirst"), (2, f"new\n{line} ten")]
    rows += [(None, "one two three four"), (None, "one two three four five"), (3, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, tuple(r.removed)) for r in linededup.line_marks(docs).collect()}
    assert got == {(1, ()), (2, (1,)), (None, ()), (3, (0,))}


def test_pipeline_dedups_short_lines(spark):
    """Lines of 1 to 6 distinct words from a small pool: equal sets, and four words within five."""
    own = random.Random(23)
    line = lambda: " ".join(own.choices([f"s{x}" for x in range(9)], k=own.randrange(1, 8)))
    texts = ["\n".join(own.choice([line(), line(), line(), "", "--", "Tiny line!"]) for _ in range(4)) for _ in range(90)]
    texts += ["s1 s2 s3 s4", "p q r t", "p q r t u", "v p q r t", None, ""]
    docs = docs_of(spark, texts)
    gone = brute_lines(texts, least=1)
    assert sum(map(len, gone.values())) > sum(map(len, brute_lines(texts, least=5).values()))
    for r in corpus_pipeline.lines(spark, docs, "").collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(r.doc_id, []))), r.doc_id
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs, slots=4).collect() if r.removed} == gone
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs, min_words=5).collect() if r.removed} == brute_lines(texts, least=5)


def test_line_dedup_moves_places_of_common_grams(spark, monkeypatch):
    """Which of a line's grams are left is found within the line: a list of places per line moves, not a row per gram, and no window ranks them."""
    own = random.Random(41)
    base = [f"s{own.randrange(99)}x{i}" for i in range(40)]
    texts = [" ".join(w for w in base if own.random() > 0.06) for _ in range(60)]
    real, plans, rows = linededup.materialize, {}, {}

    def noted(df, path, *a, **b):
        name = path.rpartition("/")[2]
        plans[name], out = df._jdf.queryExecution().executedPlan().toString(), real(df, path, *a, **b)
        rows[name] = out.count() if name == "hits" else None
        return out

    monkeypatch.setattr(linededup, "materialize", noted)
    monkeypatch.setattr(linededup, "GROUP", 5)
    for most in (linededup.WORDS, 0):  # lists sent to all, or joined by a shuffle
        monkeypatch.setattr(linededup, "WORDS", most)
        assert {r.doc_id: r.removed for r in linededup.line_marks(docs_of(spark, texts)).collect() if r.removed} == brute_lines(texts)
        assert "Window" not in plans["others"] and 0 < rows["hits"] <= len(texts)


def test_line_dedup_far_down_a_document(spark):
    """Similar lines whose positions take more than 21 bits."""
    at = 2**21 + 3
    docs = docs_of(spark, ["\n" * at + "one two three four five six seven eight nine\none two three four five six seven eight nine ten"])
    assert [r.removed for r in linededup.line_marks(docs).collect()] == [[at + 1]]


def test_line_dedup_moves_few_sets_of_long_lines(spark, tmp_path):
    """Unlike lines of 150 words pass the marks' 64 parity bits, and no longer have their sets moved; like ones are all found."""
    own = random.Random(31)
    texts = []
    for i in range(60):
        # two words more, that only a few other lines have, so that unlike lines meet
        w = [f"l{own.randrange(9999)}" for _ in range(150)] + [f"r{i // 6}", f"q{i // 6}"]
        texts.append(" ".join(w))
        texts += [" ".join(w[own.randrange(1, 60) :])] * (i % 7 == 0)
    docs = docs_of(spark, texts)
    sets = linededup.lines_of(docs, "doc_id", "text")
    sketched = sets.withColumn("_sketch", linededup._sketch(F.col("_s")))
    pairs = sets.select("_id", "_pos").crossJoin(sets.select(F.col("_id").alias("y_id"), F.col("_pos").alias("y_pos"))).filter("y_id < _id")
    bits = {r["_id"]: (r.n, r.p) for r in sets.select("_id", F.size("_s").alias("n"), linededup._parity(F.col("_s")).alias("p")).collect()}
    narrow = sum(9 * ((bits[r["_id"]][1] ^ bits[r.y_id][1]) % 2**64).bit_count() <= bits[r["_id"]][0] + bits[r.y_id][0] for r in pairs.collect())
    left = {(r["_id"], r.y_id) for r in linededup._alike(pairs, sketched).collect()}
    w = [set(words(t)) for t in texts]
    true = {(i, j) for i in range(len(w)) for j in range(i) if 5 * len(w[i] & w[j]) >= 4 * len(w[i] | w[j])}
    assert true and true <= left and len(left) <= len(true) + 5 and narrow > 10 * len(left)
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs).collect() if r.removed} == brute_lines(texts)


def test_line_dedup_reads_all_sets_few_times(spark, monkeypatch):
    """Rounds for lines with common grams take their sets from those that met, short sets are read once, and few lines are broadcast in the last step."""
    own = random.Random(37)
    base = [f"s{own.randrange(99)}x{i}" for i in range(40)]
    texts = [" ".join(w for w in base if own.random() > 0.04) for _ in range(80)] + [f"a b c d e{i % 9}" for i in range(20)]
    real, reads = linededup.materialize, {}

    def noted(df, path, *a, **b):
        reads[path.rpartition("/")[2]] = any("/lines/" in f for f in df.inputFiles())
        return real(df, path, *a, **b)

    monkeypatch.setattr(linededup, "materialize", noted)
    monkeypatch.setattr(linededup, "GROUP", 5)
    assert {r.doc_id: r.removed for r in linededup.line_marks(docs_of(spark, texts)).collect() if r.removed} == brute_lines(texts)
    assert reads["met"] is False and reads["texts"] is False and reads["2-left"] is False and reads["short"] is False and "late" in reads
    assert reads["short-sets"] and reads["lost"]


def test_warc_round_trip(spark):
    html = [None, "", "<p>ä</p>", "<p>ä</p>", "x" * 200000, "<p>ä</p>", "", "\x00\r\n\r\nWARC/1.1", "one\n"]
    pages = spark.createDataFrame([(9 - i, None if i == 2 else f"http://a/{i}%\n", h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    folder = work_dir(spark)
    warc.archive(pages.repartition(3), folder)
    back = {int(r.record_id): r for r in warc.read(spark, folder).collect()}
    assert len(back) == len(html)
    for i, h in enumerate(html):
        r, body = back[9 - i], (h or "").encode()
        first = min(9 - j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == 9 - i else ("revisit", str(first)))
        assert (bytes(r.payload) == body) if r.record_type == "response" else r.payload is None
        assert r.url == (None if i == 2 else f"http://a/{i}%\n")
    only = warc.read(spark, folder, payload=False).filter("record_type = 'revisit' and url = 'http://a/3%\n'")
    assert [r.record_id for r in only.collect()] == ["6"]
    reader = warc.WarcReader({"path": folder, "payload": "true"})
    rest = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.IsNotNull(("record_type",)), warc.EqualTo(("payload_bytes",), 3)]))
    assert rest == [warc.EqualTo(("payload_bytes",), 3)] and reader.tests == [("record_type", frozenset(["revisit"]))]
    assert warc.read(spark, folder).filter("record_type = 'revisit'").count() == sum(r.record_type == "revisit" for r in back.values())
    empty = work_dir(spark)
    warc.archive(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def warc_record(kind, body, *headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Target-URI: u:{kind}", *headers, f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def test_warc_reads_plain_and_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    parts = [
        warc_record("warcinfo", b"i"),
        warc_record("response", b"b" * 200_000, "WARC-Record-ID: <urn:1>"),
        warc_record("request", b""),
        warc_record("response", http + b"<p>hi</p>", "Content-Type: application/http; msgtype=response", "WARC-Payload-Digest: sha1:ABC"),
        warc_record("revisit", http, "Content-Type: application/http; msgtype=response", "WARC-Refers-To: <urn:1>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(b"".join(parts[:2])) + gzip.compress(parts[2] + b"\r\n" + b"".join(parts[3:])))
    got = warc.read(spark, str(tmp_path)).filter("record_type in ('response', 'request', 'revisit')").collect()
    want = [("request", 0, 0, None, None), ("response", 9, 9, None, "ABC"), ("response", 200_000, 200_000, None, None), ("revisit", None, 0, "<urn:1>", None)]
    assert Counter((r.record_type, None if r.payload is None else len(r.payload), r.payload_bytes, r.refers_to, r.payload_digest) for r in got) == Counter(want * 4)
    assert {bytes(r.payload) for r in got if r.payload_digest == "ABC"} == {b"<p>hi</p>"}
    assert [r.record_id for r in got if r.payload_bytes == 200_000] == ["<urn:1>"] * 4
    lean = warc.read(spark, str(tmp_path), payload=False).filter("record_type = 'response'").collect()
    assert Counter(r.payload_bytes for r in lean) == {9: 4, 200_000: 4}


def test_warc_drops_unwanted_payloads_piece_by_piece(tmp_path):
    """A payload of a gigabyte in a member of several records is passed without being held."""
    path, packer = tmp_path / "big.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31)
    size = 1 << 30
    with open(path, "wb") as f:
        f.write(packer.compress(warc_record("metadata", b"m")))
        f.write(packer.compress(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {size}\r\n\r\n".encode()))
        for _ in range(size >> 20):
            f.write(packer.compress(bytes(1 << 20)))
        f.write(packer.compress(b"\r\n\r\n" + warc_record("metadata", b"last")) + packer.flush())
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert not list(reader.pushFilters([warc.EqualTo(("record_type",), "metadata")]))
    tracemalloc.start()
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["payload"] for r in got] == [b"m", b"last"] and peak < 8 << 20


def test_warc_refuses_what_is_cut_off(tmp_path):
    whole = warc_record("response", b"b" * 5000)
    for name, data in {"a.warc": whole[:4000], "b.warc.gz": gzip.compress(whole)[:-30], "c.warc": b"WARC/1.0\r\nWARC-Type: x", "d.warc": b"no archive\r\n\r\n"}.items():
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(data)
        reader = warc.WarcReader({"path": str(folder)})
        with pytest.raises(ValueError):
            [b for p in reader.partitions() for b in reader.read(p)]


def test_media(spark):
    gen = np.random.default_rng(2)
    grey, colour = gen.integers(0, 256, (13, 17), dtype=np.uint8), gen.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(media.encode_ppm(colour)) == colour).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P2 # c\n2 2\n255\n1 2\n3 4\n") == [[1, 2], [3, 4]]).all()
    assert (media.decode(b"P1\n3 1\n1 0 1\n") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    # areas by brute force: each pixel repeated, then block means
    big = np.kron(grey.astype(float), np.ones((8, 9)))
    assert np.allclose(media.resize(grey.astype(float), 8, 9), big.reshape(8, 13, 9, 17).mean(axis=(1, 3)))
    for bad in (b"", b"P", b"P5 1", b"BMxx", b"GIF"):
        with pytest.raises(ValueError):
            media.decode(bad)
    rows = spark.createDataFrame([(1, bytearray(media.encode_bmp(colour))), (2, bytearray(b"no")), (3, None)], "i int, media binary")
    got = {r.i: r for r in media.media_features(rows).collect()}
    assert got[1].height == 5 and np.load(io.BytesIO(bytes(got[1].tile))).shape == (8, 8) and got[2].dhash is None and got[3].tile is None


def brute_area(pixels, height, width):
    """Means over equal areas, by the share of each pixel in each area."""
    share = lambda n, m: np.array([[max(0.0, min(i + 1, (j + 1) * n / m) - max(i, j * n / m)) for i in range(n)] for j in range(m)])
    down, across = share(pixels.shape[0], height), share(pixels.shape[1], width)
    return down @ pixels @ across.T / (pixels.shape[0] / height * pixels.shape[1] / width)


def test_text_media(spark):
    docs = docs_of(spark, [*AWKWARD, "a" * 576, "é" * 288, "b" * 577])
    for r in media.text_media(docs, with_media=True).collect():
        data = (docs.filter(f"doc_id = {r.doc_id}").first().text or "").encode()
        pay = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        if len(pay) // 576 % 2:
            stored = b"P5\n24 %d\n255\n" % (len(pay) // 24) + pay
            pixels = np.frombuffer(pay, np.uint8).reshape(-1, 24).astype(float)
        else:  # bottom row first, blue first
            rgb = np.frombuffer(pay, np.uint8).reshape(-1, 8, 3)
            stored = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(pay), 0, 0, 54, 40, 8, len(rgb), 1, 24, 0, len(pay), 2835, 2835, 0, 0) + rgb[::-1, :, ::-1].tobytes()
            pixels = rgb @ np.array([0.299, 0.587, 0.114])
        assert (r.media_bytes, r.media_sha256, bytes(r.media)) == (len(stored), hashlib.sha256(stored).hexdigest(), stored)
        tile, wide = brute_area(pixels, 8, 8), brute_area(pixels, 8, 9)
        got = np.load(io.BytesIO(bytes(r.tile)))
        assert got.shape == (8, 8) and np.abs(got - tile).max() <= 0.5 + 1e-6
        bits = "".join(str(int(b > a)) for row in np.round(wide, 6) for a, b in zip(row, row[1:], strict=False))
        assert r.feature == f"{int(bits, 2):016x}:{hashlib.sha256(bytes(r.tile)).hexdigest()[:16]}"
    assert media.text_media(docs.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    bad = [f"insult{i}" for i in range(8)]
    texts, toxic = [], []
    for i in range(600):
        w = prose(rng.randrange(5, 200), 3000).split()
        t = int(i % 4 == 0)
        for _ in range(rng.randrange(1, 6) * t):
            w.insert(rng.randrange(len(w) + 1), rng.choice(bad).upper())
        texts.append(" ".join(w))
        toxic.append(t)
    docs = docs_of(spark, [*texts, None, "", "insult3 insult4"])
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(400)] + [(9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = range(400, 600)
    assert sum(got[i].toxic == bool(toxic[i]) for i in held) >= 0.98 * len(held)
    assert all(0 <= r.severity <= 3 for r in got.values()) and not got[600].toxic and not got[601].toxic and got[602].toxic
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.toxic}
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.clean(docs, none).count() == docs.count() and toxicity.score(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    texts, good = [], []
    for i in range(400):
        w = prose(rng.randrange(20, 120), 3000)
        g = int(i % 3 != 0)
        texts.append(w if g else w.replace(" ", "*** ").upper())
        good.append(g)
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, good[i]) for i in range(200)] + [(9999, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, per_round=30)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 402 and sum((got[i].quality > 0.5) == bool(good[i]) for i in range(200, 400)) >= 190
    assert {r.quality for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_contamination_by_shuffled_windows(spark):
    """Without a broadcast the result is the same; a null item counts and is no part of the ids."""
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(ITEMS)), (None, "tiny item here"), (77, "one"), (78, "tiny ITEM")], "item_id long, text string")
    docs = docs_of(spark, [*AWKWARD, "one", "say one more", "a tiny item"])
    rows = lambda df: {(r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), tuple(r.spans)) for r in df.collect()}
    small, large = rows(decontaminate.contamination(docs, bench)), rows(decontaminate.contamination(docs, bench, most_bytes=0))
    assert small == large
    assert {x[0]: x[3] for x in small}[8] == 4 and (None in {x[0]: x[4] for x in small}[8])
    assert {x[0]: x[2] for x in small}[12] == 1 and {x[0]: x[2] for x in small}[14] == 2


CLASHES = ["_id", "_key", "_w", "_t", "_h", "_text", "_text_of", "_base_spans", "_other_spans", "_all_spans", "base", "spans", "size", "taken", "target", "source_size", "_nth", "_cut", "_copy", "_bad_id", "_bad_key", "_bad_spans", "_spans", "_gone", "_gkey", "_gone_id", "_gone_at", "_lid", "_y", "y", "h", "t", "id", "label_of", "k", "n", "key", "range", "item", "gram", "at", "bits", "severity", "toxic", "n_lines", "removed", "component_id", "kept", "quality", "x", "c"]


def test_any_column_names(spark):
    """Extra columns named like every helper: results, and columns and rows that pass through, stay as they are without them."""
    own = random.Random(12)
    lines = [prose(own.randrange(6, 20), 60) for _ in range(12)]
    texts = [None, "", "tiny item here", "mail a@b.co", *("\n".join(own.choices(lines, k=own.randrange(1, 4))) for _ in range(30))]
    texts += texts[5:9]
    bare = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    wide = bare.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    bench = spark.createDataFrame([(1, "tiny item here")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)] + [(3, 0, 1), (4, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = pii.PiiModel(pii.Boosted(0.0, 1.0, ()), {"string": 0.5, "number": 0.5})
    tox, good = toxicity.fit(bare, labels), quality.fit(bare, labels)
    assert toxicity.fit(wide, labels).cut == tox.cut and np.allclose(quality.fit(wide, labels).mix, good.mix)
    plain = {
        "contamination": lambda d: decontaminate.contamination(d, bench).select("doc_id", "n_hit"),
        "licenses": lambda d: licenses.scan(d).select("doc_id", "n_words", "score"),
        "spans": lambda d: pii.spans(d, model).select("doc_id", pii.written(F.col("spans"))),
        "quality": lambda d: quality.score(d, good).select("doc_id", "keep"),
        "toxicity": lambda d: toxicity.score(d, tox).select("doc_id", "toxic"),
        "media": lambda d: media.text_media(d).select("doc_id", "feature"),
        "lines": lambda d: linededup.line_marks(d).select("doc_id", "n_removed"),
        "near": lambda d: neardup.components(d).select("doc_id", "component_id"),
        "mix": lambda d: mixing.mix(d, keep=["doc_id"]).select("doc_id", "taken"),
    }
    for name, run in plain.items():
        assert sorted(map(str, run(wide).collect())) == sorted(map(str, run(bare).collect())), name
        assert run(wide.limit(0)).count() == 0, name
    through = {
        "decontaminate": lambda d: decontaminate.clean(d, bench),
        "cut": lambda d: decontaminate.clean(d, bench, remove="spans"),
        "redact": lambda d: pii.redact(d, model),
        "toxicity": lambda d: toxicity.clean(d, tox),
        "lines": linededup.clean,
        "near": neardup.clean,
        "draw": mixing.draw,
    }
    for name, run in through.items():
        got, want = run(wide), run(bare)
        assert got.columns == wide.columns, name
        assert sorted(map(str, got.select(bare.columns).collect())) == sorted(map(str, want.collect())), name
        assert got.filter(" or ".join(f"`{c}` <> concat('{c}:', doc_id)" for c in CLASHES)).count() == 0, name
        assert run(wide.limit(0)).count() == 0, name
    with pytest.raises(ValueError):
        mixing.mix(wide, keep=["size"])


def test_logistic_and_ordinal_against_dense_fits():
    """The fitted weights are where the penalised likelihood has no slope."""
    gen = np.random.default_rng(9)
    x, y = gen.normal(size=(80, 4)), gen.integers(0, 2, 80).astype(float)
    w, b = quality.logistic(x, y, ridge=1.0, steps=4000)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-4 and abs((p - y).sum()) < 1e-4
    has = gen.random((120, 6)) < 0.3
    grade = np.clip((has @ np.array([2.0, 1.0, 0.5, 0, 0, 0]) + gen.normal(size=120) > np.array([[0.5], [1.2], [2.0]])).sum(axis=0), 0, 3)
    of, word = np.nonzero(has)
    w, t = toxicity.fit_ordinal(of, word, 6, grade, ridge=0.3, lasso=0.0, steps=20000)
    over = grade[:, None] > np.arange(3)[None, :]

    def loss(w, t):
        z = (has @ w)[:, None] - t[None, :]
        return np.log1p(np.exp(np.where(over, -z, z))).sum() + 0.15 * (w**2).sum()

    # no small step, within w >= 0, makes it better
    best = loss(w, t)
    for i in range(6):
        for d in (1e-3, -1e-3):
            step = w.copy()
            step[i] = max(0.0, step[i] + d)
            assert loss(step, t) > best - 1e-5
    for i in range(3):
        for d in (1e-3, -1e-3):
            step = t.copy()
            step[i] += d
            assert loss(w, step) > best - 1e-5


def test_scores_against_one_document_at_a_time(spark):
    """Quality and severity as the models' formulas give them for each text alone."""
    own = random.Random(2)
    texts = [*AWKWARD, *(prose(own.randrange(1, 80), 200) + (" insult1 insult2" if i % 3 == 0 else "") for i in range(90))]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i + len(AWKWARD), int(i % 3 == 0), int(i % 3 > 0)) for i in range(90)], "doc_id long, toxic int, quality int")
    tox, good = toxicity.fit(docs, labels, min_docs=2, evidence=3.0), quality.fit(docs, labels)
    sev = {r.doc_id: r for r in toxicity.score(docs, tox).collect()}
    qual = {r.doc_id: r for r in quality.score(docs, good).collect()}
    known = dict(zip(tox.vocabulary.tolist(), tox.weights, strict=True))
    sigmoid = lambda z: 1 / (1 + math.exp(-min(30, max(-30, z))))
    import xxhash

    for i, t in enumerate(texts):
        feats = {xxhash.xxh3_64_intdigest(w) for w in words(t)} | {xxhash.xxh3_64_intdigest(w[:n], seed=n) for w in words(t) for n in toxicity.PREFIXES if len(w) > n}
        total = sum(known.get(f, 0.0) for f in feats)
        want = sum(sigmoid(total - k) for k in tox.thresholds)
        assert abs(sev[i].severity - want) < 1e-9 and sev[i].toxic == (sev[i].severity >= tox.cut)
        a = quality.byte_features(quality.pa.array([t or ""]), quality.PAIRS)
        m = quality.meta_features([quality.pa.array([v]) for v in ("en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t))])
        z = float(np.array([good.text.score(a)[0], good.meta.score(m)[0]], float) @ good.mix + good.bias)
        assert abs(qual[i].quality - sigmoid(z)) < 1e-4
