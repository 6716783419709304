"""Toxicity by cumulative-link ordinal regression.

A document's severity grade is 0 to GRADES; one weight vector over sparse word features is shared by ordered thresholds,
P(grade > k) = logistic(w.x - t_k). The output is the expected severity. Labels say only toxic or not; the grade of a
toxic training document is its tercile by the density of words that labelled toxic documents have and others have not.
Words, grades and weights come from the documents for fitting alone; the cut comes from documents that these have not seen.

Edge cases: a null or empty text has severity of the prior alone and is kept; repeated rows each get a row; labels
without document and null labels are ignored, and of contradicting ones the more severe holds; without labels of both classes
every severity is 0 and all are kept; other columns are ignored by ``fit`` and pass through ``clean``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP
from .textfeat import owners, slices, tokens

GRADES = 3
#: A word's features are itself and its beginnings of these lengths, which inflected and compound words share.
PREFIXES = (4, 5, 6)


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, codes, bounds): feature hashes of each distinct word, 0 for none; the words of all texts; where each text's begin and end."""
    flat, bounds = tokens(texts, WORD_GAP)
    coded = flat.dictionary_encode()
    table = np.zeros((len(coded.dictionary), 1 + len(PREFIXES)), np.uint64)
    for i, w in enumerate(coded.dictionary.to_pylist()):
        table[i, 0] = xxhash.xxh3_64_intdigest(w)
        for j, n in enumerate(PREFIXES, 1):
            if len(w) > n:
                table[i, j] = xxhash.xxh3_64_intdigest(w[:n], seed=n)
    return table, np.asarray(coded.indices, dtype=np.int64), bounds


@dataclass(frozen=True)
class OrdinalModel:
    """vocabulary: sorted word hashes; weights beside them; ordered thresholds; cut: the least expected severity that is rejected."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def expected(self, table: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of P(grade > k). A feature counts once in a text."""
        total = np.zeros(len(bounds) - 1)
        if len(self.vocabulary) and len(codes):
            at = np.minimum(np.searchsorted(self.vocabulary, table), len(self.vocabulary) - 1)
            at[self.vocabulary[at] != table] = -1
            known = (at >= 0).any(axis=1)[codes]
            places = at[codes[known]]
            of = np.repeat(owners(bounds)[known], places.shape[1])
            of, place = of[places.ravel() >= 0], places.ravel()[places.ravel() >= 0]
            pairs = np.unique(of * len(self.vocabulary) + place)
            total = np.bincount(pairs // len(self.vocabulary), self.weights[pairs % len(self.vocabulary)], minlength=len(total))
        return self.severity(total)

    def severity(self, total: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -30, 30)))).sum(axis=1)


def _distinct(table: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) pairs without repeats."""
    of, h = np.repeat(owners(bounds), table.shape[1]), table[codes].ravel()
    of, h = of[h != 0], h[h != 0]
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def fit_ordinal(of: np.ndarray, word: np.ndarray, n_words: int, grade: np.ndarray, ridge: float = 0.3, lasso: float = 3.0, steps: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal descent on the cumulative-link likelihood; weights are not negative, and few. of, word: which text has which word."""
    n, ks = len(grade), np.arange(GRADES)
    over = (grade[:, None] > ks[None, :]).astype(float)
    w = np.zeros(n_words)
    share = np.clip(over.mean(axis=0), 1e-4, 1 - 1e-4)
    t = -np.log(share / (1 - share))
    df = np.bincount(word, minlength=n_words) + 1.0
    v, vt, pw, pt = w.copy(), t.copy(), w, t
    for k in range(steps):
        s = np.bincount(of, v[word], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(s[:, None] - vt[None, :], -30, 30)))
        g = p - over
        gw = np.bincount(word, g.sum(axis=1)[of], minlength=n_words) + ridge * v
        step = 1 / (df * GRADES * 0.25 * 12 + ridge)  # a text shares its error among few typical words
        nw = np.maximum(v - step * (gw + lasso), 0.0)
        nt = np.maximum.accumulate(vt + g.sum(axis=0) / (0.25 * n * 4))  # thresholds stay in order
        m = k / (k + 3)
        v, vt, pw, pt = nw + m * (nw - pw), nt + m * (nt - pt), nw, nt
    return pw, np.maximum.accumulate(pt)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", max_labelled: int = 5000, max_features: int = 4000, min_docs: int = 4, evidence: float = 25.0, clean_weight: float = 10.0) -> OrdinalModel:
    """Fits on at most max_labelled labelled documents, chosen by the hash of their ids, half of them toxic at most.

    Executors send hashes of at most max_features features of a document, those with the smallest hashes of their hashes, and no
    texts; the number bounds what reaches the driver. A fifth of the documents, told by their hashes, is kept apart: words, grades
    and weights come from the others alone, and these only set the cut, where the share of toxic documents below and clean_weight times
    that of clean ones above are least together. Of labels that contradict each other the more severe holds.
    """
    h = F.xxhash64(F.col(label_id).cast("string"))
    own = labels.filter(F.col(label_col).isNotNull()).select(F.col(label_id).alias("label_of"), (F.col(label_col) > 0).cast("int").alias("y"), h.alias("h")).groupBy("label_of", "h").agg(F.max("y").alias("y"))
    count = {r["y"]: r["k"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("k")).collect()}
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 30.0), float("inf"))
    if len(count) < 2:
        return none
    half = max_labelled // 2
    rest = F.when(F.col("y") == 1, max(1, count[1] // half)).otherwise(max(1, count[0] // half))
    some = own.filter(F.pmod(F.col("h"), rest) == 0).orderBy("h").limit(max_labelled)

    def send(batches):
        for batch in batches:
            for piece, texts in slices(batch, "t"):
                table, codes, bounds = word_features(texts)
                of, word = _distinct(table, codes, bounds)
                ends = np.searchsorted(of, np.arange(piece.num_rows + 1))
                each = [word[ends[i] : ends[i + 1]] for i in range(piece.num_rows)]
                each = [x if len(x) <= max_features else x[np.argsort(x * np.uint64(0x9E3779B97F4A7C15), kind="stable")[:max_features]] for x in each]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in each], pa.binary()), pa.array(np.diff(bounds)), piece.column("y"), piece.column("h")], names=["w", "n", "y", "h"])

    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = texts_of.join(F.broadcast(some), F.col("id") == F.col("label_of")).select("t", "y", "h").mapInArrow(send, "w binary, n long, y int, h long").orderBy("h", "n", "w").limit(max_labelled).collect()
    y = np.array([r["y"] for r in rows])
    held = np.array([(r["h"] >> 8) % 5 == 0 for r in rows], dtype=bool)
    if len(set(y[~held])) < 2:
        return none
    each = [np.frombuffer(bytes(r["w"]), np.uint64) for r in rows]
    length = np.maximum(np.array([r["n"] for r in rows]), 1)
    of, h_ = np.repeat(np.arange(len(rows)), [len(x) for x in each]), np.concatenate(each)
    vocab, word = np.unique(h_, return_inverse=True)
    learn = ~held[of]
    df = np.bincount(word[learn], minlength=len(vocab))
    bad = np.bincount(word[learn], y[of[learn]], minlength=len(vocab))
    # features whose share of toxic documents is far above chance, by likelihood ratio; others would only fit noise
    n1, n0 = y[~held].sum(), (1 - y[~held]).sum()
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((df - bad + 0.5) / (n0 + 1))
    p1, p = (bad + 1e-9) / np.maximum(df, 1), n1 / (n1 + n0)
    ratio = 2 * (bad * np.log(p1 / p) + (df - bad) * np.log(np.maximum(1 - p1, 1e-9) / (1 - p)))
    keep = (df >= min_docs) & (odds > 0) & (ratio >= evidence)
    place = np.cumsum(keep) - 1
    use = keep[word]
    of, word, vocab, odds = of[use], place[word[use]], vocab[keep], odds[keep]
    if not len(vocab):
        return none
    loud = odds > 2.0
    density = np.bincount(of, loud[word].astype(float), minlength=len(rows)) / length
    taught = (y > 0) & ~held
    ranks = np.argsort(np.argsort(density[taught], kind="stable"), kind="stable")
    grade = np.zeros(len(rows), int)
    grade[taught] = 1 + ranks * GRADES // max(1, len(ranks))
    place = np.cumsum(~held) - 1
    w, t = fit_ordinal(place[of[~held[of]]], word[~held[of]], len(vocab), grade[~held])
    model = OrdinalModel(vocab, w, t, float("inf"))
    e = model.severity(np.bincount(of, w[word], minlength=len(rows)))
    if len(set(y[held])) < 2:  # too few labels to keep some apart
        held = np.ones(len(y), bool)
    cuts = np.linspace(0.15, 1.5, 136)
    cost = [(e[held & (y > 0)] < c).mean() + clean_weight * (e[held & (y == 0)] >= c).mean() for c in cuts]
    return OrdinalModel(vocab, w, t, float(cuts[int(np.argmin(cost))]))


def _severity(texts: pa.Array, model: OrdinalModel) -> np.ndarray:
    return model.expected(*word_features(texts))


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the id, severity (0 to GRADES, expected) and toxic."""

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                e = _severity(texts, model)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(e), pa.array(e >= model.cut)], names=["_id", "severity", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, severity double, toxic boolean").withColumnRenamed("_id", id_col)


def clean(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """The documents that are not toxic, with all their columns: a map, no shuffle."""
    where = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        for batch in batches:
            batch = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for piece, texts in slices(batch, f"c{where}"):
                kept = piece.filter(pa.array(_severity(texts, model) < model.cut))
                yield kept.rename_columns(names)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)
