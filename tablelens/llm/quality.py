"""Quality by co-training.

One classifier sees the text, another only the page's metadata. Over rounds each names the documents of the whole corpus,
without the labelled ones, that it is surest of, and the other learns them. Both are then calibrated on held-out labels and combined, and every
document is scored.

Edge cases: null text is empty, null metadata a value of its own; repeated rows each get a row; labels without document,
null labels and documents without label are fine; of labels that contradict each other the lower holds; ties in confidence go by the id's hash;
without labels of both classes all scores are 0.5; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textfeat import byte_features, logistic, slices

PAIRS, META = 384, 128


def meta_features(columns: list[pa.Array]) -> np.ndarray:
    """Metadata values by hash, alone and joined; of numbers their order of magnitude."""
    rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
    out = np.zeros((len(rows), META), np.float32)
    seen: dict[str, int] = {}
    for i, row in enumerate(rows):
        said = [f"{j}={int(np.log2(abs(v) + 1) * 2) if isinstance(v, int | float) else v}" for j, v in enumerate(row)]
        for s in [*said, "|".join(said)]:
            if s not in seen:
                seen[s] = xxhash.xxh32_intdigest(s) % META
            out[i, seen[s]] = 1
    return out


@dataclass(frozen=True)
class View:
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights.astype(np.float32) + np.float32(self.bias)


@dataclass(frozen=True)
class CoModel:
    """View scores to log-odds of good quality: a calibrated sum."""

    text: View
    meta: View
    mix: np.ndarray
    bias: float
    cut: float


def _columns(docs: DataFrame, id_col: str, text_col: str, meta_cols: list[str], extra: list = ()) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(meta_cols)], *extra)


def _views(piece: pa.RecordBatch, texts: pa.Array, n_meta: int) -> tuple[np.ndarray, np.ndarray]:
    return byte_features(texts, PAIRS), meta_features([piece.column(f"_m{i}") for i in range(n_meta)])


def _gather(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(bytes(r["a"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    b = np.frombuffer(b"".join(bytes(r["b"]) for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return a, b, np.array([r["y"] for r in rows], float), np.array([r["h"] for r in rows], np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), label_id: str = "doc_id", label_col: str = "quality", max_labelled: int = 5000, rounds: int = 2, per_round: int = 200, keep_recall: float = 0.995) -> CoModel:
    """Fits on at most max_labelled labels, chosen by the hash of their ids; a quarter of them only calibrates.

    Each round reads all documents but the labelled ones; every task passes on its per_round surest for each class and view, and the
    surest of these are learned: 4 * per_round rows reach the driver. So neither view has seen what calibrates, nor learns a label twice.
    """
    h = F.xxhash64(F.col(label_id).cast("string"))
    every = max(1, labels.count() // max_labelled)
    some = labels.filter(F.col(label_col).isNotNull() & (F.pmod(h, F.lit(every)) == 0)).select(F.col(label_id).alias("label_of"), F.col(label_col).cast("double").alias("y"), h.alias("h"))
    some = some.groupBy("label_of", "h").agg(F.min("y").alias("y")).orderBy("h").limit(max_labelled)
    meta = list(meta_cols)

    def features(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                a, b = _views(piece, texts, len(meta))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in a.astype(np.float16)], pa.binary()), pa.array([r.tobytes() for r in b.astype(np.float16)], pa.binary()), piece.column("y"), piece.column("h")], names=["a", "b", "y", "h"])

    all_ = _columns(docs, id_col, text_col, meta)
    labelled = all_.join(F.broadcast(some), F.col("_id") == F.col("label_of"))
    rows = labelled.mapInArrow(features, "a binary, b binary, y double, h long").orderBy("h", "a", "b").limit(max_labelled).collect()
    if len({r["y"] for r in rows}) < 2:
        return CoModel(View(np.zeros(259 + PAIRS), 0.0), View(np.zeros(META), 0.0), np.zeros(2), 0.0, 0.0)
    a, b, y, hh = _gather(rows)
    held = (hh // every) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.arange(len(y)) % 4 == 0
    pool_a, pool_b = [(a[~held], y[~held])], [(b[~held], y[~held])]
    learn = lambda pool: View(*logistic(np.vstack([x for x, _ in pool]), np.concatenate([t for _, t in pool])))
    text, page = learn(pool_a), learn(pool_b)
    others = all_.join(F.broadcast(some.select("label_of")), F.col("_id") == F.col("label_of"), "left_anti")
    for _ in range(rounds):
        sure = _surest(others, meta, text, page, per_round)
        for view, pool in ((0, pool_b), (1, pool_a)):  # what one view is sure of teaches the other
            mine = [r for r in sure if r["view"] == view]
            if mine:
                xa, xb, t, _ = _gather(mine)
                pool.append((xb if view == 0 else xa, t))
        text, page = learn(pool_a), learn(pool_b)
    seen = np.stack([text.score(a[held]), page.score(b[held])], axis=1)
    mix, bias = logistic(seen.astype(float), y[held], ridge=0.1, steps=2000)
    good = np.sort((seen @ mix + bias)[y[held] > 0.5])
    return CoModel(text, page, mix, bias, min(0.0, float(good[int(len(good) * (1 - keep_recall))])) if len(good) else 0.0)


#: The surest are chosen in so many groups for each view and class, then among the groups' own.
GROUPS = 64


def _surest(docs: DataFrame, meta: list[str], text: View, page: View, k: int) -> list:
    """For each view and class the k documents it is surest of."""

    def run(batches):
        best: dict[tuple[int, int], list] = {(v, c): [] for v in (0, 1) for c in (0, 1)}
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                a, b = _views(piece, texts, len(meta))
                hs = np.asarray(piece.column("_h"))
                for v, score in enumerate((text.score(a), page.score(b))):
                    for c, s in ((1, score), (0, -score)):
                        for i in np.argsort(-s, kind="stable")[:k]:
                            if s[i] > 0:
                                best[v, c].append((-float(s[i]), int(hs[i]), a[i].astype(np.float16).tobytes(), b[i].astype(np.float16).tobytes()))
                        best[v, c] = sorted(best[v, c])[:k]
        rows = [(v, float(c), s, h, x, z) for (v, c), found in best.items() for s, h, x, z in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], names=["view", "y", "s", "h", "a", "b"])

    found = docs.withColumn("_h", F.xxhash64(F.col("_id").cast("string"))).mapInArrow(run, "view int, y double, s double, h long, a binary, b binary")
    for by in (["view", "y", F.pmod("h", F.lit(GROUPS))], ["view", "y"]):
        found = found.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy("s", "h", "a", "b"))).filter(F.col("r") <= k)
    return found.orderBy("view", "y", "r").collect()  # 4k rows at most


def score(docs: DataFrame, model: CoModel, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """Per document: the id, text_score, meta_score, quality (probability of good) and keep."""
    meta = list(meta_cols)

    def run(batches):
        for batch in batches:
            for piece, texts in slices(batch, "_t"):
                a, b = _views(piece, texts, len(meta))
                s, m = model.text.score(a).astype(float), model.meta.score(b).astype(float)
                logit = np.stack([s, m], axis=1) @ model.mix + model.bias
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(s), pa.array(m), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), pa.array(logit >= model.cut)], names=["_id", "text_score", "meta_score", "quality", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _columns(docs, id_col, text_col, meta).mapInArrow(run, f"_id {kind}, text_score double, meta_score double, quality double, keep boolean").withColumnRenamed("_id", id_col)
