"""Vector code compression: vectors as one byte a part, each part named by the nearest entry of its codebook.

Vectors become integers, floor(scale * x), and columnar blocks of shape (part, dimension within part, vector), written once. A codebook
starts as the parts of the vectors of the smallest ids. In each round an RDD treeAggregate goes over the blocks: distances to all entries
accumulate dimension by dimension, np.add.at adds the vectors to int64 tensors of sums and counts, and the tensors, whose size
depends on parts and entries alone, merge through a reduction tree. All is in integers, so that neither order nor partitions change a bit.

Edge cases: vectors that are null, hold a null, a NaN or an infinity, or have another length than most vectors have (the smaller of equally
frequent ones; it has to be a multiple of the parts) have no code and no row; components are held at +-2**26 after scaling, so that errors stay
exact; of the vectors first in order of (id, vector), null ids last, as many as there are, up to ``entries``, start the codebooks;
rows that repeat an id are each coded; ties go to the lower entry; entries that nothing is assigned to stay; an empty table has empty
codebooks and no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block.
ROWS = 4096
LIMIT = 1 << 26


def _dimension(vectors: DataFrame, parts: int) -> int:
    """The most frequent length that parts divide; 0 without any."""
    sizes = vectors.select(F.size("_vec").alias("n")).filter((F.col("n") > 0) & (F.col("n") % parts == 0)).groupBy("n").count()
    top = sizes.orderBy(F.desc("count"), "n").first()
    return top["n"] if top else 0


def _to_blocks(dim: int, parts: int, scale: float):
    """Blocks (ids, labels, block) of the whole vectors in batches (_id, _label, _vec)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = np.asarray(batch["_vec"].value_lengths().fill_null(0)) == dim
            batch = batch.filter(pa.array(right & (dim > 0)))
            x = np.asarray(batch["_vec"].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dim)
            whole = np.isfinite(x).all(axis=1)
            batch, x = batch.filter(pa.array(whole)), x[whole]
            for at in range(0, len(x), ROWS):
                with np.errstate(over="ignore"):
                    ints = np.clip(np.floor(x[at : at + ROWS] * scale), -LIMIT, LIMIT).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(ints)], pa.int32()), batch[c].slice(at, len(ints))) for c in ("_id", "_label")]
                columnar = np.ascontiguousarray(ints.T).tobytes()
                yield pa.RecordBatch.from_arrays([*lists, pa.array([columnar], pa.binary())], names=["ids", "labels", "block"])

    return run


def _block(data: bytes, dim: int, parts: int) -> np.ndarray:
    """(part, dimension within part, vector)"""
    return np.frombuffer(data, np.int32).reshape(parts, dim // parts, -1)


def _smallest(dim: int, most: int):
    """(_id, _v) of each block's vectors that may be among the first in order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch["ids"], batch["block"], strict=True):
                ids, rows = ids.values, _block(data.as_buffer(), dim, 1)[0].T
                rank = np.asarray(pc.rank(ids, null_placement="at_end", tiebreaker="min"), dtype=np.int64)
                few = np.lexsort((*rows.T[::-1], rank))[:most]
                flat = pa.array(rows[few].reshape(-1), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(few)), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), flat)], names=["_id", "_v"])

    return run


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, vector) each: the nearest entry of each part's codebook (part, entry, dimension), and its squared distance."""
    parts, dims, n = block.shape
    index, error = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for p in range(parts):
        far = np.zeros((n, books.shape[1]), np.int64)
        for d in range(dims):
            step = block[p, d].astype(np.int64)[:, None] - books[p, :, d]
            far += step * step
        index[p] = far.argmin(axis=1)
        error[p] = far[np.arange(n), index[p]]
    return index, error


def _add(tensors: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = tensors
    index, _ = assign(block, books)
    for p in range(len(block)):
        np.add.at(counts[p], index[p], 1)
        for d in range(block.shape[1]):
            np.add.at(sums[p, :, d], index[p], block[p, d])
    return sums, counts


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


class Codes:
    """Blocks of vectors and the codebooks (part, entry, dimension) that were fitted to them."""

    def __init__(self, blocks: DataFrame, books: np.ndarray, dim: int):
        self.blocks, self.books, self.dim = blocks, books, dim

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def rows(self, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
        """Per vector: the id, the label, code (a byte a part), error (squared distances summed over parts)."""
        books, dim, parts = self.books, self.dim, len(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, labels, data in zip(batch["ids"], batch["labels"], batch["block"], strict=True):
                    index, error = assign(_block(data.as_buffer(), dim, parts), books)
                    code = np.ascontiguousarray(index.T.astype(np.uint8)).tobytes()
                    offsets = pa.py_buffer((np.arange(index.shape[1] + 1) * parts).astype(np.int32).tobytes())
                    codes = pa.Array.from_buffers(pa.binary(), index.shape[1], [None, offsets, pa.py_buffer(code)])
                    yield pa.RecordBatch.from_arrays([ids.values, labels.values, codes, pa.array(error.sum(axis=0))], names=["_id", "_label", "_code", "_error"])

        kind, label = (self.blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
        out = self.blocks.mapInArrow(run, f"_id {kind}, _label {label}, _code binary, _error long")
        return out.toDF(id_col, label_col, "code", "error")


def restore(code: bytes, books: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """The vector that a code stands for: its entries, in the middle of the steps that floor() made."""
    return (np.concatenate([books[p, i] for p, i in enumerate(code)]) + 0.5) / scale


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, depth: int = 2) -> Codes:
    """Writes the blocks and fits the codebooks to all of them."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has to fit a byte")
    own = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).alias("_vec"))
    dim = _dimension(own, parts)
    kind, label = (own.schema[c].dataType.simpleString() for c in ("_id", "_label"))
    blocks = materialize(own.mapInArrow(_to_blocks(dim, parts, scale), f"ids array<{kind}>, labels array<{label}>, block binary"), work_dir(vectors.sparkSession))
    first = blocks.mapInArrow(_smallest(dim, entries), f"_id {kind}, _v array<int>").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).collect() if dim else []
    if not first:
        return Codes(blocks, np.zeros((parts, 0, 0), np.int64), dim)
    books = np.array([r["_v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    columnar = blocks.select("block").rdd.map(lambda r: _block(r["block"], dim, parts))
    for _ in range(rounds):
        zero = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        sums, counts = columnar.treeAggregate(zero, lambda t, block, books=books: _add(t, block, books), _merge, depth)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return Codes(blocks, books, dim)


def label_errors(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """rows of Codes.rows() with label_error: error summed over rows of the same label, null labels together."""
    total = rows.groupBy(F.col(label_col).alias("_of")).agg(F.sum("error").alias("label_error"))
    return rows.join(total, F.col(label_col).eqNullSafe(F.col("_of"))).drop("_of")
