"""Vectorised text features over Arrow batches: no Python loop over rows or tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows of an Arrow batch that are worked on at once, and bytes of text at most unless one text is longer.
ROWS, BYTES = 512, 4 << 20


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Pieces of the batch and their texts, null as empty, of bounded bytes; a longer text is a piece of its own."""
    texts = pc.fill_null(batch.column(text_col), "")
    sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        within = np.cumsum(sizes[at : at + ROWS]) <= BYTES
        n = max(1, int(within.sum()))
        yield batch.slice(at, n), texts.slice(at, n)
        at += n


def tokens(texts: pa.Array, gap: str | None) -> tuple[pa.Array, np.ndarray]:
    """All non-empty tokens of ASCII-lower-cased texts, and where each text's begin and end. gap: what parts tokens; None for white space."""
    low = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(low) if gap is None else pc.split_pattern_regex(low, gap)
    flat, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of tokens; each distinct one is hashed once."""
    coded = flat.dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(s) for s in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)] if len(flat) else np.zeros(0, np.uint64)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Of each token, the text it is of."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def byte_features(texts: pa.Array, pairs: int) -> np.ndarray:
    """Per text: square roots of the shares of each byte and of each of so many buckets of byte pairs, and a few sizes."""
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    n, bounds = len(raw), offsets - offsets[0]
    of = np.repeat(np.arange(n), np.diff(bounds))
    size = np.maximum(np.diff(bounds), 1)[:, None]
    ones = np.bincount(of * 256 + data, minlength=n * 256).reshape(n, 256)
    same = of[1:] == of[:-1]
    bucket = ((data[:-1].astype(np.uint32) * 257 + data[1:]) * np.uint32(2654435761) >> np.uint32(16)) % pairs
    twos = np.bincount((of[1:] * pairs + bucket)[same], minlength=n * pairs).reshape(n, pairs)
    lines = ones[:, 10] + 1
    more = np.stack([np.log1p(size[:, 0]) / 10, np.log1p(lines) / 5, np.log1p(size[:, 0] / lines) / 10], axis=1)
    return np.hstack([np.sqrt(ones / size), np.sqrt(twos / size), more]).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient descent from zero; the same data give the same weights."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(y):
        return w, b
    step = 1.0 / (0.25 * (np.linalg.norm(x, ord="fro") ** 2 / len(y) + 1) + ridge / len(y))
    v, c = w.copy(), b
    for k in range(steps):
        g = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        new, nb = v - step * (x.T @ g / len(y) + ridge / len(y) * v), c - step * g.mean()
        m = k / (k + 3)
        v, c, w, b = new + m * (new - w), nb + m * (nb - b), new, nb
    return w, b
