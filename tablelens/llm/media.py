"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, with tiles and difference hashes.

Edge cases: a null or empty text is one row of padding; equal bytes give equal results; bytes that are no image raise
ValueError in ``decode`` and give nulls from ``media_features``; other columns are ignored; the longest text is one image
of its own, and of a row the payload, the stored bytes and the image read back are in memory at a time, with no copy in wider numbers.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Bytes of a padded unit, and the width of the grey image that holds them: 24 rows of 24.
UNIT, WIDTH = 576, 24
TILE = 8


def _tokens(data: bytes, n: int) -> tuple[list[int], int]:
    """The n numbers of a Netpbm header and where they end; comments run to the end of a line."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - ord("0")
    bitmap, colour = kind in (1, 4), kind in (3, 6)
    head, at = _tokens(data, 2 if bitmap else 3)
    w, h, top = head[0], head[1], 1 if bitmap else head[2]
    channels = 3 if colour else 1
    if kind == 4:
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return ((1 - np.unpackbits(rows, axis=1)[:, :w]) * 255).astype(np.uint8)
    if kind <= 3:
        plain = b" ".join(line.partition(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        values = np.array([c - 48 for c in plain if c in b"01"] if kind == 1 else plain.split(), dtype=np.int64)[: h * w * channels]
    elif top == 255:
        image = np.frombuffer(data, np.uint8, h * w * channels, at).reshape(h, w, channels)
        return image if colour else image[..., 0]
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", h * w * channels, at).astype(np.int64)
    if len(values) != h * w * channels:
        raise ValueError("a Netpbm image ends early")
    values = (1 - values) * 255 if bitmap else values if top == 255 else values * 255 // max(top, 1)
    image = values.astype(np.uint8).reshape(h, w, channels)
    return image if colour else image[..., 0]


def _bmp(data: bytes) -> np.ndarray:
    start, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (8, 24, 32):
        raise ValueError("only unpacked BMP of 8, 24 or 32 bits")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)[:, 2::-1]
        image = palette[rows]
        return image[..., 0] if (image == image[..., :1]).all() else image
    return rows.reshape(abs(h), w, bits // 8)[..., 2::-1]


def decode(data: bytes) -> np.ndarray:
    """(height, width) of grey or (height, width, 3) of red, green and blue, 8 bits each."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError("a damaged image") from e
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits, bottom row first."""
    rgb = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
    h, w, _ = rgb.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


GREY = np.array([0.299, 0.587, 0.114])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of a grey image. The integral image, read between its points, sums any rectangle from four corners.

    It is worked out at the rows that are read only, by running sums over the rows between them: memory beyond the image is
    a few rows.
    """
    h, w = image.shape
    at = np.linspace(0, h, height + 1)
    low = np.minimum(at.astype(int), h - 1)
    total, rows = np.zeros(w), np.zeros((height + 1, w + 1))
    for k in range(height + 1):
        if k:
            total = total + image[low[k - 1] : low[k]].sum(axis=0, dtype=np.float64)
        np.cumsum(total + (at[k] - low[k]) * image[low[k]], out=rows[k, 1:])
    across = np.linspace(0, w, width + 1)
    left = np.minimum(across.astype(int), w - 1)
    corners = rows[:, left] + (across - left) * (rows[:, left + 1] - rows[:, left])
    return np.diff(np.diff(corners, axis=0), axis=1) / ((h / height) * (w / width))


def grey(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image resized, as grey. Greyness is linear, so colours are resized first and weighed then."""
    if image.ndim == 2:
        return resize(image, height, width)
    return sum(g * resize(image[..., c], height, width) for c, g in enumerate(GREY))


def dhash(image: np.ndarray, side: int = TILE) -> str:
    """A bit for each pair of neighbours of the resized image: whether it gets brighter to the right."""
    small = np.round(grey(image, side, side + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image as an NPY file of side by side bytes."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(grey(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


_FEATURES = pa.schema([("height", pa.int32()), ("width", pa.int32()), ("dhash", pa.string()), ("tile", pa.binary())])


def media_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with height, width, dhash and tile (NPY bytes) of each image; nulls where the bytes are none."""
    clash = {"height", "width", "dhash", "tile"} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"rename {sorted(clash)} first")

    def run(batches):
        for batch in batches:
            found = []
            for x in batch.column(media_col):
                try:
                    image = decode(x.as_py() or b"")
                    found.append({"height": image.shape[0], "width": image.shape[1], "dhash": dhash(image), "tile": npy_tile(image)})
                except ValueError:
                    found.append(dict.fromkeys(_FEATURES.names))
            more = pa.RecordBatch.from_pylist(found, schema=_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.columns], names=[*batch.schema.names, *more.schema.names])

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("dhash", T.StringType()), T.StructField("tile", T.BinaryType())])
    return df.mapInArrow(run, schema)


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of UNIT."""
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """A padded payload as an image: of an odd number of units a grey PGM, of an even number a colour BMP, eight pixels a row."""
    samples = np.frombuffer(payload, np.uint8)
    return encode_pgm(samples.reshape(-1, WIDTH)) if len(payload) // UNIT % 2 else encode_bmp(samples.reshape(-1, WIDTH // 3, 3))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Each text as a stored image and what reading it back gives: the id, sizes and hashes, feature (difference hash and the tile's hash), tile (NPY bytes).

    with_media adds the stored bytes.
    """
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    schema += ", media binary" if with_media else ""
    kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary(), "media": pa.binary()}
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for x in batch.column(1):
                data = x.as_buffer()
                media = store(padded(data.to_pybytes()))
                image = decode(media)
                payload = np.ascontiguousarray(image).data.cast("B")
                tile = npy_tile(image)
                values = (data.size, payload.nbytes, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{dhash(image)}:{hashlib.sha256(tile).hexdigest()[:16]}", tile, media)
                for k, v in zip(names, values, strict=False):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], names=["_id", *out])

    return docs.select(F.col(id_col).alias("_id"), F.encode(text_of(text_col), "UTF-8").alias("_t")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def write_tiles(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The tiles of all texts as Parquet rows of (id, feature, tile), the tile an NPY file's bytes."""
    text_media(docs, id_col, text_col).select(id_col, "feature", "tile").write.parquet(path)
