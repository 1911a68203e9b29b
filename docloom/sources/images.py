"""Images as rows: PNG read and written with the standard library, base64 payloads with errors that name their place.

Pixels are RGB bytes, row by row.  Other formats go through a registered ``image_decode`` engine."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import trim

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: gray, RGB, palette, gray with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"PNG chunk {kind.decode('latin-1')} is damaged")
        yield kind, body
        at += 12 + size


def _unfiltered(raw: np.ndarray, rows: int, line: int, step: int) -> np.ndarray:
    """Scan lines without their filters; ``step`` is the distance in bytes to the pixel on the left."""
    if len(raw) < rows * (line + 1):
        raise ValueError("PNG has too few pixels")
    given = raw[: rows * (line + 1)].reshape(rows, line + 1)
    out = np.zeros((rows, line + step), np.int64)  # a pixel of zeros on the left
    above = np.zeros(line + step, np.int64)
    for r in range(rows):
        kind, x, now = int(given[r, 0]), given[r, 1:].astype(np.int64), out[r]
        if kind == 0:
            now[step:] = x
        elif kind == 1:
            for c in range(min(step, line)):
                now[step + c :: step] = np.cumsum(x[c::step]) & 255
        elif kind == 2:
            now[step:] = (x + above[step:]) & 255
        elif kind in (3, 4):
            for i in range(line):
                a, b, c = int(now[i]), int(above[step + i]), int(above[i])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((a, b, c), key=lambda v: abs(p - v))  # noqa: B023
                now[step + i] = (int(x[i]) + guess) & 255
        else:
            raise ValueError(f"PNG filter {kind} is unknown")
        above = now
    return out[:, step:].astype(np.uint8)


def _samples(lines: np.ndarray, width: int, depth: int, channels: int) -> np.ndarray:
    """(rows, width, channels) of 8 bits: 16 bits lose their low byte; fewer stay as they are."""
    if depth == 16:
        return lines.reshape(len(lines), -1, 2)[:, : width * channels, 0].reshape(len(lines), width, channels)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
    return lines[:, : width * channels].reshape(len(lines), width, channels)


def read_png(raw: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG of any colour type and depth; alpha is dropped.  ValueError for anything else."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    head, palette, data = None, None, []
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if not head or head[3] not in CHANNELS or head[2] not in (1, 2, 4, 8, 16) or not head[0] or not head[1]:
        raise ValueError("PNG without a proper header")
    width, height, depth, colour, _, _, interlaced = head
    channels = CHANNELS[colour]
    try:
        flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"PNG pixels are damaged: {e}") from None
    out, at = np.zeros((height, width, channels), np.uint8), 0
    for x, y, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // dx), -(-(height - y) // dy)
        if w > 0 and h > 0:
            line = -(-w * channels * depth // 8)
            out[y::dy, x::dx] = _samples(_unfiltered(flat[at:], h, line, max(1, channels * depth // 8)), w, depth, channels)
            at += h * (line + 1)
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("PNG without its palette")
        return palette[out[:, :, 0]]
    if depth < 8:
        out = (out.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(out[:, :, :1], 3, 2) if channels < 3 else out[:, :, :3]


def write_png(pixels: np.ndarray) -> bytes:
    """An RGB image as PNG."""
    height, width, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)], 1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode_images(rows: DataFrame, raw: str, decode=read_png) -> DataFrame:
    """``rows`` with width, height, pixels and image_error: what is wrong with bytes that can't be decoded (then no pixels)."""
    place = rows.columns.index(raw)

    def one(body) -> tuple:
        try:
            p = decode(bytes(body if body is not None else b""))
        except ValueError as e:
            return None, None, None, str(e)
        return p.shape[1], p.shape[0], p.tobytes(), None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                part = batch.slice(k, 16)
                found = list(zip(*(one(b.as_py()) for b in part.column(place)), strict=True))
                columns = [pa.array(v, t) for v, t in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*batch.schema.names, "width", "height", "pixels", "image_error"])

    extra = [("width", T.IntegerType()), ("height", T.IntegerType()), ("pixels", T.BinaryType()), ("image_error", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in extra]])
    return rows.mapInArrow(apply, schema)


def base64_images(payloads: Column) -> Column:
    """array of (index, raw, error) of an array of base64 texts, data URLs among them; errors name the place."""

    def one(text: Column, i: Column) -> Column:
        t = trim(F.coalesce(text, F.lit("")))
        url, head = t.startswith("data:"), F.lower(F.substring_index(F.substr(t, F.lit(6)), ",", 1))
        kind = F.substring_index(head, ";", 1)
        body = F.when(url, F.regexp_replace(t, r"\A[^,]*,", "")).otherwise(t)
        raw = F.try_to_binary(body, F.lit("base64"))
        wrong = (
            F.when(t == "", "image payload must not be empty")
            .when(url & ~t.contains(","), "data URL is missing a comma separator")
            .when(url & (kind != "") & ~kind.startswith("image/"), "data URL must use an image MIME type")
            .when(url & ~F.array_contains(F.split(head, ";"), "base64"), "data URL images must be base64-encoded")
            .when(raw.isNull(), "invalid base64 image payload")
        )
        error = F.when(wrong.isNotNull(), F.concat(F.lit("images["), i.cast("string"), F.lit("]: "), wrong))
        return F.struct(i.cast("int").alias("index"), F.when(wrong.isNull(), raw).alias("raw"), error.alias("error"))

    return F.transform(payloads, one)
