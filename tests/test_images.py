import base64
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import recognize as R
from docloom.sources import images as I


def png(pixels, depth=8, colour=2, filters=(0,), palette=None, interlaced=False):
    """A PNG of any kind, written plainly; ``filters`` take turns."""
    h, w, n = pixels.shape
    step = max(1, n * depth // 8)

    def packed(part):
        if depth == 16:
            return np.stack([part, part], -1).reshape(len(part), -1)
        if depth == 8:
            return part.reshape(len(part), -1)
        bits = (part.reshape(len(part), -1, 1) >> np.arange(depth - 1, -1, -1)) & 1
        return np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1)

    def filtered(lines):
        out, above = b"", [0] * lines.shape[1]
        for r, line in enumerate(lines.tolist()):
            kind = filters[r % len(filters)]
            row = []
            for i, v in enumerate(line):
                a, b, c = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                row.append((v - [0, a, b, (a + b) // 2, paeth, 0, 0, 0][kind]) % 256)
            out, above = out + bytes([kind, *row]), line
        return out

    passes = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if interlaced else [(0, 0, 1, 1)]
    body = b"".join(filtered(packed(part)) for x, y, dx, dy in passes if (part := pixels[y::dy, x::dx]).size)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, int(interlaced)))
    return out + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def test_png_of_all_kinds():
    rng = np.random.default_rng(1)
    for interlaced in (False, True):
        for filters in ((0,), (1, 2), (3, 4), (4, 1, 0, 2, 3)):
            rgb = rng.integers(0, 256, (11, 13, 3), dtype=np.uint8)
            assert (I.read_png(png(rgb, filters=filters, interlaced=interlaced)) == rgb).all()
            assert (I.read_png(png(rgb, 16, filters=filters, interlaced=interlaced)) == rgb).all()
            alpha = np.concatenate([rgb, rgb[:, :, :1]], 2)
            assert (I.read_png(png(alpha, colour=6, filters=filters, interlaced=interlaced)) == rgb).all()
            gray = rgb[:, :, :2]
            assert (I.read_png(png(gray, colour=4, filters=filters, interlaced=interlaced)) == gray[:, :, :1]).all()
        for depth in (1, 2, 4, 8):
            few = rng.integers(0, 1 << depth, (9, 10, 1), dtype=np.uint8)
            assert (I.read_png(png(few, depth, 0, interlaced=interlaced)) == few.astype(int) * 255 // ((1 << depth) - 1)).all()
            palette = rng.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
            assert (I.read_png(png(few, depth, 3, palette=palette, interlaced=interlaced)) == palette[few[:, :, 0]]).all()
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (I.read_png(I.write_png(image)) == image).all()
    whole = I.write_png(image)
    for bad in (b"", b"GIF89a", whole[:40], whole[:50] + b"\0" + whole[51:], png(image, filters=(7,))):
        with pytest.raises(ValueError):
            I.read_png(bad)


def test_decode_images(spark):
    good = I.write_png(np.full((3, 4, 3), 9, np.uint8))
    rows = I.decode_images(spark.createDataFrame([(1, good), (2, b"x"), (3, None)], "id int, b binary"), "b").orderBy("id").collect()
    assert [(r["width"], r["height"], r["pixels"] and len(r["pixels"]), r["image_error"]) for r in rows] == [(4, 3, 36, None), (None, None, None, "not a PNG"), (None, None, None, "not a PNG")]


def test_base64_errors_name_their_place(spark):
    given = ["aGk=", " aGk ", "data:image/png;base64,aGk=", "data:;base64,aGk", "", "data:image/png", "data:text/plain;base64,aGk=", "data:image/png,aGk=", "!!", None]
    got = spark.createDataFrame([(given,)], "p array<string>").select(F.inline(I.base64_images(F.col("p")))).collect()
    assert [bytes(r["raw"]) if r["raw"] is not None else None for r in got] == [b"hi"] * 4 + [None] * 6
    wrong = ["image payload must not be empty", "data URL is missing a comma separator", "data URL must use an image MIME type", "data URL images must be base64-encoded", "invalid base64 image payload", "image payload must not be empty"]
    assert [r["error"] for r in got] == [None] * 4 + [f"images[{4 + k}]: {w}" for k, w in enumerate(wrong)]
    assert base64.b64decode(given[0]) == b"hi"


def test_sizes_and_tensors():
    image = np.full((10, 20, 3), (255, 0, 0), np.uint8)
    out = R.for_recognition(image, 48)
    assert out.shape == (48, 320, 3) and (out[:, :96] == (255, 0, 0)).all() and not out[:, 96:].any()
    assert R.for_recognition(np.zeros((10, 2000, 3), np.uint8)).shape == (48, 320, 3)
    assert R.for_detection(np.zeros((1080, 1920, 3), np.uint8)).shape == (544, 960, 3) and R.for_detection(np.zeros((1, 1, 3), np.uint8)).shape == (32, 32, 3)
    t = R.batch_tensor([image, image])
    assert t.shape == (2, 3, 48, 320) and t[0, 0, 0, 0] == 1 and t[0, 1, 0, 0] == -1 and t[1, 2, 5, 319] == -1
    half = R.resized(np.array([[[0, 0, 0], [100, 200, 40]]], np.uint8), 4, 1)
    assert half[0].tolist() == [[0, 0, 0], [25, 50, 10], [75, 150, 30], [100, 200, 40]]
    for bad in (lambda: R.for_detection(np.zeros((0, 4, 3))), lambda: R.batch_tensor([])):
        with pytest.raises(ValueError):
            bad()


def test_batch_outputs():
    two = np.arange(6.0).reshape(2, 3)
    assert len(R.batch_scores(two, 1)) == 1
    for shape, n in (((4, 5, 6), 4), ((5, 4, 6), 4), ((5, 6, 4), 4), ((4, 4, 6), 4)):
        x = np.random.default_rng(2).random(shape)
        parts = R.batch_scores(x, n)
        assert len(parts) == n and (parts[1] == np.take(x, 1, axis=shape.index(n))).all()
    for shape, n in (((2, 3), 2), ((3, 4, 5), 7), ((1, 2, 3, 4), 1), ((3,), 3)):
        with pytest.raises(ValueError):
            R.batch_scores(np.zeros(shape), n)
    probabilities = np.array([[0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.9, 0.05, 0.05], [0.1, 0.6, 0.3], [0.2, 0.4, 0.4]])
    text, confidence = R.decode_scores(probabilities, ["", "a", "b"])
    assert text == "aab" and abs(confidence - 0.6) < 1e-9
    logits = np.array([[0.0, 10.0, 0.0], [0.0, 0.0, 10.0]])
    assert R.decode_scores(logits, ["", "a", "b"])[0] == "ab" and R.decode_scores(np.zeros((3, 9)).T[:, :3], ["", "a", "b"])[0] in ("", "b")
    with pytest.raises(ValueError, match="3 results for 2 crops"):
        R.zipped([1, 2], [1, 2, 3])


def test_sessions():
    class Counting(R.StripRecognizer):
        def __init__(self):
            self.sizes = []

        def run(self, tensor):
            self.sizes.append(len(tensor))
            return super().run(tensor)

    pool = [Counting(), Counting()]
    crops = [R.draw_strips([f"line {k}"])[40:88, 32:] for k in range(9)]
    assert [t for t, _ in R.Recognizer(pool, R.STRIP_LETTERS, 2).read(crops)] == [f"line {k}" for k in range(9)]
    assert [s.sizes for s in pool] == [[2, 2, 1], [2, 2]]
    opened = []

    def make(provider):
        opened.append(provider)
        if provider != "cpu":
            raise RuntimeError(provider)
        return provider

    assert R.open_session(make) == "cpu" and opened == ["tensorrt", "cuda", "cpu"]
    with pytest.raises(RuntimeError):
        R.open_session(make, ["cuda"])
    with pytest.raises(ValueError):
        R.Recognizer([], [""])


def test_whole_images(spark):
    lines = ["First line, of 3.", "second - LINE", "and the last"]
    rows = [(1, I.write_png(R.draw_strips(lines))), (2, I.write_png(np.zeros((40, 40, 3), np.uint8))), (3, b"no image")]
    got = R.read_images(spark.createDataFrame(rows, "id int, b binary"), "b", R.strip_reader).orderBy("id").collect()
    assert got[0]["recognized"].split() == " ".join(lines).split() and [r["text"] for r in got[0]["regions"]] == lines
    assert all(0.9 < r["confidence"] <= 1 for r in got[0]["regions"])
    assert (got[1]["recognized"], got[1]["regions"], got[1]["image_error"]) == ("", [], None)
    assert (got[2]["recognized"], got[2]["image_error"]) == (None, "not a PNG")
