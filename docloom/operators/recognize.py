"""Text recognition around engines: sizes, tensors, batches, sessions, decoding, whole images.

An engine is anything with ``run(tensor) -> array``; a recognizer's may have ``input_height``.  A task opens its engines once
and reads its images in batches; nothing is shuffled.  ``OnnxSession`` wraps a model file; ``strip_detector`` and
``strip_recognizer`` read the made-up strip writing of ``draw_strips``, so that all of this runs without a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import WHITE
from docloom.operators.ocr import LONGEST_SIDE, MAX_WIDTH, STRIDE, map_boxes, merged_texts, orient_scores, pack_tensor, reading_places
from docloom.sources.images import read_png

# Means and deviations by channel, and the height where a model leaves it open.
RECOGNITION, DETECTION = ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)), ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
HEIGHT = 48


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear between the four nearest pixels, centres aligned."""
    h, w, _ = pixels.shape
    if (w, h) == (width, height):
        return pixels

    def weights(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = weights(h, height), weights(w, width)
    p, fy, fx = pixels.astype(np.float64), fy[:, None, None], fx[None, :, None]
    top, bottom = (p[y][:, x0] * (1 - fx) + p[y][:, x1] * fx for y in (y0, y1))
    return np.floor(top * (1 - fy) + bottom * fy + 0.5).astype(np.uint8)


def _checked(pixels: np.ndarray) -> tuple[int, int]:
    if not pixels.shape[0] or not pixels.shape[1]:
        raise ValueError("image dimensions must be greater than zero")
    return pixels.shape[1], pixels.shape[0]


def for_recognition(pixels: np.ndarray, height: int = HEIGHT) -> np.ndarray:
    """Scaled to the height, 1 to MAX_WIDTH wide, black on the right up to MAX_WIDTH."""
    w, h = _checked(pixels)
    width = min(max(int(np.ceil(height * w / h)), 1), MAX_WIDTH)
    out = np.zeros((height, MAX_WIDTH, 3), np.uint8)
    out[:, :width] = resized(pixels, width, height)
    return out


def for_detection(pixels: np.ndarray) -> np.ndarray:
    """Scaled down to LONGEST_SIDE where longer, sides rounded to whole strides."""
    w, h = _checked(pixels)
    ratio = min(1.0, LONGEST_SIDE / max(w, h))
    side = lambda n: max((max(int(n * ratio), 1) + STRIDE // 2) // STRIDE, 1) * STRIDE
    return resized(pixels, side(w), side(h))


def batch_tensor(crops: Sequence[np.ndarray], height: int = HEIGHT) -> np.ndarray:
    """[N, 3, H, W] of crops."""
    if not crops:
        raise ValueError("no crops to recognize")
    return np.concatenate([pack_tensor(for_recognition(c, height), *RECOGNITION) for c in crops])


def batch_scores(output: np.ndarray, batch: int) -> list[np.ndarray]:
    """One matrix for each crop: rank 2 is a batch of one; of rank 3 the first axis as long as the batch counts crops."""
    if output.ndim == 2:
        if batch != 1:
            raise ValueError(f"rank-2 output for batch size {batch}: {list(output.shape)}")
        return [output]
    if output.ndim != 3:
        raise ValueError(f"recognizer output must have rank 2 or 3: {list(output.shape)}")
    if batch not in output.shape:
        raise ValueError(f"no axis of recognizer output {list(output.shape)} is the batch size {batch}")
    return list(np.moveaxis(output, output.shape.index(batch), 0))


def decode_scores(scores: np.ndarray, dictionary: list[str]) -> tuple[str, float]:
    """Text and mean confidence of [steps, classes] scores, turned if need be; softmax unless they are probabilities."""
    p = np.asarray(orient_scores(scores, len(dictionary)), np.float64)
    total = p.sum(1)
    if not (np.isfinite(p).all() and ((p >= -0.01) & (p <= 1.01)).all() and ((total == 0) | (np.abs(total - 1) <= 0.01)).all()):
        e = np.exp(p - p.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
    if not p.size:
        return "", 0.0
    best = p.shape[1] - 1 - p[:, ::-1].argmax(1)  # the last of equals
    new = np.concatenate([[True], best[1:] != best[:-1]]) & (best > 0) & (best < len(dictionary))
    kept = np.flatnonzero(new)
    return "".join(dictionary[best[i]] for i in kept), float(p[kept, best[kept]].mean()) if len(kept) else 0.0


def open_session(make: Callable[[str], object], providers: Sequence[str] = ("tensorrt", "cuda", "cpu")):
    """The first provider that opens; all but the last may fail in silence."""
    for provider in providers[:-1]:
        try:
            return make(provider)
        except Exception:  # noqa: BLE001, S112
            continue
    return make(providers[-1])


class OnnxSession:
    """A model file, if the runtime is installed."""

    NAMES = {"tensorrt": "TensorrtExecutionProvider", "cuda": "CUDAExecutionProvider", "cpu": "CPUExecutionProvider"}

    def __init__(self, path: str, provider: str = "cpu"):
        import onnxruntime

        if self.NAMES[provider] not in onnxruntime.get_available_providers():
            raise RuntimeError(f"{provider} isn't available")
        self.session = onnxruntime.InferenceSession(path, providers=[self.NAMES[provider]])
        given = self.session.get_inputs()[0]
        if len(given.shape) < 3:
            raise ValueError(f"model input must have at least 3 dimensions: {given.shape}")
        self.name, height = given.name, given.shape[2]
        self.input_height = height if isinstance(height, int) and height > 0 else HEIGHT

    def run(self, tensor: np.ndarray) -> np.ndarray:
        return np.asarray(self.session.run(None, {self.name: tensor.astype(np.float32)})[0])


@dataclass
class Recognizer:
    """Crops in batches of ``most``, sessions taken in turn."""

    sessions: Sequence
    dictionary: list[str]
    most: int = 16

    def __post_init__(self):
        if not self.sessions or self.most < 1:
            raise ValueError("a recognizer needs a session and a batch of one at least")
        self._turn = cycle(self.sessions)
        self.height = getattr(self.sessions[0], "input_height", HEIGHT)

    def read(self, crops: Sequence[np.ndarray]) -> list[tuple[str, float]]:
        out = []
        for i in range(0, len(crops), self.most):
            part = crops[i : i + self.most]
            output = np.asarray(next(self._turn).run(batch_tensor(part, self.height)))
            out += [decode_scores(s, self.dictionary) for s in batch_scores(output, len(part))]
        return out


def detect(session, pixels: np.ndarray) -> list[dict]:
    """Boxes in an image, in reading order."""
    w, h = _checked(pixels)
    output = np.asarray(session.run(pack_tensor(for_detection(pixels), *DETECTION)))
    return map_boxes(output, w, h)


def zipped(boxes: Sequence, results: Sequence) -> list[tuple]:
    """Boxes with their results, one for one."""
    if len(boxes) != len(results):
        raise ValueError(f"recognizer returned {len(results)} results for {len(boxes)} crops")
    return list(zip(boxes, results, strict=True))


@dataclass
class Reader:
    """A detector and a recognizer: whole images to regions and Markdown."""

    detector: object
    recognizer: Recognizer

    def read(self, pixels: np.ndarray) -> tuple[str, list[dict]]:
        h, w = pixels.shape[:2]
        boxes = []
        for b in detect(self.detector, pixels):
            x0, y0, x1, y1 = min(b["x"], w), min(b["y"], h), min(b["x"] + b["width"], w), min(b["y"] + b["height"], h)
            if x1 > x0 and y1 > y0:
                boxes.append({**b, "x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0})
        crops = [pixels[b["y"] : b["y"] + b["height"], b["x"] : b["x"] + b["width"]] for b in boxes]
        regions = [
            {**b, "confidence": min(max(b["confidence"] * c, 0.0), 1.0), "text": t.strip(WHITE)}
            for b, (t, c) in zipped(boxes, self.recognizer.read(crops) if crops else [])
            if t.strip(WHITE)
        ]
        x, y, tall = (np.array([r[k] for r in regions], np.int64) for k in ("x", "y", "height"))
        at = np.array([0, len(regions)])
        regions = [regions[i] for i in reading_places(at, x, y, tall)]
        return merged_texts(at, *(np.array([r[k] for r in regions], np.int64) for k in ("y", "height")), [r["text"] for r in regions])[0], regions


REGION = "array<struct<x:int,y:int,width:int,height:int,confidence:double,text:string>>"


def read_images(rows: DataFrame, raw: str, open_reader: Callable[[], Reader], decode=read_png) -> DataFrame:
    """``rows`` with width, height, recognized (Markdown), regions and image_error; one reader a task, images one by one."""
    place = rows.columns.index(raw)
    extra = [("width", pa.int32()), ("height", pa.int32()), ("recognized", pa.string()), ("regions", None), ("image_error", pa.string())]
    region = pa.struct([(k, pa.int32()) for k in ("x", "y", "width", "height")] + [("confidence", pa.float64()), ("text", pa.string())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            reader = reader or open_reader()
            found = []
            for body in batch.column(place):
                try:
                    p = decode(body.as_py() or b"")
                    found.append((p.shape[1], p.shape[0], *reader.read(p), None))
                except ValueError as e:
                    found.append((None, None, None, None, str(e)))
            columns = list(zip(*found, strict=True)) or [()] * len(extra)
            arrays = [pa.array(v, t or pa.list_(region)) for v, (_, t) in zip(columns, extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *[n for n, _ in extra]])

    kinds = [T.IntegerType(), T.IntegerType(), T.StringType(), None, T.StringType()]
    regions = T.ArrayType(T.StructType([T.StructField(k, T.IntegerType()) for k in ("x", "y", "width", "height")] + [T.StructField("confidence", T.DoubleType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k or regions) for (n, _), k in zip(extra, kinds, strict=True)]])
    return rows.mapInArrow(apply, schema)


# Strip writing: a line is a blue bar; a character is a green block on it whose red tells which it is.
STRIP_LETTERS = ["", *"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,-_"]
STRIP_STEP, STRIP_TALL, STRIP_GAP = 6, 48, 40


def draw_strips(lines: Sequence[str]) -> np.ndarray:
    """An image of strip writing; characters that it lacks become spaces."""
    codes = [[STRIP_LETTERS.index(c) if c in STRIP_LETTERS[1:] else STRIP_LETTERS.index(" ") for c in line] for line in lines]
    width = STRIP_STEP * max([len(c) for c in codes] + [1]) + 2 * STRIP_STEP
    out = np.zeros((-(-((STRIP_TALL + STRIP_GAP) * len(codes) + STRIP_GAP) // STRIDE) * STRIDE, -(-(width + 64) // STRIDE) * STRIDE, 3), np.uint8)
    for k, line in enumerate(codes):
        top = STRIP_GAP + k * (STRIP_TALL + STRIP_GAP)
        out[top : top + STRIP_TALL, 32 : 32 + STRIP_STEP * len(line) + STRIP_STEP, 2] = 255
        for i, c in enumerate(line):
            left = 32 + STRIP_STEP * i + STRIP_STEP // 2
            out[top : top + STRIP_TALL, left : left + STRIP_STEP - 2, 0] = 3 * c
            out[top : top + STRIP_TALL, left : left + STRIP_STEP - 2, 1] = 255
    return out


class StripDetector:
    def run(self, tensor: np.ndarray) -> np.ndarray:
        mean, std = DETECTION
        return np.clip(tensor[:, 2:3] * std[2] + mean[2], 0, 1)


class StripRecognizer:
    input_height = HEIGHT

    def run(self, tensor: np.ndarray) -> np.ndarray:
        """[N, steps, classes]: the column's character where the green is full, else the blank."""
        middle = (tensor[:, :, tensor.shape[2] // 2] * 0.5 + 0.5) * 255
        code = np.where(middle[:, 1] > 254, np.round(middle[:, 0] / 3), 0).astype(int)
        return np.eye(len(STRIP_LETTERS))[np.clip(code, 0, len(STRIP_LETTERS) - 1)]


def strip_reader() -> Reader:
    return Reader(StripDetector(), Recognizer([StripRecognizer(), StripRecognizer()], STRIP_LETTERS, 4))


def drawn(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with a PNG of the lines of ``text`` in strip writing."""
    from docloom.sources.images import write_png

    @F.arrow_udf(T.BinaryType())
    def png(texts: pa.Array) -> pa.Array:
        return pa.array([write_png(draw_strips((t or "").split("\n"))) for t in texts.to_pylist()], pa.binary())

    return rows.withColumn(name, png(F.col(text)))
