"""What stands around text recognition: score matrices, boxes, reading order, image sizes, probability maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import WHITE

# Recognition and detection sizes, thresholds of probability maps.
MAX_WIDTH, LONGEST_SIDE, STRIDE, THRESHOLD, LEAST_SIDE, PADDING = 320, 960, 32, 0.3, 3, 0.1


def softmax(scores: Column) -> Column:
    """Shifted by the largest score."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def looks_like_probabilities(scores: Column) -> Column:
    """Finite, within [-0.01, 1.01], and of sum 0 or within 0.01 of 1."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return F.forall(scores, lambda x: ~F.isnan(x) & x.between(-0.01, 1.01)) & ((total == 0) | (F.abs(total - 1.0) <= 0.01))


def argmax_last(scores: Column) -> Column:
    """Index of the largest, the last of equals."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")


def ctc_decode(steps: DataFrame, sequence: str, step: str, scores: str, dictionary: list[str]) -> DataFrame:
    """sequence, text, tokens, confidence: best token a step, repeats of the step before and blanks (0) dropped."""
    index = argmax_last(F.col(scores))
    rows = steps.select(sequence, step, index.alias("index"), F.array_max(scores).alias("p"))
    rows = rows.withColumn("before", F.lag("index").over(Window.partitionBy(sequence).orderBy(step)))
    kept = (F.col("index") != F.coalesce("before", F.lit(-1))) & (F.col("index") > 0) & (F.col("index") < len(dictionary))
    token = F.get(F.array(*[F.lit(t) for t in dictionary]), F.col("index"))
    rows = rows.select(sequence, step, F.when(kept, token).alias("token"), F.when(kept, F.col("p")).alias("p"))
    text = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct(step, "token"))))
    out = rows.groupBy(sequence).agg(text.alias("t"), F.count("token").alias("tokens"), F.coalesce(F.avg("p"), F.lit(0.0)).alias("confidence"))
    return out.select(sequence, F.array_join(F.transform("t", lambda x: x["token"]), "").alias("text"), "tokens", "confidence")


def batch_slices(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """``rows`` with batch: consecutive slices of at most ``most``."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("batch", F.floor((n - 1) / most).cast("int"))


def recognition_width(width: Column, height: Column, target: int = 48) -> Column:
    return F.least(F.greatest(F.ceil(F.lit(float(target)) * width / height), F.lit(1)), F.lit(MAX_WIDTH)).cast("int")


def detection_side(side: Column, longest: Column) -> Column:
    ratio = F.when(longest > LONGEST_SIDE, F.lit(float(LONGEST_SIDE)) / longest).otherwise(F.lit(1.0))
    floor = F.greatest(F.floor(side * ratio), F.lit(1))
    return (F.greatest(F.floor((floor + STRIDE // 2) / STRIDE), F.lit(1)) * STRIDE).cast("int")


def clamp_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes cut to the image; those with nothing left go."""
    x0, y0 = F.least("x", width), F.least("y", height)
    x1, y1 = F.least(F.col("x") + F.col("width"), width), F.least(F.col("y") + F.col("height"), height)
    out = boxes.withColumns({"x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0})
    return out.where((F.col("width") > 0) & (F.col("height") > 0))


def region_confidence(box: Column, text: Column) -> Column:
    return F.least(F.greatest(box * text, F.lit(0.0)), F.lit(1.0))


def band_numbers(at: np.ndarray, y: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band of each box, counted from 0 in its image, and the band's top and bottom as it stands after the box.

    ``at``: where each image's boxes begin, with the end; boxes in the order they count in.  A box joins the band before it
    if its centre or its overlap fits, and moves the band's centre and height half way to its own.  Each decision depends on
    the one before, so all images take their first box together, then their second, and so on."""
    n = np.diff(at)
    most_first = np.argsort(-n, kind="stable")
    sizes = -n[most_first]
    number, top_of, bottom_of = np.zeros(len(y), np.int64), np.zeros(len(y)), np.zeros(len(y))
    top, bottom, centre, tall = (np.zeros(len(n)) for _ in range(4))
    band = np.full(len(n), -1, np.int64)
    for k in range(int(n.max(initial=0))):
        i = most_first[: np.searchsorted(sizes, -k)]  # images with more than k boxes
        box = at[i] + k
        y0, h = y[box].astype(float), height[box].astype(float)
        y1, c = y0 + h, y0 + h / 2
        low = np.minimum(h, bottom[i] - top[i])
        share = np.maximum(np.minimum(y1, bottom[i]) - np.maximum(y0, top[i]), 0) / np.where(low == 0, np.inf, low)
        joins = (band[i] >= 0) & ((np.abs(c - centre[i]) <= np.maximum(np.maximum(tall[i], h) * 0.6, 12.0)) | (share >= 0.35))
        top[i] = np.where(joins, np.minimum(top[i], y0), y0)
        bottom[i] = np.where(joins, np.maximum(bottom[i], y1), y1)
        centre[i] = np.where(joins, (centre[i] + c) / 2, c)
        tall[i] = np.where(joins, (tall[i] + h) / 2, h)
        band[i] += ~joins
        number[box], top_of[box], bottom_of[box] = band[i], top[i], bottom[i]
    return number, top_of, bottom_of


def reading_places(at: np.ndarray, x: np.ndarray, y: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Positions of the boxes of all images in reading order: bands from the top, in each from the left."""
    image = np.repeat(np.arange(len(at) - 1), np.diff(at))
    down = np.lexsort((x, y, image))
    band = band_numbers(at, y[down], height[down])[0]
    return down[np.lexsort((y[down], x[down], band, image))]


def merged_texts(at: np.ndarray, y: np.ndarray, height: np.ndarray, texts: list[str | None]) -> list[str]:
    """The text of each image's regions, in the order given: bands are lines, wide gaps blank lines."""
    band, top, bottom = band_numbers(at, y, height)
    out = []
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        text, before = "", None
        while begin < end:
            after = begin + int(np.searchsorted(band[begin:end], band[begin], side="right"))
            words = [t for r in texts[begin:after] if (t := (r or "").strip(WHITE))]
            if words:
                line = (top[after - 1], bottom[after - 1])
                if before:
                    text += "\n\n" if max(line[0] - before[1], 0) > max(before[1] - before[0], line[1] - line[0]) * 1.2 else "\n"
                text, before = text + " ".join(words), line
            begin = after
        out.append(text)
    return out


def read_regions(images: DataFrame, boxes: str, merged: str | None = None) -> DataFrame:
    """``images`` with the array ``boxes`` (structs with x, y, height) in reading order and, if asked for, ``merged``: the
    regions' texts as Markdown.  Null arrays stay null, null texts are empty."""
    place = images.columns.index(boxes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(place)
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            flat = lists.flatten()
            x, y, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y", "height"))
            order = reading_places(at, x, y, h)
            flat = flat.take(pa.array(order))
            new = pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat, mask=lists.is_null())
            columns = [new.cast(lists.type) if k == place else batch.column(k) for k in range(batch.num_columns)]
            if merged:
                columns.append(pa.array(merged_texts(at, y[order], h[order], flat.field("text").to_pylist()), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *[merged] * bool(merged)])

    schema = T.StructType([*images.schema.fields, *([T.StructField(merged, T.StringType())] if merged else [])])
    return images.mapInArrow(apply, schema)


def components(p: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, int, float]]:
    """(x0, y0, x1, y1, pixels, sum) of the 8-connected regions at the threshold or above it, by their first pixels: runs of
    a row joined with the runs of the row before that they touch."""
    inside = np.zeros((p.shape[0], p.shape[1] + 2), np.int8)
    inside[:, 1:-1] = p >= threshold
    change = np.diff(inside, axis=1)
    (row, begin), (_, end) = np.nonzero(change == 1), np.nonzero(change == -1)
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    first = np.searchsorted(row, np.arange(p.shape[0] + 1))
    for r in range(1, p.shape[0]):
        above, own = slice(first[r - 1], first[r]), slice(first[r], first[r + 1])
        lo = np.searchsorted(end[above], begin[own], side="left") + first[r - 1]  # ends are exclusive, so corners touch
        hi = np.searchsorted(begin[above], end[own], side="right") + first[r - 1]
        for i, (j, k) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True), int(first[r])):
            for m in range(j, k):
                a, b = sorted((root(i), root(m)))
                parent[b] = a
    label = np.array([root(i) for i in range(len(row))], np.int64)
    names, label = np.unique(label, return_inverse=True)
    total = np.concatenate([np.zeros((p.shape[0], 1)), np.cumsum(p, axis=1)], axis=1)
    out = [np.full(len(names), p.size), np.full(len(names), p.size), np.full(len(names), -1), np.full(len(names), -1)]
    for ufunc, target, value in ((np.minimum, out[0], begin), (np.minimum, out[1], row), (np.maximum, out[2], end - 1), (np.maximum, out[3], row)):
        ufunc.at(target, label, value)
    pixels, sums = np.bincount(label, end - begin, len(names)), np.bincount(label, total[row, end] - total[row, begin], len(names))
    return list(zip(*[x.tolist() for x in out], pixels.astype(int).tolist(), sums.tolist(), strict=True))


def probability_map(values: np.ndarray) -> np.ndarray:
    """[H, W] of a detector's output: [H, W], [1, H, W], [H, W, 1], [1, 1, H, W] or [1, H, W, 1]; logits become probabilities."""
    p = np.asarray(values, np.float64)
    if ((p < 0) | (p > 1)).any():
        p = 1 / (1 + np.exp(-p))
    shape = p.shape
    if p.ndim == 4 and shape[0] == 1:
        p = p[0]
    if p.ndim == 3 and p.shape[0] == 1:
        p = p[0]
    elif p.ndim == 3 and p.shape[2] == 1:
        p = p[:, :, 0]
    if p.ndim != 2:
        raise ValueError(f"unsupported detector output shape: {list(shape)}")
    return p


def map_boxes(p: np.ndarray, width: int, height: int) -> list[dict]:
    """Boxes of a probability map (or logits) scaled to an image: padded a tenth, sides of 3 or more, in reading order."""
    p = probability_map(p)
    h, w = p.shape
    if not (h and w and width and height):
        return []
    out = []
    for x0, y0, x1, y1, n, total in components(p):
        if n < max(4, w * h // 100_000):
            continue
        bw, bh = x1 - x0 + 1, y1 - y0 + 1
        confidence = min(max(total / n * (n / (bw * bh)) ** 0.5, 0.0), 1.0)
        px, py = (max(1, int(side * PADDING + 0.5)) for side in (bw, bh))
        a, b = max(0, x0 - px), max(0, y0 - py)
        c, d = min(w, x1 + 1 + px), min(h, y1 + 1 + py)
        left, top = a * width // w, b * height // h
        right, bottom = min(-(-c * width // w), width), min(-(-d * height // h), height)
        if right - left >= LEAST_SIDE and bottom - top >= LEAST_SIDE:
            out.append({"x": left, "y": top, "width": right - left, "height": bottom - top, "confidence": confidence})
    x, y, tall = (np.array([b[k] for b in out], np.int64) for k in ("x", "y", "height"))
    return [out[i] for i in reading_places(np.array([0, len(out)]), x, y, tall)]


def detect(maps: DataFrame, key: str) -> DataFrame:
    """key, x, y, width, height, confidence of maps (values array<double>, rows, cols, width, height)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{key: r[key], **b} for r in batch.to_pylist() for b in map_boxes(np.array(r["values"]).reshape(r["rows"], r["cols"]), r["width"], r["height"])]
            kind = pa.schema([(key, batch.schema.field(key).type), *[(k, pa.int64()) for k in ("x", "y", "width", "height")], ("confidence", pa.float64())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return maps.mapInArrow(apply, f"`{key}` {dict(maps.dtypes)[key]}, x bigint, y bigint, width bigint, height bigint, confidence double")


def pack_tensor(pixels: np.ndarray, mean, std) -> np.ndarray:
    """[H, W, 3] bytes to [1, 3, H, W] floats, scaled and shifted by channel."""
    x = (np.asarray(pixels, np.float32) / 255 - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None])


def orient_scores(scores: np.ndarray, classes: int) -> np.ndarray:
    """[steps, classes]: turned if only the first axis has as many as there are classes."""
    return scores.T if scores.shape[0] == classes and scores.shape[1] != classes else scores
