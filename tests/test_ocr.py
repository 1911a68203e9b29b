import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import ocr


BOXES = "array<struct<y:int,x:int,width:int,height:int,text:string>>"


def read(spark, images):
    """(texts in reading order, merged text) of each image of (x, y, width, height, text) boxes."""
    rows = [(i, None if b is None else [{"x": x, "y": y, "width": w, "height": h, "text": t} for x, y, w, h, t in b]) for i, b in enumerate(images)]
    df = ocr.read_regions(spark.createDataFrame(rows, f"i int, b {BOXES}"), "b", "m")
    return [(None if r["b"] is None else [(b["x"], b["y"], b["width"], b["height"], b["text"]) for b in r["b"]], r["m"]) for r in sorted(df.collect(), key=lambda r: r["i"])]


def test_reading_order_by_hand(spark):
    images = [
        # one line whose right box begins 2 higher; then a line far below
        [(50, 8, 30, 20, "right"), (0, 10, 30, 20, "left"), (0, 100, 30, 20, "below")],
        # a tall box overlaps the small one by 10 of 20 pixels, though the centres are 35 apart
        [(100, 0, 20, 100, "tall"), (0, 75, 20, 20, "small")],
        # centres 12 apart fit, 13 don't
        [(9, 0, 5, 2, "a"), (1, 12, 5, 2, "b")],
        [(9, 0, 5, 2, "a"), (1, 13, 5, 2, "b")],
        # equal boxes, blank and null texts
        [(0, 0, 4, 4, " x "), (0, 0, 4, 4, None), (0, 0, 4, 4, "  "), (0, 40, 4, 4, "y")],
        [],
        None,
    ]
    got = read(spark, images)
    assert [[b[4] for b in o] if o is not None else None for o, _ in got] == [["left", "right", "below"], ["small", "tall"], ["b", "a"], ["a", "b"], [" x ", None, "  ", "y"], [], None]
    # 100 - 30 = 70 is more than 1.2 lines of 22: a blank line; 11 against lines of 2, too; 40 - 4 = 36, too
    assert [m for _, m in got] == ["left right\n\nbelow", "small tall", "b a", "a\n\nb", "x\n\ny", "", ""]


def test_a_line_break_without_a_gap(spark):
    assert read(spark, [[(0, 0, 9, 20, "a"), (0, 25, 9, 20, "b")]])[0][1] == "a\nb"


def test_reading_order_is_a_permutation_that_ignores_the_input_order(spark):
    rng = random.Random(5)
    images = []
    for i in range(40):
        places = rng.sample(range(60000), rng.randrange(1, 15))
        images.append([(p % 300, p // 300, rng.randrange(1, 80), rng.randrange(1, 30), f"{i}-{k}") for k, p in enumerate(places)])
    straight, turned = read(spark, images), read(spark, [b[::-1] for b in images])
    assert straight == turned
    for boxes, (found, merged) in zip(images, straight, strict=True):
        assert sorted(found) == sorted(boxes)
        assert merged.split() and len(merged.split()) == len(boxes)
        at = np.array([0, len(found)])
        y, h = (np.array([b[k] for b in found]) for k in (1, 3))
        in_y = np.array(sorted(range(len(found)), key=lambda k: (found[k][1], found[k][0])))
        number = np.empty(len(found), int)
        number[in_y] = ocr.band_numbers(at, y[in_y], h[in_y])[0]
        assert (np.diff(number) >= 0).all()  # bands never go back
        assert all(a[0] <= b[0] for a, b, m, n in zip(found, found[1:], number, number[1:]) if m == n)


def test_ctc(spark):
    steps = [(1, i, s) for i, s in enumerate([[0.1, 0.8, 0.1], [0.1, 0.7, 0.2], [0.9, 0.05, 0.05], [0.1, 0.6, 0.3], [0.2, 0.4, 0.4]])]
    df = spark.createDataFrame(steps, "s int, t int, p array<double>")
    r = ocr.ctc_decode(df, "s", "t", "p", ["", "a", "b"]).first()
    assert (r["text"], r["tokens"], round(r["confidence"], 6)) == ("aab", 3, 0.6)


def test_probability_map():
    p = np.zeros((8, 8))
    p[1:3, 1:4] = 0.9
    p[5:8, 5:8] = 0.6
    found = ocr.map_boxes(p, 16, 16)
    assert [(b["x"], b["y"], b["width"], b["height"]) for b in found] == [(0, 0, 10, 8), (8, 8, 8, 8)]
    assert abs(found[0]["confidence"] - 0.9) < 1e-9 and abs(found[1]["confidence"] - 0.6) < 1e-9
    assert ocr.map_boxes(np.full((4, 4), 0.1), 8, 8) == [] == ocr.map_boxes(np.zeros((0, 4)), 8, 8) == ocr.map_boxes(p, 0, 9)
    assert len(ocr.components(np.eye(5))) == 1  # corners touch


def test_probability_map_edges():
    at = np.zeros((40, 60))
    at[10:14, 5:30] = 0.3  # exactly the threshold, 25 wide: a padding of 3
    assert [(b["x"], b["y"], b["width"], b["height"]) for b in ocr.map_boxes(at, 60, 40)] == [(2, 9, 31, 6)]
    two = np.zeros((40, 60))
    two[4:10, 40:50] = two[6:12, 5:15] = 0.8  # one band: the left one first, though it begins lower
    assert [b["x"] for b in ocr.map_boxes(two, 60, 40)] == [4, 39]
    assert [(b["x"], b["width"]) for b in ocr.map_boxes(two, 7, 40)] == []  # sides under 3
    for shape in ((1, 40, 60), (40, 60, 1), (1, 1, 40, 60), (1, 40, 60, 1)):
        assert ocr.map_boxes(two.reshape(shape), 60, 40) == ocr.map_boxes(two, 60, 40)
    for shape in ((2, 20, 60), (2, 1, 20, 60), (1, 1, 1, 40, 60)):
        with pytest.raises(ValueError, match="unsupported detector output"):
            ocr.probability_map(two.reshape(shape))
    assert np.allclose(ocr.probability_map(np.array([[-4.0, 0.0], [2.0, 4.0]])), [[0.01798621, 0.5], [0.88079708, 0.98201379]])


def test_components_by_flooding():
    rng = np.random.default_rng(3)
    for _ in range(30):
        p = rng.random((rng.integers(1, 25), rng.integers(1, 25))) * rng.choice([0.5, 0.45])
        left, want = {(y, x) for y, x in zip(*np.nonzero(p >= 0.3))}, []
        while left:
            group, new = set(), {min(left)}
            while new:
                group |= new
                new = {(y + a, x + b) for y, x in new for a in (-1, 0, 1) for b in (-1, 0, 1)} & left - group
            left -= group
            ys, xs = zip(*group)
            want.append((min(xs), min(ys), max(xs), max(ys), len(group), round(sum(p[y, x] for y, x in group), 9)))
        assert sorted((*c[:5], round(c[5], 9)) for c in ocr.components(p)) == sorted(want)


def test_tensors():
    t = ocr.pack_tensor(np.full((2, 3, 3), 255, np.uint8), [0.5] * 3, [0.5] * 3)
    assert t.shape == (1, 3, 2, 3) and (t == 1).all()
    assert ocr.orient_scores(np.zeros((3, 7)), 3).shape == (7, 3)


def test_sizes(spark):
    df = spark.createDataFrame([(640, 48), (10, 480), (1920, 1080), (1, 1)], "w int, h int")
    longest = F.greatest("w", "h")
    got = [tuple(r) for r in df.select(ocr.recognition_width(F.col("w"), F.col("h")), ocr.detection_side(F.col("w"), longest), ocr.detection_side(F.col("h"), longest)).collect()]
    assert got == [(320, 640, 64), (1, 32, 480), (86, 960, 544), (48, 32, 32)]
