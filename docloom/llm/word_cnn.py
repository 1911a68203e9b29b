"""Toxicity by a convolutional network over hashed words.

A word (lower-cased run of letters and digits) is the sum of the embeddings of four features: itself, its first four and
five bytes and its last four, each a 64-bit hash.  Features in at least two documents of the fit have an embedding, found
by the hash's low bits and confirmed by all 64; the rest share a zero vector.  Filters of widths 1, 2
and 3, maximum over the whole text, logistic output; trained in numpy with Adam.  Labels, lang, source and doc_id never
reach the score.  Thresholds are calibrated for each language, after all rows are scored, on every clean row of it that
is labelled, not held out and not used by the fit: the lowest, 0.1 at least, at which floor(n * ``false_share``) of the n
are flagged or fewer.  So a language of under 1 / ``false_share`` such rows gets one above all of them.  The quantile is
exact: counts by the scores' leading bits narrow it down, in five distributed sums of a bounded size a language.

The fit sees three quarters of a sample of at most ``per_label`` documents (expected) of each label, of up to ``longest``
bytes each, and none that is held out; every whole text is scored, in blocks of bounded size.  Null and empty texts have
no word: their score is the output bias's.  Labels that are null are no labels; a document labelled twice counts as toxic
if one label says so.  Without labels the score is 0.  A null language and languages without a row to calibrate on get
0.3.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, sample_order, slices, table, utf8
from .words import words

WIDTHS, EMBED, FILTERS, PAD, BITS = (1, 2, 3), 12, 8, 2, 20
BLOCK = 8192  # words whose responses are held at a time


class Vocabulary:
    def __init__(self, known: np.ndarray):
        """known: sorted 64-bit hashes; word i has number i + 1, others 0."""
        self.known = np.concatenate([np.zeros(1, np.uint64), known])
        order = np.argsort(known & np.uint64((1 << BITS) - 1), kind="stable")
        slot = (known & np.uint64((1 << BITS) - 1)).astype(np.int64)[order]
        self.slots = np.zeros(1 << BITS, np.int32)
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        self.slots[slot[first]] = order[first] + 1
        self.rest = np.sort(known[order[~first]])  # those whose slot is taken

    def numbers(self, h: np.ndarray) -> np.ndarray:
        shape, h = h.shape, h.ravel()
        i = self.slots[(h & np.uint64((1 << BITS) - 1)).astype(np.int64)]
        miss = self.known[i] != h
        i[miss] = 0
        if len(self.rest):
            again = np.flatnonzero(miss)
            at = np.minimum(np.searchsorted(self.rest, h[again]), len(self.rest) - 1)
            again = again[self.rest[at] == h[again]]
            i[again] = np.searchsorted(self.known[1:], h[again]) + 1
        return i.reshape(shape)


def padded(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """PAD unknown words after each text, so that no filter that begins in it covers the next one."""
    n = len(at) - 1
    out = np.zeros((len(ids) + PAD * n, ids.shape[1]), np.int64)
    out[np.arange(len(ids)) + np.repeat(PAD * np.arange(n), np.diff(at))] = ids
    return out, at + PAD * np.arange(n + 1)


def pads(at: np.ndarray) -> np.ndarray:
    """Places of the unknown words that ``padded`` put in; filters that begin there count for nothing."""
    return (at[1:, None] - PAD + np.arange(PAD)).ravel()


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[np.ndarray], labels: np.ndarray, n_words: int, epochs: int = 5, batch: int = 32, rate: float = 0.02, seed: int = 11) -> dict[str, np.ndarray]:
    """texts: feature numbers by word. Both labels are drawn equally often, so that 0.5 is where they are equally likely at equal shares."""
    rng = np.random.default_rng(seed)
    model = {"embed": rng.normal(0, 0.1, (n_words + 1, EMBED)), "out": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "out0": np.zeros(1)}
    model["embed"][0] = 0
    for w in WIDTHS:
        model[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    rows = [np.flatnonzero(labels == k) for k in (0, 1)]
    if not all(map(len, rows)):
        model["out"][:] = 0
        model["out0"][0] = 6.0 if len(rows[1]) else -6.0
        return model
    steps = max(60, epochs * len(texts) // batch)
    for step in range(1, steps + 1):
        y = rng.integers(0, 2, batch)
        pick = [rng.choice(rows[k]) for k in y]
        ids, at = padded(np.concatenate([texts[i] for i in pick]).astype(np.int64), np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])]))
        ids = np.concatenate([ids, np.zeros((PAD, ids.shape[1]), np.int64)])
        x = model["embed"][ids].sum(1)
        h, where = np.zeros((batch, len(WIDTHS) * FILTERS)), np.zeros((batch, len(WIDTHS) * FILTERS), np.int64)
        for n, w in enumerate(WIDTHS):
            r = sum(x[j : len(x) - PAD + j] @ model[f"conv{w}"][j] for j in range(w))
            r[pads(at)] = 0
            for b in range(batch):
                part = slice(n * FILTERS, (n + 1) * FILTERS)
                where[b, part] = at[b] + r[at[b] : at[b + 1]].argmax(0)
                h[b, part] = r[where[b, part], np.arange(FILTERS)]
        a = np.maximum(h, 0)
        g = (sigmoid(a @ model["out"] + model["out0"][0]) - y) / batch
        grad = {k: np.zeros_like(v) for k, v in model.items()}
        grad["out"], grad["out0"] = a.T @ g + 1e-4 * model["out"], np.array([g.sum()])
        back = g[:, None] * model["out"] * (h > 0)
        for n, w in enumerate(WIDTHS):
            part = slice(n * FILTERS, (n + 1) * FILTERS)
            for j in range(w):
                word = where[:, part] + j
                grad[f"conv{w}"][j] = np.einsum("bf,bfe->ef", back[:, part], x[word])
                down = back[:, part, None] * model[f"conv{w}"][j].T[None]
                for k in range(ids.shape[1]):
                    np.add.at(grad["embed"], ids[word, k], down)
        grad["embed"][0] = 0
        for k in model:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.01 * (grad[k] ** 2 - second[k])
            model[k] -= rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


class Scorer:
    def __init__(self, known: np.ndarray, model: dict[str, np.ndarray]):
        self.words = Vocabulary(known)
        self.embed = model["embed"].astype(np.float32)
        self.filters = [np.concatenate([model[f"conv{w}"][j] for w in WIDTHS if w > j], 1).astype(np.float32) for j in range(max(WIDTHS))]
        self.out, self.out0 = model["out"].astype(np.float32), np.float32(model["out0"][0])

    def ids(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of texts given as feature numbers by word, in blocks of BLOCK words."""
        ids, at = padded(ids, at)
        top, none = np.zeros((len(at) - 1, len(self.out)), np.float32), pads(at)
        ids = np.concatenate([ids, np.zeros((PAD, ids.shape[1]), np.int64)])
        for i in range(0, len(ids) - PAD, BLOCK):
            j = min(i + BLOCK, len(ids) - PAD)
            x = self.embed[ids[i : j + PAD, 0]]
            for k in range(1, ids.shape[1]):
                x += self.embed[ids[i : j + PAD, k]]
            r = x[: j - i] @ self.filters[0]
            for k in range(1, len(self.filters)):
                r[:, k * FILTERS :] += x[k : j - i + k] @ self.filters[k]
            r[none[np.searchsorted(none, i) : np.searchsorted(none, j)] - i] = 0
            first, last = np.searchsorted(at, i, "right") - 1, np.searchsorted(at, j, "left")
            best = np.maximum.reduceat(r, np.maximum(at[first:last], i) - i, axis=0)
            top[first:last] = np.maximum(top[first:last], best)
        return sigmoid((top @ self.out + self.out0).astype(np.float64))

    def texts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        h, at = words(offsets, raw)
        return self.ids(self.words.numbers(h), at)


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labelled documents that are not held out."""
    return labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1800, longest: int = 1 << 16, least_docs: int = 2):
    """(known words, model, doc_ids that the fit used)."""
    marks = marked(labels)
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not counts:
        return np.zeros(0, np.uint64), None, []
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, per_label / n))).otherwise(share)
    marks = marks.where(sample_order(F.col("doc_id")) < share)  # 2 * per_label rows, expected
    pieces = docs.where(F.octet_length("text") <= longest).select("doc_id", "text")
    got = pieces.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic").collect()
    late = {k for i, k in enumerate(sorted({r["doc_id"] for r in got})) if i % 4 == 3}  # left to the calibration
    got = sorted((r for r in got if r["doc_id"] not in late), key=lambda r: (r["doc_id"], r["text"]))
    if not got:
        return np.zeros(0, np.uint64), None, []

    def features(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return words(np.array([0, len(raw)]), raw)[0]

    # text by text, twice: all features of the sample at once would be the driver's largest table
    seen, n = np.unique(np.concatenate([np.unique(features(r["text"])) for r in got]), return_counts=True)
    known = seen[(n >= least_docs) & (seen != 0)]
    vocabulary = Vocabulary(known)
    ids = [vocabulary.numbers(features(r["text"])) for r in got]
    return known, fit(ids, np.array([int(r["toxic"] != 0) for r in got]), len(known)), sorted({r["doc_id"] for r in got})


def calibrated(clean: DataFrame, false_share: float = 0.005) -> dict[str, float]:
    """Thresholds by language from the scores of clean rows (lang, score): the lowest, 0.1 at least, that flags floor(n * false_share) or fewer."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column(1).to_numpy() + 0.0  # no negative zero: bits order as the numbers do
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score.view(np.int64))], names=["lang", "bits"])

    bits = materialize(clean.where("lang IS NOT NULL").select("lang", "score").mapInArrow(apply, "lang string, bits bigint"), "clean")
    head, above, more = {}, 0, {}  # by language: leading bits of the quantile, rows below it still to pass
    for shift in (48, 36, 24, 12, 0):
        rows = bits
        if head:
            rows = rows.where(F.create_map(*[F.lit(x) for pair in head.items() for x in pair])[F.col("lang")] == F.shiftright("bits", above))
        found: dict[str, list[tuple[int, int]]] = {}
        for r in rows.groupBy("lang", F.shiftright("bits", shift).alias("head")).count().collect():
            found.setdefault(r["lang"], []).append((r["head"], r["count"]))
        for lang, counts in found.items():
            if lang not in head:
                more[lang] = int(sum(n for _, n in counts) * Fraction(str(false_share)))
            for head[lang], n in sorted(counts, reverse=True):
                if more[lang] < n:
                    break
                more[lang] -= n
        above = shift
    return {lang: max(float(np.nextafter(np.int64(x).view(np.float64), 2)), 0.1) for lang, x in sorted(head.items())}


_scorers: dict[int, Scorer] = {}


def score(docs: DataFrame, known: np.ndarray, model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with score (0 to 1)."""
    if "score" in keep:
        raise ValueError("column already there: score")
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(known.tobytes())
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(known, model) if model else None
        scorer = _scorers[key]
        for batch in batches:
            offsets, raw = utf8(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, 1 << 20):
                p = scorer.texts(offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]) if scorer else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(keep))], pa.array(p, pa.float64())], names=[*keep, "score"])

    return kept.mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in kept.drop("__text").dtypes] + ["score double"]))


PREDICT = 0.3


def scored(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """doc_id, lang and score of every row, and thresholds by language."""
    known, model, used = train(docs, labels)
    out = materialize(score(docs, known, model, ["doc_id", "lang"]), "scored")
    if not model:
        return out, {}
    used = docs.sparkSession.createDataFrame([(k,) for k in used], docs.select("doc_id").schema)
    unseen = marked(labels).where("toxic = 0").join(F.broadcast(used), "doc_id", "left_anti")
    return out, calibrated(out.join(unseen, "doc_id"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out, thresholds = scored(docs, table(spark, sf_dir, "labels"))
    threshold = F.lit(PREDICT)
    if thresholds:
        threshold = F.coalesce(F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("lang")], threshold)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT).cast("int").alias("predicted"),
        threshold.alias("lang_threshold"),
        (F.col("score") >= threshold).alias("lang_flag"),
    )
