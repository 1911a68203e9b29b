"""Language ID by a byte convolutional network.

Training (numpy, on the driver, from a bounded sample): byte embeddings, filters of widths 2, 3 and 4, maximum over the
positions of a fixed-length window, softmax.  The gradient of a maximum reaches one position for each filter, so a step
costs little more than the forward pass.

Applying (Arrow batches): a filter's response is a sum of one table entry for each byte it covers, so all widths are
read from two tables indexed by byte pairs, (i, i+1) and (i+2, i+3).  Whole texts are cut into windows of ``WINDOW``
bytes, the last padded with zero bytes; a document's distribution is the mean of its windows', weighted by their bytes.

The fit sees at most ``per_language`` documents (expected) of each label and 1,024 bytes of each; every row is scored.
Null texts and texts without a letter are ``und`` with score 0; a label nobody carries cannot be predicted; without any
label everything is ``und``.  Repeated rows get equal results, empty tables none; ids, sources and labels are not read
by the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, restored, sample_order, shielded, slices, table, tidy, utf8

WINDOW, WIDTHS, EMBED, FILTERS = 256, (2, 3, 4), 8, 16
TILE = 16  # windows at a time, so that their responses stay in cache


def fit(windows: np.ndarray, labels: np.ndarray, n_labels: int, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on softmax loss; every label is drawn equally often."""
    rng = np.random.default_rng(seed)
    model = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, n_labels)), "out0": np.zeros(n_labels)}
    for w in WIDTHS:
        model[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        model[f"conv{w}_0"] = np.zeros(FILTERS)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    rows = [np.flatnonzero(labels == k) for k in range(n_labels)]
    steps = max(60, epochs * len(labels) // batch)
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(rows[k]) for k in rng.integers(0, n_labels, batch)])
        x, y = windows[pick].copy(), labels[pick]
        for i in np.flatnonzero(rng.random(batch) < 0.3):  # short texts must work as well
            x[i, rng.integers(8, WINDOW) :] = 0
        grad = {k: np.zeros_like(v) for k, v in model.items()}
        seen, pooled, where = model["embed"][x], [], []
        for w in WIDTHS:
            r = sum(seen[:, j : WINDOW - w + 1 + j] @ model[f"conv{w}"][j] for j in range(w)) + model[f"conv{w}_0"]
            at = r.argmax(1)
            where.append(at)
            pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, 1)
        a = np.maximum(h, 0)
        z = a @ model["out"] + model["out0"]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        grad["out"], grad["out0"] = a.T @ p, p.sum(0)
        back = (p @ model["out"].T) * (h > 0)
        for n, w in enumerate(WIDTHS):
            g = back[:, n * FILTERS : (n + 1) * FILTERS]
            grad[f"conv{w}_0"] = g.sum(0)
            for j in range(w):
                at = np.take_along_axis(x, where[n] + j, 1)
                grad[f"conv{w}"][j] = np.einsum("bf,bfe->ef", g, model["embed"][at])
                np.add.at(grad["embed"], at, g[:, :, None] * model[f"conv{w}"][j].T[None])
        for k in model:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.001 * (grad[k] ** 2 - second[k])
            model[k] -= rate * (1 - 0.9 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


class Scorer:
    """Distributions of whole texts, from the two byte-pair tables."""

    def __init__(self, model: dict[str, np.ndarray]):
        part = {w: [(model["embed"] @ model[f"conv{w}"][j]).astype(np.float32) for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self.near = np.concatenate([pair(part[w][0] + model[f"conv{w}_0"].astype(np.float32), part[w][1]) for w in WIDTHS], 1)
        self.far = np.concatenate([pair(part[3][2], np.zeros_like(part[3][2])), pair(part[4][2], part[4][3])], 1)
        self.out, self.out0 = model["out"].astype(np.float32), model["out0"].astype(np.float32)

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Softmax of rows of WINDOW bytes."""
        n = WINDOW - max(WIDTHS) + 1  # windows end in the same place for all widths
        p = np.empty((len(x), len(self.out0)), np.float32)
        near, far = np.empty((TILE * n, self.near.shape[1]), np.float32), np.empty((TILE * n, self.far.shape[1]), np.float32)
        for i in range(0, len(x), TILE):
            b = x[i : i + TILE].astype(np.intp)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            r, more = near[: len(b) * n], far[: len(b) * n]
            np.take(self.near, pairs[:, :n].ravel(), 0, r, "clip")
            np.take(self.far, pairs[:, 2 : n + 2].ravel(), 0, more, "clip")
            r[:, FILTERS:] += more
            z = np.maximum(r.reshape(len(b), n, -1).max(1), 0) @ self.out + self.out0
            z = np.exp(z - z.max(1, keepdims=True))
            p[i : i + TILE] = z / z.sum(1, keepdims=True)
        return p

    def texts(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """(texts, labels) means over each text's windows; zeros for empty texts."""
        sizes = np.diff(offsets)
        count = -(-sizes // WINDOW)
        start = np.concatenate([[0], np.cumsum(count)])
        x = np.zeros(start[-1] * WINDOW, np.uint8)
        x[np.arange(len(raw)) + np.repeat(start[:-1] * WINDOW - offsets[:-1], sizes)] = raw
        p = self.windows(x.reshape(-1, WINDOW)).astype(np.float64)
        inside = np.arange(start[-1]) - np.repeat(start[:-1], count)
        p *= np.minimum(WINDOW, np.repeat(sizes, count) - inside * WINDOW)[:, None]
        full = np.flatnonzero(count)
        out = np.zeros((len(sizes), p.shape[1]))
        if len(full):
            out[full] = np.add.reduceat(p, start[:-1][full], axis=0) / sizes[full, None]
        return out


def has_letter(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    low = raw | 32
    n = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = n[offsets[1:]] > n[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def cut(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Training windows of the sampled pieces."""
    x, y = [], []
    for text, label in zip(texts, labels, strict=True):
        for i in range(0, len(text), WINDOW):
            if len(piece := text[i : i + WINDOW]) >= 16 or not i:
                x.append(np.frombuffer(piece.ljust(WINDOW, b"\0"), np.uint8))
                y.append(label)
    return np.array(x).reshape(-1, WINDOW), np.array(y, dtype=np.int64)


def train(docs: DataFrame, per_language: int = 600, most_languages: int = 256) -> tuple[list[str], dict[str, np.ndarray]]:
    """Labels and model, from rows that are not held out and whose lang is not null.

    The fit sees 1,024 bytes of about ``per_language`` documents of each of the ``most_languages`` most frequent languages
    (ties by name).  Rarer ones aren't learned: their texts get the learned language that they are likest."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect())
    if not counts:
        return [], {}
    share = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_language / n))])
    raw = F.col("text").cast("binary")
    at = (sample_order(F.concat(F.lit("at:"), F.col("doc_id").cast("string"))) * F.greatest(F.octet_length(raw) - 1024, F.lit(1))).cast("int")
    sample = rows.where((sample_order(F.col("doc_id")) < F.coalesce(share[F.col("lang")], F.lit(0.0))) & (F.octet_length(raw) > 0))
    got = sample.select("lang", F.substring(raw, at + 1, F.lit(1024)).alias("piece"), "doc_id").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], bytes(r["piece"])))
    langs = sorted({r["lang"] for r in got})
    if not langs:
        return [], {}
    x, y = cut([bytes(r["piece"]) for r in got], [langs.index(r["lang"]) for r in got])
    return langs, fit(x, y, len(langs))


_scorers: dict[bytes, Scorer] = {}


def identify(docs: DataFrame, langs: list[str], model: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score."""
    if taken := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns already there: {sorted(taken)}")
    names = np.array([*langs, "und"], dtype=object)
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = b"".join(v.tobytes()[:64] for v in model.values())
        scorer = _scorers.get(key) or (Scorer(model) if langs else None)
        _scorers.clear()
        _scorers[key] = scorer
        for batch in batches:
            offsets, raw = utf8(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, 1 << 20):
                at, part = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
                letters = has_letter(at, part)
                if scorer:
                    p = scorer.texts(at, part)
                    best = np.where(letters, p.argmax(1), len(langs))
                    score = np.where(letters, np.clip(p.max(1), 0.0, 1.0), 0.0)
                else:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                columns = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([f"`{n}` {t}" for n, t in kept.drop("__text").dtypes] + ["lang_pred string", "score double"])
    return kept.mapInArrow(tidy(apply), schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, model = train(docs)
    out = identify(docs, langs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: A document below this posterior, or without a letter, isn't in a known language.
LEAST_SCORE = 0.4


def stage(spark, docs, sf_dir):
    """Documents in a language that the network knows; the columns of documents."""
    langs, model = train(docs)
    rows, names = shielded(docs)
    out = identify(rows, langs, model, names)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*restored(docs, names))
