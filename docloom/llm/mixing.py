"""Mixing sources to target weights by soft membership.

A softmax regression over hashed byte 4-grams, fitted in numpy on a bounded sample of labelled rows, gives every document
posteriors over the domains.  With t tokens and posteriors p, a document taken at rate r brings r * t * p tokens to the
domains; the rates solve

    minimize  sum over domains (tokens brought - target)**2 / (2 * mass)  +  pull / 2 * sum over documents t * (r - 1)**2
    subject to 0 <= r <= most

with the pull driven towards zero, until every domain is within ``close`` of its own target (one of weight 0: of the
total).  At the solution the rates are 1 less the posteriors' product with one price a domain, cut to the bounds, so the
prices alone are sought, by Newton steps with a line search on the concave dual.  A step needs the tokens brought and a
domains-by-domains matrix from the whole corpus: distributed sums.  No table of rates is kept, and a lost executor loses
nothing.  Targets that can't be met end at the least squares, and a warning tells how far each domain is from its own.

Targets are weights of one total: ``tokens``, or else the corpus's own tokens, or what is the most that asks no domain for
more than ``most`` times its mass.  A domain without mass can't be brought and is left out of the weights.  Copies are floor(rate + u), u from the id.

The fit sees at most ``per_label`` documents (expected) of each domain, of up to 64 KB; all documents count in the sums.
Null and empty texts have no tokens; their posteriors are the domains' shares.  Null labels are no labels; a document of
two labels counts for the first by name.  Without labels there is one domain, ``all``.  An empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, materialize, restored, sample_order, shielded, slices, table, tidy, utf8
from .superminhash import _INSIDE
from .words import runs

GRAM, BITS = 4, 17
NOTHING = 1 << BITS  # the bucket of grams that would cross texts


def buckets(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The bucket of the gram at each byte."""
    n = len(raw)
    out = np.full(n, NOTHING, np.int32)
    if n < GRAM:
        return out
    x = raw.astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    code *= np.uint32(0x9E3779B1)
    out[: n - 3] = (code ^ code >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    for j in range(1, GRAM):
        out[np.maximum(offsets[1:] - j, offsets[:-1])[offsets[1:] > offsets[:-1]]] = NOTHING
    return out


def fit(texts: list[bytes], labels: np.ndarray, n_labels: int, epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by bucket, bias); domains are drawn equally often."""
    rng = np.random.default_rng(seed)
    rows = []
    for t in texts:
        b, n = np.unique(buckets(np.array([0, len(t)]), np.frombuffer(t, np.uint8)), return_counts=True)
        rows.append((b[b < NOTHING], n[b < NOTHING] / np.sqrt(max(1, len(t)))))
    w, bias = np.zeros((NOTHING + 1, n_labels)), np.zeros(n_labels)
    squares = np.full((NOTHING + 1, n_labels), 1e-4)
    each = [np.flatnonzero(labels == k) for k in range(n_labels)]
    for _ in range(max(40, epochs * len(texts) // batch)):
        for_ = rng.integers(0, n_labels, batch)
        for k in for_:
            i = rng.choice(each[k])
            b, x = rows[i]
            z = x @ w[b] + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[k] -= 1
            g = x[:, None] * p + 1e-5 * w[b]
            squares[b] += g * g
            w[b] -= rate * g / np.sqrt(squares[b])
            bias -= 0.01 * p
    return w, bias


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1000, longest: int = 1 << 16) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(domains, weights, bias with the domains' shares in it) from labels (doc_id, domain)."""
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in marks.groupBy("domain").count().collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("domain") == k, F.lit(min(1.0, per_label / n))).otherwise(share)
    got = []
    if counts:
        marks = marks.where(sample_order(F.col("doc_id")) < share)
        got = docs.where(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(marks), "doc_id").collect()
    if not got:
        return ["all"], np.zeros((NOTHING + 1, 1)), np.zeros(1)
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    names = sorted({r["domain"] for r in got})
    w, bias = fit([r["text"].encode() for r in got], np.array([names.index(r["domain"]) for r in got]), len(names))
    return names, w, bias + np.log([counts[k] / sum(counts.values()) for k in names])


def posteriors(docs: DataFrame, w: np.ndarray, bias: np.ndarray, keep: list[str], steps: Steps | None = None) -> DataFrame:
    """Columns ``keep`` with n_tokens (words) and p, an array by domain; with ``steps`` the rate, too, in the same pass."""
    if taken := {"n_tokens", "p", "rate"} & set(keep):
        raise ValueError(f"columns already there: {sorted(taken)}")
    w = w.astype(np.float32)
    kept = docs.select(*keep, F.col("text").alias("__text"))
    share = np.exp(bias) / np.exp(bias).sum()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = utf8(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, 1 << 20):
                at, part = offsets[i : j + 1] - offsets[i], raw[offsets[i] : offsets[j]]
                size = np.diff(at)
                full = np.flatnonzero(size)
                z = np.tile(bias, (j - i, 1))
                code = buckets(at, part)
                for k in range(w.shape[1] if len(full) else 0):
                    z[full, k] += np.add.reduceat(w[code, k].astype(np.float64), at[:-1][full]) / np.sqrt(size[full])
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[size == 0] = share
                starts, _ = runs(_INSIDE[part], at)
                tokens = np.diff(np.searchsorted(starts, at))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))
                rate = [pa.array(steps.rates(p)[0])] if steps else []
                columns = [*[batch.column(c).slice(i, j - i) for c in range(len(keep))], pa.array(tokens), lists, *rate]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "p", *["rate"] * len(rate)])

    fields = [f"`{n}` {t}" for n, t in kept.drop("__text").dtypes] + ["n_tokens bigint", "p array<double>"] + ["rate double"] * bool(steps)
    return kept.mapInArrow(tidy(apply), ", ".join(fields))


class Steps:
    """Where the steps have led: a price for each domain; and whether the targets are met there."""

    def __init__(self, price: np.ndarray, most: float):
        self.price, self.most, self.reached = price, most, False

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, which of them move with the prices)."""
        r = 1 - p @ self.price
        return np.clip(r, 0, self.most), (r > 0) & (r <= self.most)


def _p(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column(batch.schema.get_field_index("p"))
    return p.flatten().to_numpy().reshape(len(p), -1), batch.column(batch.schema.get_field_index("n_tokens")).to_numpy().astype(np.float64)


def brought(members: DataFrame, steps: Steps, n: int) -> np.ndarray:
    """(3 + domains, domains): mass, tokens brought, the dual's part that is a sum over documents (in its first column), and how tokens fall with prices."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3 + n, n))
        for batch in batches:
            p, t = _p(batch)
            r, free = steps.rates(p)
            total[0] += t @ p
            total[1] += (r * t) @ p
            total[2, 0] += t @ ((r - 1) ** 2 / 2 + r * (p @ steps.price))
            total[3:] += p.T @ (p * (t * free)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(3 + n), n)), pa.array(np.tile(np.arange(n), 3 + n)), pa.array(total.ravel())], names=["what", "domain", "tokens"])

    sums = members.select("n_tokens", "p").mapInArrow(apply, "what bigint, domain bigint, tokens double").groupBy("what", "domain").agg(F.sum("tokens").alias("tokens")).collect()
    out = np.zeros((3 + n, n))
    for r in sums:
        out[r["what"], r["domain"]] = r["tokens"]
    return out


def solve(members: DataFrame, domains: list[str], weights: dict[str, float], most: float, tokens: float | None = None, pull: float = 1e-3, rounds: int = 60, close: float = 1e-3) -> tuple[Steps, np.ndarray]:
    """The steps that lead to the rates, and the targets; ``pull`` is the first, ``rounds`` the most sums over the corpus."""
    n = len(domains)
    steps = Steps(np.zeros(n), most)
    sums = brought(members, steps, n)
    mass = sums[0]
    w = np.array([weights.get(k, 0.0) for k in domains]) * (mass > 0)
    if not w.sum():
        return steps, mass
    w /= w.sum()
    some = w > 0
    total = tokens if tokens is not None else float(min(mass.sum(), (most * mass[some] / w[some]).min()))
    target = total * w
    near = close * np.where(some, target, total)
    dual = lambda at, sums: sums[2, 0] - target @ at.price - pull / 2 * mass @ at.price**2
    gap, left = np.inf, rounds
    while not (reached := bool((np.abs(sums[1] - target) <= near).all())) and left:
        slope = sums[1] - target - pull * mass * steps.price
        if (np.abs(slope) <= near / 10).all():  # solved with this pull
            before, gap = gap, np.sqrt(((sums[1] - target)[mass > 0] ** 2 / mass[mass > 0]).sum())
            if gap > 0.9 * before:  # less pull doesn't help: the targets can't be met
                break
            pull /= 100
            continue
        step = np.linalg.solve(sums[3:] + np.diag(np.where(mass > 0, pull * mass, 1.0)), slope)
        share = 1.0
        while left:
            trial = Steps(steps.price + share * step, most)
            at, left = brought(members, trial, n), left - 1
            if dual(trial, at) >= dual(steps, sums) + 1e-4 * share * (slope @ step):
                steps, sums = trial, at
                break
            share /= 2
    steps.reached = reached
    if not steps.reached:
        far = ", ".join(f"{k} {got:.0f} of {want:.0f}" for k, got, want in zip(domains, sums[1], target, strict=True))
        warnings.warn(f"mixing: targets missed after {rounds - left} rounds; tokens brought: {far}", RuntimeWarning, stacklevel=2)
    return steps, target


def rated(members: DataFrame, steps: Steps) -> DataFrame:
    """``members`` with rate."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(steps.rates(_p(batch)[0])[0])], names=[*batch.schema.names, "rate"])

    return members.mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in members.dtypes] + ["rate double"]))


def copies(rate: Column, key: Column) -> Column:
    """floor(rate + u), u in [0, 1) from the id: a whole number of copies whose mean is the rate."""
    return F.floor(rate + sample_order(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))))).cast("int")


#: Share of the tokens by domain.
WEIGHTS = {"high": 0.94, "low": 0.05, "toxic": 0.01}


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id, domain: toxic, else low or high by quality."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")
    return labels.select("doc_id", kind.alias("domain"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], most: float, keep: list[str]) -> tuple[DataFrame, list[str], Steps, np.ndarray]:
    names, w, bias = train(docs, domains_of(labels))
    members = materialize(posteriors(docs, w, bias, keep), "members")
    steps, target = solve(members, names, weights, most)
    return rated(members, steps), names, steps, target


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out, names, _, _ = mixed(docs, table(spark, sf_dir, "labels"), WEIGHTS, np.inf, ["doc_id"])
    columns = [F.get("p", F.lit(k)).alias(f"p_{name}") for k, name in enumerate(names)]
    return out.select("doc_id", "n_tokens", *columns, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def stage(spark, docs, sf_dir):
    """Documents as often as their rates say, none more than once; the columns of documents."""
    names, w, bias = train(docs, domains_of(table(spark, sf_dir, "labels")))
    rows, own = shielded(docs)
    members = materialize(posteriors(docs, w, bias, ["doc_id"]), "members")
    steps, _ = solve(members, names, WEIGHTS, 1.0)
    discard(members)
    doc_id = F.col(own[docs.columns.index("doc_id")])
    out = posteriors(rows, w, bias, own, steps).withColumn("copies", copies(F.col("rate"), doc_id)).where("copies > 0")
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*restored(docs, own))
