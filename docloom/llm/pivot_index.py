"""Approximate nearest neighbours by a permutation index (largest inner product).

1. Pivots are a bounded sample of the rows; every row is represented by its ``PREFIX`` nearest pivots, nearest first.
2. A pivot's inverted file lists the rows that have it in one of their first ``COPIES`` places; it holds their whole prefixes
   and their vectors.  Files are cut into slices of about ``SLICE`` rows, dealt out once.
3. A query goes to the files of its own ``READ`` of all pivots, nearest first, and to no others.  A row that is in several of
   them counts in the first.  Files stay with their task while queries stream by; nothing is rebuilt for a query.
4. Rows rank by the footrule distance of the prefixes, which is a constant less twice the sum over shared pivots of (PREFIX -
   the later of the two places).  Those at least as near as the ``SHARE`` nearest of a bounded sample of the rows would be
   are reranked by the inner product in double precision.  A task returns ``k`` rows a query at most, and only those that
   score as high as the query's k-th best row of the sample, of those that the query's files show it; a window takes the best.

Pivots: a sixteenth of the rows, 16 to ``PIVOTS``.  The sample that a query's bound comes from has ``SAMPLE`` rows at most;
the share is ``LEAST * k`` rows at least, and ``LEAST_READ`` files are read at least.

Null vectors, zero vectors, vectors with null or non-finite components, and those of another than the commonest length (the
shorter of equals) take no part.  Rows that repeat a vec_id count once, with the least vector.  Fewer than k candidates:
all that the query's files hold.  Equal scores go by vec_id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_order, table, utf8

PIVOTS, PREFIX, COPIES, READ, SHARE = 512, 64, 4, 0.16, 0.1
SLICE, SAMPLE, HELD, LEAST, LEAST_READ = 1 << 16, 2048, 1 << 20, 24, 48


def usable(vector: Column) -> Column:
    """Not null, not zero, and finite in all components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def order_of(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties by number."""
    return np.argsort(-(x @ pivots.T), 1, kind="stable")[:, :length].astype(np.uint16)


def nearness(order: np.ndarray, pivots: int) -> np.ndarray:
    """(pivots, rows): the prefix's length less the place that a row gives a pivot, 0 if none."""
    rows, length = order.shape
    out = np.zeros((pivots, rows), np.uint8)
    out[order, np.arange(rows)[:, None]] = np.arange(length, 0, -1, dtype=np.uint8)
    return out


def agreement(order: np.ndarray, near: np.ndarray) -> np.ndarray:
    """How near each row's order is to one query's: larger for a smaller footrule distance."""
    total = np.zeros(near.shape[1], np.uint16)
    for p, left in zip(order.tolist(), range(len(order), 0, -1), strict=True):
        total += np.minimum(near[p], np.uint8(left))
    return total


def best_of(who: np.ndarray, what: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, ties to the smaller id."""
    order = np.lexsort((what, -score, who))
    first = np.searchsorted(who[order], who[order])
    return order[np.arange(len(order)) - first < k]


class File:
    """A slice of one pivot's inverted file, and the search in it."""

    def __init__(self, pivot: int, ids: np.ndarray, x: np.ndarray, order: np.ndarray, pivots: int):
        self.pivot, self.ids, self.x, self.pivots = pivot, ids, x, pivots
        self.heads, self.near = order[:, :COPIES], nearness(order, pivots)

    def search(self, q: np.ndarray, order: np.ndarray, read: int, me: int, bound: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that this file is the first to show to the query, without scores under ``floor``."""
        place = np.full(self.pivots, read, np.int64)
        place[order[:read]] = np.arange(read)
        fresh = place[self.heads].min(1) == place[self.pivot]
        rows = np.flatnonzero(fresh & (agreement(order[:PREFIX], self.near) >= bound) & (self.ids != me))
        if len(rows):
            rough = self.x[rows] @ q  # may differ in its last bits between equal vectors
            least = max(floor, np.partition(rough, len(rows) - k)[len(rows) - k] if len(rows) > k else floor)
            rows = rows[rough >= least - slack(self.x[rows], q)]
        score = (self.x[rows] * q).sum(1)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def slack(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """More than rounding can change in the products of the rows with ``q``."""
    return 1e-12 * (np.abs(x) @ np.abs(q))


def floor_of(q: np.ndarray, sample: np.ndarray, shown: np.ndarray, k: int) -> float:
    """A score that k of the rows of the sample that the query is shown reach: none below is among the k best."""
    if len(rows := np.flatnonzero(shown)) < k:
        return -np.inf
    lower = sample[rows] @ q - slack(sample[rows], q)
    return float(np.partition(lower, len(rows) - k)[len(rows) - k])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: the k best found of each query among the other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"))
    commonest = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if commonest is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {key} bigint, score double")
    size, n = commonest
    rows = rows.where(F.size("x") == size)
    taken = rows.orderBy(sample_order(F.col("id")), "id").limit(SAMPLE).collect()
    named, sample = np.array([r["id"] for r in taken], np.int64), np.array([r["x"] for r in taken])
    pivots = sample[: min(len(sample), max(16, min(PIVOTS, n // 16)))]
    count, length, read = len(pivots), min(PREFIX, len(pivots)), min(len(pivots), max(LEAST_READ, int(np.ceil(READ * len(pivots)))))
    share = min(1.0, max(SHARE, LEAST * k / n))
    wide = max(length, read)
    # the sample's own rows are filed by these orders, so that all tasks know alike which of them a query is shown
    orders, at_id = order_of(sample, pivots, wide), {int(v): i for i, v in enumerate(named)}

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for every file it is in, and each query once for every file it reads."""
        known, heads = nearness(orders[:, :length], count), orders[:, :COPIES]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, size)
                order, ids, asks = order_of(x, pivots, wide), part.column(0).to_numpy(), part.column(2).to_numpy(zero_copy_only=False)
                for i, v in enumerate(ids.tolist()):
                    if v in at_id:
                        order[i] = orders[at_id[v]]
                ask = np.flatnonzero(asks)
                bound, floor = np.zeros(len(ask), np.int32), np.zeros(len(ask))
                for j, i in enumerate(ask):
                    near = agreement(order[i, :length], known)
                    bound[j] = np.sort(near)[-max(1, int(np.ceil(share * len(sample))))]
                    reads = np.isin(np.arange(count), order[i, :read])
                    floor[j] = floor_of(x[i], sample, (near >= bound[j]) & reads[heads].any(1) & (named != ids[i]), k)
                raw, prefix = ([r.tobytes() for r in a] for a in (x, order))
                every = np.arange(part.num_rows)
                for who, files, bounds, floors in ((every, order[:, :COPIES], np.full(len(every), -1, np.int32), np.zeros(len(every))), (ask, order[ask, :read], bound, floor)):
                    each = np.repeat(who, files.shape[1])
                    columns = [pa.array(files.ravel().astype(np.int32)), *[pa.array(np.repeat(v, files.shape[1])) for v in (bounds, floors)], pa.array(ids[each])]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array([v[i] for i in each], pa.binary()) for v in (raw, prefix)]], names=["file", "bound", "floor", "id", "x", "prefix"])

    asks = is_query if isinstance(is_query, Column) else F.expr(is_query)
    marked = rows.withColumn(key, F.col("id")).select("id", "x", F.coalesce(asks, F.lit(False)).alias("asks"))
    posts = marked.mapInArrow(posted, "file int, bound int, floor double, id bigint, x binary, prefix binary")
    # slices of a file by its length, known within a few percent from the sample; at most PIVOTS entries
    lengths = np.bincount(order_of(sample, pivots, COPIES).ravel(), minlength=count) * (n / len(sample))
    slices = F.get(F.array(*[F.lit(int(np.ceil((v + n / len(sample)) / SLICE))) for v in lengths]), F.col("file"))
    home = F.array(F.pmod(F.xxhash64("id"), slices).cast("int"))
    posts = posts.withColumn("slice", F.explode(F.when(F.col("bound") < 0, home).otherwise(F.sequence(F.lit(0), slices - 1))))
    tasks = max(1, -(-n * COPIES // (SLICE // 4)))
    met = posts.repartition(tasks, "file", "slice").sortWithinPartitions("file", "slice", "bound")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def best() -> list[np.ndarray]:
            columns = [np.concatenate(c) for c in zip(*found, strict=True)]
            keep = best_of(*columns, k)
            return [c[keep] for c in columns]

        now, rows, opened = None, [], None
        for batch in batches:
            names = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("file", "slice")], 1)
            bounds, floors, ids = (batch.column(i).to_numpy() for i in (1, 2, 3))
            x = np.frombuffer(utf8(batch.column(4))[1].tobytes(), np.float64).reshape(-1, size)
            order = np.frombuffer(utf8(batch.column(5))[1].tobytes(), np.uint16).reshape(-1, wide)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)] if len(names) else [0]
            for a, z in zip(edges, edges[1:]):
                if (name := tuple(names[a].tolist())) != now:
                    now, rows, opened = name, [], None
                own = a + int(np.searchsorted(bounds[a:z], 0))  # rows come before queries
                if own > a:
                    rows.append((ids[a:own], x[a:own], order[a:own, :length]))
                if own < z and rows:
                    opened = opened or File(now[0], *(np.concatenate(c) for c in zip(*rows, strict=True)), count)
                    for i in range(own, z):
                        what, score = opened.search(x[i], order[i], read, int(ids[i]), int(bounds[i]), float(floors[i]), k)
                        found.append((np.full(len(what), ids[i]), what, score))
                        held += len(what)
                        if held >= HELD:
                            found = [tuple(best())]
                            held = len(found[0][0])
                            if held >= HELD // 2:  # nothing to save: on with it
                                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[0]], names=["query_id", key, "score"])
                                found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], names=["query_id", key, "score"])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    out = met.mapInArrow(search, f"query_id bigint, {key} bigint, score double")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def query(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
