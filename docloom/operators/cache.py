"""Results by content key: look-up, misses, and what a bounded cache would keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def misses(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Requests without a result, each key once: what has to be computed."""
    return requests.join(results.select(key), key, "left_anti").dropDuplicates([key])


def hits(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return requests.join(results, key)


def entry_size(key: Column, texts: list[Column], chunks: Column) -> Column:
    """Bytes of an entry: its key, its texts and its chunks' texts, ids and sections."""
    one = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    parts = F.aggregate(chunks, F.lit(0), lambda a, c: a + one(c["text"]) + one(c["id"]) + one(c["section"]))
    return sum((one(t) for t in texts), one(key)) + F.coalesce(parts, F.lit(0))


def least_recently_used(touches: DataFrame, key: str, tick: str, size: str, entries: int, most_bytes: int) -> DataFrame:
    """key, last_touched, bytes of the entries that stay: the latest, while their number and bytes allow.

    Touches are reduced to keys first.  Keys are ranked over blocks of ticks, so no task sorts them all: a block's rows and
    bytes are summed, and only blocks that begin within the limits are ranked row by row."""
    last = touches.groupBy(key).agg(F.max(tick).alias("last_touched"), F.max_by(size, tick).alias("bytes"))
    span = last.agg(F.min("last_touched"), F.max("last_touched")).first()
    width = max(1, ((span[1] or 0) - (span[0] or 0)) // 256)
    blocks = last.withColumn("block", F.floor(F.col("last_touched") / width).cast("bigint"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("block").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    before = sums.select("block", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(later), F.lit(0)).alias("b0"))
    before = before.where((F.col("n0") < entries) & (F.col("b0") <= most_bytes))
    inside = Window.partitionBy("block").orderBy(F.desc("last_touched"), key)
    rows = blocks.join(F.broadcast(before), "block")  # at most 257 blocks
    rows = rows.withColumn("rank", F.row_number().over(inside) + F.col("n0")).withColumn("upto", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("b0"))
    return rows.where((F.col("rank") <= entries) & (F.col("upto") <= most_bytes)).select(key, "last_touched", "bytes")
