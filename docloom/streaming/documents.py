"""The document functions under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.metrics import BOUNDS
from docloom.plans.pipelines import dispatch, events
from docloom.sources.resolve import bytes_cache_key, resolve


def stream_events(sources: DataFrame, key: str, raw: str, at: str, within: str = "1 hour") -> DataFrame:
    """Events of a stream of documents; equal content within ``within`` is converted once.

    Per-document expressions only, besides the one stateful step that stands for the result cache."""
    null = F.lit(None).cast("string")
    fresh = sources.withColumn("cache_key", bytes_cache_key(F.col(raw).cast("binary"), null, null)).withWatermark(at, within).dropDuplicatesWithinWatermark(["cache_key"])
    return events(dispatch(resolve(fresh, raw)), key)


def stream_metrics(requests: DataFrame, at: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests, latency sums and cumulative buckets by window, route and status."""
    buckets = [F.count_if(F.col("latency_ms") <= b).alias(f"le_{b}") for b in BOUNDS]
    return requests.withWatermark(at, late).groupBy(F.window(at, window), "route", "status").agg(F.count("*").alias("requests"), F.sum("latency_ms").alias("sum_ms"), *buckets)
