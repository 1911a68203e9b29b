"""Connected components of an edge table, without ever holding a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): for every node with an edge, the smallest node of its component, roots among them.

    Alternating large-star and small-star steps (Kiveris et al., 2014): union-find as joins and minima, with partial
    aggregation for hubs.  Each round is written to the shared folder, so its lineage ends there; the round before it goes."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or not now[0]:
            break
        before = tuple(now)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, old = materialize(small, "edges"), e
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def more_connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (of ``connected_components``) with more links (a, b): only their ends' components are joined anew."""
    of = lambda end: F.coalesce(F.col(f"root_{end}"), F.col(end)).alias(end)
    for end in "ab":
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    tops = connected_components(links.select(of("a"), of("b")))
    below = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return below.unionByName(tops.join(roots, "node", "left_anti"))
