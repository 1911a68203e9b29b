"""Rendezvous hashing of stable record keys over weighted shards (SQL functions only).

Each record scores every shard by ``-weight / ln(u)``, u in (0, 1) from md5("key/shard"), and goes to the shard with
the highest score (ties: the lowest number).  A shard that is added can only win records, never move them between the
old ones; a shard whose weight falls can only lose records.

Slots number the rows of a shard from 0 without gaps, by md5 of key and text's crc32.  No shard is ever held by one task:
rows are ranked inside (shard, first three hex digits of that md5), 4,096 parts a shard, and shifted by the sizes of the
parts before, a table of at most 4,096 rows a shard, broadcast for up to ``FEW`` shards.  Rows of one key (null, say) lie in
one shard, but by their texts in many parts.

Null keys hash as the empty key; null texts have no bytes and the crc32 of none; repeated rows get slots of their own;
an empty table gives an empty table; other columns are carried along unread, and ValueError says so if one has the name
of an output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table


FEW = 256


def best_shard(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Struct (score, back) of the shard that wins ``key`` among those numbered from ``first``; ``-back`` is its number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def scored(weight: Column, i: Column) -> Column:
        number = i + F.lit(first)
        digits = F.substring(F.md5(F.concat(key, F.lit("/"), number.cast("string")).cast("binary")), 1, 13)
        unit = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(2**52 + 1))
        return F.struct((-weight / F.log(unit)).alias("score"), (-number).alias("back"))

    return F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), scored))


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], added: float | None = None, text: str = "text") -> DataFrame:
    """``df`` with size, text_crc32, shard, slot and grown_shard (the shard with one more of weight ``added``; else null)."""
    if taken := {c.lower() for c in df.columns} & {"size", "text_crc32", "shard", "slot", "grown_shard", "__key", "__order", "__part", "__before"}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    plain = F.coalesce(F.col(key).cast("string"), F.lit(""))
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    order = F.md5(F.concat(plain, F.lit("/"), F.crc32(raw).cast("string")).cast("binary"))

    def placed(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn("__key", plain).withColumn("__order", order).withColumn("__best", best_shard(F.col("__key"), weights))
        shard = (-F.col("__best.back")).cast("int")
        grown = F.lit(None).cast("int")
        if added:  # the new shard only has to beat the best of the old ones
            grown = (-F.greatest(F.col("__best"), best_shard(F.col("__key"), [added], len(weights)))["back"]).cast("int")
        return frame.select("*", shard.alias("shard"), grown.alias("grown_shard"), F.substring("__order", 1, 3).alias("__part")).drop("__best")

    part = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed(df.select(key, text)).groupBy("shard", "__part").count().select("shard", "__part", F.coalesce(F.sum("count").over(part), F.lit(0)).alias("__before"))
    rows = placed(df.withColumn("size", (F.octet_length(raw) + 8).cast("long")).withColumn("text_crc32", F.crc32(raw).cast("long")))
    inside = Window.partitionBy("shard", "__part").orderBy("__order", key, "size", "text_crc32")
    rows = rows.withColumn("slot", F.row_number().over(inside)).join(F.broadcast(before) if len(weights) <= FEW else before, ["shard", "__part"])
    return rows.withColumn("slot", (F.col("slot") - 1 + F.col("__before")).cast("long")).drop("__key", "__order", "__part", "__before")


SHARDS = 24


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = assign_shards(docs.select("doc_id", "text"), "doc_id", [1.0] * SHARDS, added=1.0)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

