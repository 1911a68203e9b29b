"""Text quality of pages and documents, and what to do about poor ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import trim

# Thresholds and the score's deductions.
FEW_CHARS, MANY_EMPTY, MANY_BAD, ESCALATE = 50, 0.3, 0.05, 0.5


def page_quality(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with char_count (characters, trimmed), replacement_ratio, score, triggers and needs_ocr."""
    raw = F.coalesce(F.col(text), F.lit(""))
    count = F.length(trim(raw))
    bad = F.length(raw) - F.length(F.replace(raw, F.lit("�"), F.lit("")))
    pages = pages.withColumns({"char_count": count, "raw_chars": F.length(raw), "bad_chars": bad})
    ratio = F.coalesce(F.try_divide(F.col("bad_chars"), F.col("raw_chars")), F.lit(0.0))
    few, broken, none = F.col("char_count") < FEW_CHARS, F.col("replacement_ratio") > MANY_BAD, F.col("char_count") == 0
    off = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    pages = pages.withColumn("replacement_ratio", ratio)
    pages = pages.withColumn("score", F.greatest(F.lit(0.0), 1.0 - off(few, 0.5) - off(broken, 0.25) - off(none, 0.25)))
    names = F.array_compact(F.array(F.when(few, F.lit("low_chars_per_page")), F.when(broken, F.lit("replacement_characters")), F.when(none, F.lit("missing_text_layer"))))
    return pages.withColumns({"triggers": names, "needs_ocr": (F.col("score") <= ESCALATE) | none})


def document_quality(pages: DataFrame, key: str, text: str = "text", more: Sequence[Column] = ()) -> DataFrame:
    """One row a document: averages, median, ratios, score, triggers, needs_escalation, poor_pages, summary, ``more`` aggregates."""
    p = page_quality(pages, text)
    d = p.groupBy(key).agg(
        F.count("*").alias("page_count"),
        F.avg("char_count").alias("chars_per_page"),
        F.median("char_count").alias("median_chars_per_page"),
        F.avg((F.col("char_count") < FEW_CHARS).cast("int")).alias("empty_page_ratio"),
        F.coalesce(F.try_divide(F.sum("bad_chars"), F.sum("raw_chars")), F.lit(0.0)).alias("replacement_ratio"),
        (F.sum("char_count") == 0).alias("missing_text_layer"),
        F.array_sort(F.collect_set(F.when(F.col("needs_ocr"), F.col("page_number")))).cast("array<int>").alias("poor_pages"),
        *more,
    )
    low, empty, bad, none = F.col("median_chars_per_page") < FEW_CHARS, F.col("empty_page_ratio") > MANY_EMPTY, F.col("replacement_ratio") > MANY_BAD, F.col("missing_text_layer")
    off = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    d = d.withColumn("score", F.round(F.greatest(F.lit(0.0), 1.0 - off(low, 0.4) - off(empty, 0.25) - off(bad, 0.2) - off(none, 0.5)), 6))
    parts = [
        F.when(low, F.format_string("low chars/page (avg %.1f, median %.1f)", "chars_per_page", "median_chars_per_page")),
        F.when(empty, F.format_string("high empty-page ratio (%.0f%%)", F.col("empty_page_ratio") * 100)),
        F.when(bad, F.format_string("replacement-character issues (%.1f%%)", F.col("replacement_ratio") * 100)),
        F.when(none, F.lit("missing text layer")),
    ]
    names = ["low_chars_per_page", "high_empty_page_ratio", "replacement_characters", "missing_text_layer"]
    triggers = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in zip((low, empty, bad, none), names, strict=True)]))
    summary = F.concat_ws(", ", *parts)
    return d.withColumns({"triggers": triggers, "summary": F.when(summary == "", "no quality issues detected").otherwise(summary)}).withColumn(
        "needs_escalation", (F.col("score") < ESCALATE) | (F.size("triggers") > 0)
    )


def plan_escalation(quality: DataFrame, rich: Column, rich_reason: Column, ocr: Column, ocr_reason: Column) -> DataFrame:
    """``quality`` with plan, allow_ocr and fallback_reason: only documents that need it leave the fast path."""
    base = F.concat(F.format_string("fast PDF text quality %.2f triggered escalation: ", "score"), F.col("summary"))
    without = F.concat(base, F.lit("; rich extraction unavailable: "), rich_reason)
    plan = F.when(~F.col("needs_escalation"), "fast").when(rich, "pdfium").when(ocr, "embedded_image_ocr").otherwise("fast")
    reason = F.when(F.col("needs_escalation"), F.when(rich, base).when(ocr, without).otherwise(F.concat(without, F.lit("; OCR unavailable: "), ocr_reason)))
    return quality.withColumns({"plan": plan, "allow_ocr": F.col("needs_escalation") & rich & ocr, "fallback_reason": reason})


def keeps_repair(before: Column, after: Column) -> Column:
    """A repaired text stays unless its score fell by more than 0.01."""
    return ~(after + 0.01 < before)
