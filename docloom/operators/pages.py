"""Page lists: repair by OCR, selection, rendering as Markdown, largest images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import trim


def repair_pages(pages: DataFrame, ocr: DataFrame, key: str) -> DataFrame:
    """Pages with OCR text where there is some; OCR of pages that don't exist is ignored."""
    better = ocr.select(key, "page_number", F.col("text").alias("__ocr"))
    return pages.join(better, [key, "page_number"], "left").withColumn("text", F.coalesce("__ocr", "text")).drop("__ocr")


def select_pages(pages: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The chosen pages of a document; all pages of documents without a choice."""
    some = chosen.select(key).distinct().withColumn("__some", F.lit(True))
    marked = chosen.select(key, "page_number").distinct().withColumn("__chosen", F.lit(True))
    rows = pages.join(some, key, "left").join(marked, [key, "page_number"], "left")
    return rows.where(F.col("__some").isNull() | F.col("__chosen").isNotNull()).drop("__some", "__chosen")


def page_markdown(number: Column, text: Column) -> Column:
    return F.concat(F.lit("<!-- page "), number.cast("string"), F.lit(" -->\n"), trim(text))


def page_list(text: Column) -> Column:
    """An aggregate: a document's pages in order, as structs of page_number and text."""
    return F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page_number"), text.alias("text"))))


def rendered_list(pages: Column) -> Column:
    return F.array_join(F.transform(pages, lambda p: page_markdown(p["page_number"], p["text"])), "\n\n")


def render_pages(pages: DataFrame, key: str) -> DataFrame:
    """key, markdown, page_count: a document's pages in order, each after its marker."""
    rows = pages.groupBy(key).agg(page_list(F.col("text")).alias("__pages"))
    return rows.select(key, rendered_list(F.col("__pages")).alias("markdown"), F.coalesce(F.array_max(F.transform("__pages", lambda p: p["page_number"])), F.lit(0)).alias("page_count"))


def same_dimensions(width: Column, height: Column, before_width: Column, before_height: Column, most: float = 0.1) -> Column:
    """Whether a page may reuse the bitmap of the one before: both sides within ``most`` of it; false for the first page."""
    return F.coalesce((F.abs(before_width - width) <= most) & (F.abs(before_height - height) <= most), F.lit(False))


def largest_image(images: DataFrame, key: list[str], width: str = "width", height: str = "height", order: str = "ordinal") -> DataFrame:
    """The image of the largest area for each key; the last of equals."""
    area = F.col(width).cast("bigint") * F.col(height)
    best = F.max_by(F.struct(*[c for c in images.columns if c not in key]), F.struct(area, F.col(order)))
    return images.groupBy(*key).agg(best.alias("__best")).select(*key, "__best.*")


def image_manifest(label: str, number: Column, width: Column, height: Column) -> Column:
    return F.struct(number.cast("int").alias("page"), F.lit(None).cast("string").alias("url"), F.format_string(f"{label} for page %d (%dx%d)", number, width, height).alias("alt"))
