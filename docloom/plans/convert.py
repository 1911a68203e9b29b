"""Sources of every kind to documents of one shape: text, web, PDF and images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.recognize import Reader, read_images
from docloom.plans import pdf, pipelines
from docloom.sources import pdf_text

COLUMNS = ["title", "markdown", "chunks", "metadata", "diagnostics", "image_manifest", "error"]


def convert(sources: DataFrame, key: str, open_reader: Callable[[], Reader] | None = None, pages: Callable[[DataFrame, str, str], DataFrame] = pdf_text.pages, **engines) -> DataFrame:
    """key, source_kind, canonical_url and a document's columns for resolved sources (key unique).

    ``open_reader`` recognizes images, which else end with an error; ``pages`` are the fast page texts of PDF files, and
    ``engines`` go to the escalation driver.  A source that can't be read keeps its row, with an error and no document."""
    about = sources.select(key, "source_kind", "canonical_url", F.col("error").alias("__empty"))
    empty = F.lit(None).cast("array<struct<page:int,url:string,alt:string>>")
    text = pipelines.dispatch(sources.where("error IS NULL")).withColumns({"image_manifest": empty, "error": F.lit(None).cast("string")}).select(key, *COLUMNS)

    files = sources.where("source_kind = 'pdf' AND error IS NULL")
    found = pdf.pdf_documents(pages(files, key, "raw_bytes"), key, **engines).withColumn("error", F.lit(None).cast("string"))
    out = text.unionByName(found.select(key, *COLUMNS))

    if open_reader:
        images = read_images(sources.where("source_kind = 'image' AND error IS NULL").select(key, "raw_bytes"), "raw_bytes", open_reader)
        made = pdf.image_documents(images.where("image_error IS NULL"), F.col("recognized")).withColumns({"image_manifest": empty, "error": F.lit(None).cast("string")})
        out = out.unionByName(made.select(key, *COLUMNS))
    missing = F.coalesce("__empty", "error", F.when(F.col("markdown").isNull(), F.concat(F.lit("no document could be made of this "), F.col("source_kind"))))
    return about.join(out, key, "left").withColumn("error", missing).drop("__empty")
