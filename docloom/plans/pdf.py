"""Documents of page lists: the fast text, or richer text and recognized pages where the fast text is poor.

Page lists are tables (key, page_number, text).  Each list becomes one row a document, with its quality and its pages in one
aggregate; lists but the fast one are read for documents that need them only.  Rows meet by key and one expression decides,
so no document is visited twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.pages import image_manifest, page_list, rendered_list, repair_pages
from docloom.operators.quality import document_quality, keeps_repair, page_quality, plan_escalation
from docloom.plans.pipelines import diagnostics, documents


def _judged(pages: DataFrame, key: str, prefix: str, folded: bool = True) -> DataFrame:
    """key, score, poor pages and the pages themselves, folded; the score is of the text as given."""
    text = T.fold_page_text(F.col("text")) if folded else F.col("text")
    q = document_quality(pages, key, more=[page_list(text).alias("pages")])
    return q.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in ("score", "poor_pages", "pages")])


def _read(images: DataFrame, key: str, label: str, prefix: str) -> DataFrame:
    """key, how many pages were recognized, and their images' manifest."""
    one = image_manifest(label, F.col("page_number"), F.col("width"), F.col("height"))
    manifest = F.transform(F.array_sort(F.collect_list(F.struct("page_number", one.alias("m")))), lambda x: x["m"])
    return images.groupBy(key).agg(F.count("*").alias(f"{prefix}_read"), manifest.alias(f"{prefix}_manifest"))


def decide(
    fast: DataFrame,
    key: str,
    rich: DataFrame | None = None,
    rendered: DataFrame | None = None,
    embedded: DataFrame | None = None,
    rich_reason: str = "no engine is registered",
    ocr_reason: str = "no engine is registered",
) -> DataFrame:
    """key, pipeline_used, ocr_used, render_used, fallback_used, fallback_reason, text_quality_score, pages, image_manifest.

    ``rich``: page texts of a second engine, None without one.  ``rendered`` and ``embedded``: recognized texts of rendered
    pages and of the largest images inside pages, with width and height; both None without recognition.  The order of
    choices: fast text that is good enough; rich text with its poor pages recognized; rich text; fast text with embedded
    images recognized; fast text.  A repair must not lower the score by more than 0.01 against what it replaces."""
    can_read = rendered is not None or embedded is not None
    quality = document_quality(fast, key, more=[page_list(T.fold_page_text(F.col("text"))).alias("pages")])
    plan = plan_escalation(quality, F.lit(rich is not None), F.lit(rich_reason), F.lit(can_read), F.lit(ocr_reason))
    d = plan.select(key, "score", "pages", "plan", "page_count", F.col("fallback_reason").alias("base"))
    needy = d.where("plan <> 'fast'").select(key)
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(d.dtypes)
    manifest = "array<struct<page:int,url:string,alt:string>>"
    absent = {"score": "double", "pages": kinds["pages"], "poor_pages": "array<int>", "read": "bigint", "manifest": manifest}

    def meet(d: DataFrame, prefix: str, parts: list[DataFrame]) -> DataFrame:
        for part in parts:
            d = d.join(part, key, "left")
        return d.withColumns({f"{prefix}_{k}": null(kind) for k, kind in absent.items() if f"{prefix}_{k}" not in d.columns})

    parts: dict[str, list[DataFrame]] = {"rich": [], "mixed": [], "embedded": []}
    if rich is not None:
        some = rich.join(needy, key, "left_semi")
        parts["rich"] = [_judged(some, key, "rich")]
        if rendered is not None:
            poor = page_quality(some).where("needs_ocr").select(key, "page_number")
            read = rendered.join(poor, [key, "page_number"], "left_semi")
            folded = some.withColumn("text", T.fold_page_text(F.col("text")))
            parts["mixed"] = [_judged(repair_pages(folded, read, key), key, "mixed", folded=False), _read(read, key, "rendered page image", "mixed")]
    if embedded is not None:
        there = embedded.join(needy, key, "left_semi").join(fast.select(key, "page_number"), [key, "page_number"], "left_semi")
        folded = fast.join(needy, key, "left_semi").withColumn("text", T.fold_page_text(F.col("text")))
        parts["embedded"] = [_judged(repair_pages(folded, there, key), key, "embedded", folded=False), _read(there, key, "embedded PDF page image", "embedded")]
    for prefix, found in parts.items():
        d = meet(d, prefix, found)

    score, base, poor = F.col("score"), F.col("base"), F.coalesce(F.size("rich_poor_pages"), F.lit(0))
    two = lambda text, *values: F.format_string(text, *values)
    tries_mix = F.lit(rich is not None and rendered is not None) & (F.col("plan") == "pdfium") & (poor > 0)
    failure = F.when(
        F.col("plan") == "pdfium",
        F.when(F.col("rich_score").isNull(), "rich extraction returned no pages").when(tries_mix & F.col("mixed_read").isNull(), "rendering returned no pages for selective OCR"),
    )
    failed = failure.isNotNull()
    prefix = F.when(failed, F.concat(base, F.lit("; rich extraction failed: "), failure)).otherwise(base)
    repaired = F.col("embedded_read").isNotNull() & keeps_repair(score, F.col("embedded_score"))
    pages_read = two("; embedded-image OCR repaired %d/%d page(s)", "embedded_read", "page_count")
    rich_text = F.concat(base, two("; rich text quality %.2f", "rich_score"))
    numbers = F.concat(F.lit("["), F.array_join(F.transform("rich_poor_pages", lambda x: x.cast("string")), ", "), F.lit("]"))
    plain = (
        F.when(poor == 0, F.concat(base, two("; rich text extraction improved quality to %.2f", "rich_score")))
        .when(F.lit(not can_read), F.concat(rich_text, F.lit(" still has poor pages "), numbers, F.lit("; OCR unavailable: "), F.lit(ocr_reason)))
        .otherwise(F.concat(rich_text, F.lit(" still has poor pages "), numbers))
    )
    outcome = (
        F.when(F.col("plan") == "fast", F.struct(F.lit("pdf-fast").alias("name"), base.alias("reason")))
        .when(failed | (F.col("plan") == "embedded_image_ocr"), F.when(repaired, F.struct(F.lit("pdf-embedded-image-ocr").alias("name"), F.concat(prefix, pages_read).alias("reason"))).otherwise(
            F.struct(F.lit("pdf-fast").alias("name"), F.when(failed, prefix).otherwise(F.concat(prefix, F.lit("; embedded-image OCR could not improve the document"))).alias("reason"))
        ))
        .when(tries_mix, F.when(
            ~keeps_repair(F.col("rich_score"), F.col("mixed_score")),
            F.struct(F.lit("pdf-pdfium").alias("name"), F.concat(rich_text, two("; selective OCR on %d page(s) did not improve quality", poor)).alias("reason")),
        ).when(
            ~keeps_repair(score, F.col("mixed_score")),
            F.struct(F.lit("pdf-fast").alias("name"), F.concat(base, two("; selective OCR quality %.2f did not beat fast-path quality %.2f", "mixed_score", "score")).alias("reason")),
        ).otherwise(F.struct(F.lit("pdf-pdfium-ocr").alias("name"), F.concat(rich_text, two("; selective OCR repaired %d/%d poor page(s)", "mixed_read", poor)).alias("reason"))))
        .when(~keeps_repair(score, F.col("rich_score")), F.struct(F.lit("pdf-fast").alias("name"), F.concat(plain, two("; rich text quality %.2f did not improve over fast-path quality %.2f", "rich_score", "score")).alias("reason")))
        .otherwise(F.struct(F.lit("pdf-pdfium").alias("name"), plain.alias("reason")))
    )
    d = d.withColumn("outcome", outcome).withColumn("pipeline_used", F.col("outcome.name"))
    by = lambda column: F.when(F.col("pipeline_used") == "pdf-fast", F.col(column or "score")).when(F.col("pipeline_used") == "pdf-pdfium", F.col(f"rich_{column}")).when(F.col("pipeline_used") == "pdf-pdfium-ocr", F.col(f"mixed_{column}")).otherwise(F.col(f"embedded_{column}"))
    used = F.col("pipeline_used")
    return d.select(
        key,
        "pipeline_used",
        used.isin("pdf-pdfium-ocr", "pdf-embedded-image-ocr").alias("ocr_used"),
        (used == "pdf-pdfium-ocr").alias("render_used"),
        F.col("outcome.reason").isNotNull().alias("fallback_used"),
        F.col("outcome.reason").alias("fallback_reason"),
        by("score").alias("text_quality_score"),
        by("pages").alias("pages"),
        F.when(used == "pdf-pdfium-ocr", F.col("mixed_manifest")).when(used == "pdf-embedded-image-ocr", F.col("embedded_manifest")).alias("image_manifest"),
    )


def _as_documents(decided: DataFrame) -> DataFrame:
    """Rendered, normalized, chunked documents of decided pages."""
    rows = decided.withColumns({"rendered": rendered_list(F.col("pages")), "last_page": F.coalesce(F.array_max(F.transform("pages", lambda p: p["page_number"])), F.lit(0))})
    how = diagnostics(*[F.col(c) for c in ("pipeline_used", "ocr_used", "render_used", "fallback_used", "fallback_reason", "text_quality_score")])
    out = documents(rows, F.col("rendered"), T.document_title, how, F.col("last_page"))
    return out.drop("rendered", "last_page", "pages", "pipeline_used", "ocr_used", "render_used", "fallback_used", "fallback_reason", "text_quality_score")


def pdf_documents(fast: DataFrame, key: str, **engines) -> DataFrame:
    """Documents of page lists by the escalation driver; ``engines``: see decide."""
    return _as_documents(decide(fast, key, **engines))


def page_ocr_documents(rendered: DataFrame, key: str) -> DataFrame:
    """Documents of recognized pages alone (key, page_number, text, width, height)."""
    q = document_quality(rendered, key, more=[page_list(F.col("text")).alias("pages")]).select(key, F.col("score").alias("text_quality_score"), "pages")
    d = q.join(_read(rendered, key, "rendered page image", "r").select(key, F.col("r_manifest").alias("image_manifest")), key, "left")
    flags = {"pipeline_used": F.lit("pdf-page-ocr"), "ocr_used": F.lit(True), "render_used": F.lit(True), "fallback_used": F.lit(False), "fallback_reason": F.lit(None).cast("string")}
    return _as_documents(d.withColumns(flags))


def image_documents(images: DataFrame, text: Column) -> DataFrame:
    """Documents of images whose text was recognized: one page each."""
    how = diagnostics(F.lit("image-ocr"), ocr=F.lit(True))
    return documents(images, text, T.image_title, how, F.lit(1))
