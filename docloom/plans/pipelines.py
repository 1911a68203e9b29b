"""Whole documents: source kind to Markdown, chunks and metadata; events and JSON of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.chunk import chunks
from docloom.operators.normalize import normalize_markdown
from docloom.operators.web import html_title, html_to_markdown


def diagnostics(pipeline: Column, ocr: Column | None = None, render: Column | None = None, fallback: Column | None = None, reason: Column | None = None, score: Column | None = None) -> Column:
    """How a document was made; what isn't given is false or null."""
    no = F.lit(False)
    return F.struct(
        pipeline.alias("pipeline_used"),
        (no if ocr is None else ocr).alias("ocr_used"),
        (no if render is None else render).alias("render_used"),
        (no if fallback is None else fallback).alias("fallback_used"),
        (F.lit(None) if reason is None else reason).cast("string").alias("fallback_reason"),
        (F.lit(None) if score is None else score).cast("float").alias("text_quality_score"),
        F.lit(0).cast("bigint").alias("latency_ms"),
    )


def documents(rows: DataFrame, markdown: Column, title, how: Column, page_count: Column | None = None) -> DataFrame:
    """``rows`` with markdown (normalized), title, chunks, metadata and diagnostics (``how``).

    ``title`` makes the title of the normalized Markdown."""
    out = rows.withColumn("markdown", normalize_markdown(markdown)).withColumn("title", title(F.col("markdown")))
    metadata = F.struct(
        (F.lit(None) if page_count is None else page_count).cast("int").alias("page_count"),
        T.word_count(F.col("markdown")).alias("word_count"),
        F.octet_length("markdown").alias("char_count"),
    )
    return out.withColumns({"chunks": chunks(F.col("markdown")), "metadata": metadata, "diagnostics": how})


def text_pipeline(sources: DataFrame) -> DataFrame:
    """Markdown and plain text: decoded, normalized, chunked."""
    return documents(sources, T.decode_lossy(F.col("raw_bytes")), T.title, diagnostics(F.col("source_kind")))


def web_pipeline(sources: DataFrame) -> DataFrame:
    return dispatch(sources.where(F.col("source_kind") == "web"))


def dispatch(sources: DataFrame) -> DataFrame:
    """Text and web sources through their pipelines, in one pass; binary kinds go through plugins and page lists."""
    web = F.col("source_kind") == "web"
    rows = sources.where(F.col("source_kind").isin("markdown", "plaintext", "web")).withColumn("__text", T.decode_lossy(F.col("raw_bytes")))
    rows = rows.withColumns({"__title": F.when(web, html_title(F.col("__text"))), "__text": F.when(web, html_to_markdown(F.col("__text"))).otherwise(F.col("__text"))})
    title = lambda md: T.web_title(F.col("__title"), md)
    return documents(rows, F.col("__text"), title, diagnostics(F.col("source_kind"))).drop("__title", "__text")


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def events(docs: DataFrame, key: str) -> DataFrame:
    """key, seq, line: metadata, the chunks in order, done; nulls are written."""
    d = F.col("diagnostics")
    flags = [d["ocr_used"], d["render_used"], d["fallback_used"], d["fallback_reason"], d["text_quality_score"]]
    names = ["ocr_used", "render_used", "fallback_used", "fallback_reason", "text_quality_score"]
    flags = [c.alias(n) for c, n in zip(flags, names, strict=True)]
    url = F.col("canonical_url") if "canonical_url" in docs.columns else F.lit(None).cast("string")
    first = _json(F.struct(F.lit("metadata").alias("event"), F.col("title"), url.alias("url"), d["pipeline_used"].alias("source_kind"), F.col("metadata.page_count"), *flags))
    each = F.transform("chunks", lambda c: _json(F.struct(F.lit("chunk").alias("event"), c["id"], c["text"], c["section"], c["token_estimate"])))
    last = _json(F.struct(F.lit("done").alias("event"), F.size("chunks").alias("chunks_total"), d["latency_ms"], d["pipeline_used"], *flags))
    return docs.select(key, F.posexplode(F.concat(F.array(first), each, F.array(last))).alias("seq", "line"))


def document_json(docs: DataFrame, key: str) -> DataFrame:
    """key, json: the document with nulls, but for two diagnostics that are left out when null."""
    d = F.col("diagnostics")
    keep = ["pipeline_used", "ocr_used", "render_used", "fallback_used"]
    some = F.to_json(F.struct(*[d[k].alias(k) for k in [*keep, "fallback_reason", "text_quality_score", "latency_ms"]]))
    url = F.col("canonical_url") if "canonical_url" in docs.columns else F.lit(None).cast("string")
    rest = _json(F.struct(F.col("title"), url.alias("canonical_url"), F.col("markdown"), F.col("chunks"), F.col("metadata")))
    images = F.col("image_manifest") if "image_manifest" in docs.columns else F.lit(None).cast("array<struct<page:int,url:string,alt:string>>")
    last = F.regexp_replace(_json(F.struct(images.alias("image_manifest"))), r"\A\{", ",")
    return docs.select(key, F.concat(F.regexp_replace(rest, r"\}\z", ""), F.lit(',"diagnostics":'), some, last).alias("json"))


def write_events(events_: DataFrame, path: str) -> None:
    """One JSON a line, documents whole and in order within their files."""
    events_.sortWithinPartitions(*events_.columns[:2]).select("line").write.text(path)


#: What can be read, and how.
FORMATS = [
    ("web", ["text/html"], "Web pages: main content by tags, as Markdown"),
    ("pdf", ["application/pdf"], "Page texts of a registered PDF engine"),
    ("markdown", ["text/markdown"], "Markdown passthrough with normalization"),
    ("plaintext", ["text/plain"], "Plain text with minimal processing"),
]


def formats(spark) -> DataFrame:
    return spark.createDataFrame(FORMATS, "kind string, mime_types array<string>, description string")


def health(spark) -> DataFrame:
    """One row once a job runs at all: status and how many tasks can run side by side."""
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(spark.sparkContext.defaultParallelism).alias("tasks"))
