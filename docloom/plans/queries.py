"""Registered queries over the driver's tables, and the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import cache, metrics, ocr, pages, quality, recognize
from docloom.operators.chunk import chunk_rows, numbered_rows, sections, split_sentences
from docloom.operators.chunk import chunks as numbered_array
from docloom.operators.normalize import normalize_markdown
from docloom.operators.web import html_title, html_to_markdown
from docloom.plans import convert, pdf, pipelines
from docloom.sources import images, pdf_text
from docloom.sources import resolve as R


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Inputs that are derived from the tables.


def md_conversations(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    parts = F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit(" "), x["turn"].cast("string"), F.lit("\n\n"), x["text"]))
    return turns.select("conv_id", F.concat_ws("\n\n", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string")), F.array_join(parts, "\n\n")).alias("md"))


def dirty_docs(spark, d) -> DataFrame:
    """documents with tags, odd spaces, blank runs, headings and a fence put in by line number and id."""
    rows = F.split("text", "\n")

    def spoiled(x, i):
        k = F.pmod(F.col("doc_id") + i, F.lit(7))
        return (
            F.when(k == 0, F.concat(x, F.lit("<br>tail  ")))
            .when(k == 1, F.concat(F.lit("<div>"), x, F.lit("</div><B>bold</B>")))
            .when(k == 2, F.concat(F.lit("## H "), i.cast("string"), F.lit("\n"), x))
            .when(k == 3, F.concat(x, F.repeat(F.lit("\n"), F.pmod(F.col("doc_id"), F.lit(5)).cast("int") + 1)))
            .when(k == 4, F.concat(F.replace(x, F.lit(" "), F.lit(" ")), F.lit("\r")))
            .when(k == 5, F.concat(F.lit("```\n"), x, F.lit("   \n\n\n\n```")))
            .otherwise(x)
        )

    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(rows, spoiled), "\n").alias("md"))


def doc_pages(spark, d, bad: bool = False) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    rows = rows.select("doc_id", (F.col("k") + 1).alias("page_number"), "text")
    if bad:
        spoiled = F.when(F.col("page_number") % 3 == 0, "").when(F.col("page_number") % 5 == 0, F.concat(F.repeat(F.lit("�"), 20), F.col("text"))).otherwise(F.col("text"))
        rows = rows.withColumn("text", spoiled)
    return rows


def request_log(spark, d) -> DataFrame:
    route = F.create_map(*[F.lit(x) for kv in {"view": "/v1/extract/url", "click": "/v1/extract/bytes", "purchase": "/v1/ocr", "signup": "/health"}.items() for x in kv])
    status = F.when(F.col("event_id") % 10 == 9, 500).when(F.col("event_id") % 10 == 8, 400).otherwise(200)
    return table(spark, d, "events").select(
        "event_id", "user_id", "ts",
        F.coalesce(F.try_element_at(route, F.col("event_type")), F.lit("unmatched")).alias("route"),
        status.alias("status"),
        F.floor(F.col("value") * 20).cast("bigint").alias("latency_ms"),
        (F.col("event_id") % 2 == 0).alias("hit"),
        (F.col("event_id") % 3 == 0).alias("ocr_used"),
    )


def boxes(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("ordinal"),
        (F.col("l_partkey") % 1000).cast("int").alias("x"),
        (F.col("l_linenumber") * 20 + F.col("l_suppkey") % 7).cast("int").alias("y"),
        (F.floor("l_quantity") + 1).cast("int").alias("width"),
        (12 + F.col("l_linenumber") % 5).cast("int").alias("height"),
        (1 - F.col("l_discount")).alias("confidence"),
    )


def score_rows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("scores"))


TOKENS = ["", *[f"t{i}" for i in range(1, 64)]]


def scalar_metadata(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.word_count(F.col("text")).alias("word_count"), F.octet_length("text").alias("char_count"), T.token_estimate(F.col("text")).alias("token_estimate")
    )


def page_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.fold_page_text(F.col("text")).cast("binary")).alias("folded_md5"))


def fragments(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(split_sentences(T.fold_page_text(F.col("text")))).alias("k", "f"))
    return rows.where("f <> ''").select("doc_id", "k", F.octet_length("f").alias("bytes"), F.md5(F.col("f").cast("binary")).alias("fragment_md5"))


def section_rows(spark, d):
    rows = md_conversations(spark, d).select("conv_id", F.inline(F.filter(sections(T.trim(F.col("md"))), lambda s: s["body"] != "")))
    return rows.select("conv_id", "heading", F.octet_length("body").alias("body_bytes"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def titles(spark, d):
    return md_conversations(spark, d).select("conv_id", T.title(F.col("md")).alias("title"), T.word_count(F.col("md")).alias("word_count"))


def normalized(spark, d):
    return dirty_docs(spark, d).select("doc_id", normalize_markdown(F.col("md")).alias("markdown"))


def chunked(spark, d):
    return chunk_rows(md_conversations(spark, d), "conv_id", "md").unionByName(
        chunk_rows(table(spark, d, "documents").withColumn("conv_id", -1 - F.col("doc_id")), "conv_id", "text")
    )


def resolved(spark, d):
    rows = R.resolve(table(spark, d, "pages"), "html", url="url")
    return rows.select("page_id", "canonical_url", "mime", "source_kind", "resolved_filename", R.host_key(F.col("url")).alias("host"), F.octet_length("raw_bytes").alias("bytes"), "error")


def upgraded(spark, d):
    """Made-up preprint addresses of the documents, upgraded."""
    n = F.col("doc_id")
    url = F.concat(F.when(n % 2 == 0, "https").otherwise("http"), F.lit("://arxiv.org/"), F.when(n % 5 == 4, "pdf/").otherwise("abs/"), n.cast("string"))
    url = F.concat(url, F.when(n % 3 == 0, "/?x=1").when(n % 3 == 1, "#top").otherwise(""))
    name = F.concat(F.lit("a%20b+c%zz"), n.cast("string"), F.when(n % 2 == 0, ".html").otherwise(""))
    return table(spark, d, "documents").select("doc_id", R.upgrade_url(url).alias("url"), R.percent_decode(name).alias("name"), R.by_extension(R.percent_decode(name)).alias("by_extension"))


def cache_keys(spark, d):
    body = F.col("html").cast("binary")
    return table(spark, d, "pages").select(
        "page_id",
        R.url_cache_key(F.col("url"), F.lit(" auto "), F.lit(None).cast("int")).alias("url_key"),
        R.url_cache_key(F.col("url"), F.lit("auto"), (F.col("page_id") % 9).cast("int")).alias("url_key_pages"),
        R.bytes_cache_key(body, F.lit("Text/HTML; charset=utf-8"), F.lit(None).cast("string")).alias("bytes_key"),
    )


def page_scores(spark, d):
    p = quality.page_quality(doc_pages(spark, d, bad=True))
    return p.select("doc_id", "page_number", "char_count", F.round("replacement_ratio", 6).alias("replacement_ratio"), "score", F.array_join("triggers", ",").alias("triggers"), "needs_ocr")


def _doc_quality(spark, d, bad=True):
    return quality.document_quality(doc_pages(spark, d, bad), "doc_id")


def doc_scores(spark, d):
    return _doc_quality(spark, d).select(
        "doc_id", "page_count", F.round("chars_per_page", 6).alias("chars_per_page"), "median_chars_per_page", F.round("empty_page_ratio", 6).alias("empty_page_ratio"),
        F.round("replacement_ratio", 6).alias("replacement_ratio"), "missing_text_layer", F.array_join(F.transform("poor_pages", lambda x: x.cast("string")), ",").alias("poor_pages"),
        "score", F.array_join("triggers", ",").alias("triggers"), "needs_escalation",
    )


def escalation(spark, d):
    k = F.col("doc_id") % 4
    plan = quality.plan_escalation(_doc_quality(spark, d), k >= 2, F.lit("no library"), k % 2 == 1, F.lit("no model"))
    return plan.select("doc_id", "plan", "allow_ocr", F.col("fallback_reason").isNotNull().alias("has_reason"))


def page_engines(spark, d) -> dict[str, DataFrame]:
    """Made-up engines over doc_pages: rich text of two documents in three, some pages of it blank; recognized texts of
    rendered pages and of embedded images, from benchmark by page number, for some documents."""
    rich = doc_pages(spark, d).where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("page_number") % 4 == 0, "").otherwise(F.col("text")))
    texts = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("page_number"), F.when(F.col("item_id") % 6 == 5, "").otherwise(F.col("text")).alias("text"))
    sizes = {"width": F.col("page_number") * 10, "height": F.col("page_number") * 20}
    read = doc_pages(spark, d).select("doc_id", "page_number").join(F.broadcast(texts) if texts.count() < 10_000 else texts, "page_number").withColumns(sizes)
    return {"rich": rich, "rendered": read.where("doc_id % 5 <> 0"), "embedded": read.where("doc_id % 2 = 0 AND page_number % 3 = 0")}


def escalation_driver(spark, d):
    return pdf.decide(doc_pages(spark, d, bad=True), "doc_id", **page_engines(spark, d)).select(
        "doc_id", "pipeline_used", "ocr_used", "render_used", "fallback_used", "fallback_reason", F.col("text_quality_score").alias("score"), F.size("image_manifest").alias("images"),
        F.size("pages").alias("page_count"), F.md5(pages.rendered_list(F.col("pages")).cast("binary")).alias("rendered_md5"),
    )


def escalated(spark, d):
    """Documents of the driver's choice, without recognition and with it."""
    engines = page_engines(spark, d)
    out = pdf.pdf_documents(doc_pages(spark, d, bad=True), "doc_id", **engines)
    return pipelines.document_json(out, "doc_id")


def embedded_only(spark, d):
    """The driver without rich text: embedded images are the only repair."""
    out = pdf.decide(doc_pages(spark, d, bad=True), "doc_id", embedded=page_engines(spark, d)["embedded"], rich_reason="none here")
    outcome = F.nullif(F.substring_index("fallback_reason", "none here; ", -1), F.lit(""))
    return out.select("doc_id", "pipeline_used", F.col("text_quality_score").alias("score"), F.size("image_manifest").alias("images"), outcome.alias("outcome"), F.md5(pages.rendered_list(F.col("pages")).cast("binary")).alias("rendered_md5"))


def page_ocr(spark, d):
    out = pdf.page_ocr_documents(page_engines(spark, d)["rendered"], "doc_id")
    return out.select("doc_id", "metadata.page_count", F.round(F.col("diagnostics.text_quality_score").cast("double"), 6).alias("score"), F.element_at("image_manifest", 1)["alt"].alias("first_image"))


def repaired(spark, d):
    texts = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("page_number"), "text")
    some = doc_pages(spark, d).where(F.length("text") < 50).select("doc_id", "page_number").join(texts, "page_number")
    out = pages.render_pages(pages.repair_pages(doc_pages(spark, d), some, "doc_id"), "doc_id")
    return out.select("doc_id", "page_count", F.octet_length("markdown").alias("bytes"), F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


def web(spark, d):
    out = pipelines.dispatch(R.resolve(table(spark, d, "pages"), "html", url="url"))
    return out.select("page_id", "title", "markdown", "metadata.word_count", F.size("chunks").alias("chunks"))


def web_titles(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", html_title(html).alias("title"), F.regexp_extract(html_to_markdown(html), r"(?m)^# (.*)$", 1).alias("first_heading"))


def page_documents(spark, d):
    out = pdf.pdf_documents(doc_pages(spark, d), "doc_id")
    return out.select("doc_id", "title", "metadata.page_count", "metadata.word_count", numbered_rows(F.col("chunks")))


def event_lines(spark, d):
    docs = md_conversations(spark, d).withColumns({"raw_bytes": F.col("md").cast("binary"), "source_kind": F.lit("markdown")})
    return pipelines.events(pipelines.text_pipeline(docs), "conv_id")


def event_tally(spark, d):
    lines = event_lines(spark, d).withColumn("event", F.get_json_object("line", "$.event"))
    return lines.groupBy("conv_id").agg(
        F.count_if(F.col("event") == "metadata").alias("heads"),
        F.count_if(F.col("event") == "done").alias("ends"),
        F.max(F.when(F.col("event") == "metadata", F.get_json_object("line", "$.title"))).alias("title"),
        (F.max(F.get_json_object("line", "$.chunks_total").cast("bigint")) == F.count_if(F.col("event") == "chunk")).alias("all_chunks"),
    )


def json_documents(spark, d):
    docs = md_conversations(spark, d).withColumns({"raw_bytes": F.col("md").cast("binary"), "source_kind": F.lit("markdown")})
    return pipelines.document_json(pipelines.text_pipeline(docs), "conv_id")


def summary(spark, d):
    out = metrics.nearest_rank(request_log(spark, d), "route", "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return out.select("route", F.col("n").cast("bigint").alias("n"), "least", "most", F.round("mean", 6).alias("mean"), "p50", "p95", "p99")


def kept_entries(spark, d):
    log = request_log(spark, d).withColumn("bytes", (F.col("latency_ms") % 97) * 100 + 1)
    return cache.least_recently_used(log, "user_id", "event_id", "bytes", 40, 120_000).select("user_id", "last_touched", "bytes")


def cache_misses(spark, d):
    log = request_log(spark, d)
    return cache.misses(log.where("hit").select("user_id"), log.where("status = 500").select("user_id").distinct(), "user_id")


def cache_hits(spark, d):
    """Requests answered from results, and the entries' sizes."""
    results = md_conversations(spark, d).select(F.col("conv_id").alias("user_id"), "md", numbered_array(F.col("md")).alias("chunks"))
    size = cache.entry_size(F.col("user_id").cast("string"), [F.col("md"), F.lit(None).cast("string")], F.col("chunks"))
    found = cache.hits(request_log(spark, d).where("status = 200"), results, "user_id")
    return found.groupBy("user_id").agg(F.count("*").alias("hits"), F.max(size).cast("bigint").alias("bytes"))


def selected(spark, d):
    """Chosen pages of every third document, all pages of the others."""
    all_ = doc_pages(spark, d)
    chosen = all_.where("doc_id % 3 = 0 AND page_number % 2 = 1").select("doc_id", "page_number")
    return pages.select_pages(all_, chosen, "doc_id").groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("page_number").alias("numbers"))


def decoded(spark, d):
    out = ocr.ctc_decode(score_rows(spark, d), "label", "vec_id", "scores", TOKENS)
    return out.select("label", "text", "tokens", F.round("confidence", 6).alias("confidence"))


def probabilities(spark, d):
    rows = score_rows(spark, d).withColumn("p", ocr.softmax(F.col("scores")))
    return rows.select(
        "vec_id", ocr.argmax_last(F.col("scores")).alias("best"), F.round(F.array_max("p"), 6).alias("top"), ocr.looks_like_probabilities(F.col("scores")).alias("raw_looks"),
        ocr.looks_like_probabilities(F.col("p")).alias("softmax_looks"),
    )


def slices(spark, d):
    return ocr.batch_slices(score_rows(spark, d), "label", "vec_id", 16).groupBy("label", "batch").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def image_sizes(spark, d):
    w, h = F.col("p_size") * 37, (F.col("p_partkey") % 1500 + 1).cast("int")
    longest = F.greatest(w, h)
    return table(spark, d, "part").select(
        "p_partkey", ocr.recognition_width(w, h).alias("rec_width"), ocr.detection_side(w, longest).alias("det_width"), ocr.detection_side(h, longest).alias("det_height")
    )


def clamped(spark, d):
    return ocr.clamp_boxes(boxes(spark, d), F.lit(900), F.lit(130)).select(
        "image", "ordinal", "x", "y", "width", "height", F.round(ocr.region_confidence(F.col("confidence"), F.lit(0.9)), 6).alias("confidence")
    )


def largest(spark, d):
    return pages.largest_image(boxes(spark, d), ["image"]).select("image", "ordinal", "width", "height")


def ordered(spark, d):
    b = boxes(spark, d).groupBy("image").agg(F.collect_list(F.struct("y", "x", "width", "height", F.col("ordinal").cast("string").alias("text"))).alias("b"))
    b = ocr.read_regions(b, "b", "merged")
    return b.select("image", F.array_join(F.transform("b", lambda x: x["text"]), ",").alias("reading_order"), "merged")


def detected(spark, d):
    """Boxes of made-up maps of 8 by 8 logits."""
    size = {"rows": F.lit(8), "cols": F.lit(8), "width": F.lit(64), "height": F.lit(64)}
    maps = score_rows(spark, d).select("vec_id", F.transform("scores", lambda x: x * 12 - 1.2).alias("values")).withColumns(size)
    return ocr.detect(maps, "vec_id").withColumn("confidence", F.round("confidence", 6))


def strip_images(spark, d):
    """Images of nations' names, with a region's name below, in strip writing."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return recognize.drawn(rows.select("n_nationkey", F.concat_ws("\n", "n_name", "r_name").alias("lines")), "lines", "png")


def image_sources(spark, d):
    out = images.decode_images(strip_images(spark, d).withColumn("png", F.when(F.col("n_nationkey") % 6 == 5, F.substring("png", 1, 60)).otherwise(F.col("png"))), "png")
    return out.select("n_nationkey", "width", "height", F.octet_length("pixels").alias("bytes"), F.col("image_error").isNotNull().alias("failed"))


def image_ocr(spark, d):
    read = recognize.read_images(strip_images(spark, d), "png", recognize.strip_reader)
    out = pdf.image_documents(read, F.col("recognized"))
    how = F.col("diagnostics")
    return out.select("n_nationkey", "title", "markdown", "metadata.page_count", how["pipeline_used"].alias("pipeline_used"), how["ocr_used"].alias("ocr_used"), F.size("regions").alias("regions"))


def base64_payloads(spark, d):
    n, text = F.col("n_nationkey"), F.base64(F.col("n_name").cast("binary"))
    wrong = F.when(n % 4 == 0, "").when(n % 4 == 1, "data:image/png").when(n % 4 == 2, "data:text/plain;base64,aGk=").otherwise("?!")
    given = F.array(text, F.concat(F.lit("data:image/png;base64,"), text), wrong)
    return table(spark, d, "nation").select("n_nationkey", F.inline(images.base64_images(given))).select("n_nationkey", "index", F.decode("raw", "UTF-8").alias("text"), "error")


def plain_pdf(texts):
    """A PDF with a page for each text, as a column."""
    body = lambda t: F.concat(F.lit("BT /F 12 Tf 72 720 Td ("), F.regexp_replace(t, r"([\\()])", r"\\$1"), F.lit(") Tj ET"))
    page = lambda t, i: F.concat(
        F.format_string("%d 0 obj\n<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>\nendobj\n", 3 + 2 * i, 4 + 2 * i),
        F.format_string("%d 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n", 4 + 2 * i, F.length(body(t)), body(t)),
    )
    kids = F.array_join(F.transform(texts, lambda t, i: F.format_string("%d 0 R", 3 + 2 * i)), " ")
    head = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Count "), F.size(texts).cast("string"), F.lit(" /Kids ["), kids, F.lit("] >>\nendobj\n"))
    return F.concat(head, F.array_join(F.transform(texts, page), ""), F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n")).cast("binary")


def pdf_files(spark, d):
    """Made-up PDF files of the conversations, a page a turn, in plain letters."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    texts = F.transform("t", lambda x: F.regexp_replace(x["text"], r"[^ -~]", " "))
    return turns.select("conv_id", plain_pdf(texts).alias("raw"))


def pdf_pages(spark, d):
    pdf_text.register(spark)
    pdf_files(spark, d).createOrReplaceTempView("docloom_pdf_files")
    return spark.sql("SELECT f.conv_id, p.page_number, p.text FROM docloom_pdf_files f, LATERAL pdf_pages(f.raw) p")


def every_kind(spark, d):
    """Text, web, PDF and image sources in one table, converted by kind."""
    null = F.lit(None).cast("string")
    rows = [
        md_conversations(spark, d).select(F.concat(F.lit("m"), "conv_id").alias("id"), F.lit("a.md").alias("name"), F.col("md").cast("binary").alias("body")),
        table(spark, d, "pages").select(F.concat(F.lit("w"), "page_id").alias("id"), null.alias("name"), F.col("html").cast("binary").alias("body")),
        pdf_files(spark, d).select(F.concat(F.lit("p"), "conv_id").alias("id"), F.when(F.col("conv_id") % 3 == 0, "b.pdf").alias("name"), F.when(F.col("conv_id") % 7 == 6, F.lit("%PDF-").cast("binary")).otherwise(F.col("raw")).alias("body")),
        strip_images(spark, d).select(F.concat(F.lit("i"), "n_nationkey").alias("id"), null.alias("name"), F.when(F.col("n_nationkey") % 6 == 5, F.lit("").cast("binary")).otherwise(F.col("png")).alias("body")),
    ]
    sources = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    out = convert.convert(R.resolve(sources, "body", filename="name"), "id", recognize.strip_reader)
    return out.select("id", "source_kind", "error", "metadata.page_count", F.col("diagnostics.pipeline_used").alias("pipeline_used"), F.col("diagnostics.text_quality_score").isNotNull().alias("scored"))


QUERIES = {
    "doc_metadata": scalar_metadata,
    "pdf_text_fold": page_fold,
    "split_sentences": fragments,
    "sections": section_rows,
    "titles": titles,
    "normalize_text": normalized,
    "chunks": chunked,
    "resolve_pages": resolved,
    "upgrade_url": upgraded,
    "cache_key": cache_keys,
    "page_quality": page_scores,
    "doc_quality": doc_scores,
    "escalation_plan": escalation,
    "escalation_driver": escalation_driver,
    "escalated_documents": escalated,
    "embedded_image_ocr": embedded_only,
    "page_ocr_documents": page_ocr,
    "page_repair": repaired,
    "web_chunks": web,
    "web_extract": web_titles,
    "pdf_documents": page_documents,
    "ndjson_events": event_lines,
    "ndjson_tally": event_tally,
    "document_json": json_documents,
    "formats": lambda spark, d: pipelines.formats(spark).withColumn("mime_types", F.array_join("mime_types", ",")),
    "health": lambda spark, d: pipelines.health(spark).select("status", (F.col("tasks") > 0).alias("ready")),
    "request_counts": lambda spark, d: metrics.request_counts(request_log(spark, d)),
    "latency_histogram": lambda spark, d: metrics.latency_histogram(request_log(spark, d)),
    "latency_totals": lambda spark, d: metrics.latency_totals(request_log(spark, d)),
    "hit_ratio": lambda spark, d: metrics.hit_ratio(request_log(spark, d)),
    "ocr_counters": lambda spark, d: metrics.ocr_counters(request_log(spark, d)),
    "latency_summary": summary,
    "exposition": lambda spark, d: metrics.exposition(request_log(spark, d)),
    "lru_keep": kept_entries,
    "cache_miss": cache_misses,
    "cache_hits": cache_hits,
    "selected_pages": selected,
    "ctc_decode": decoded,
    "softmax_rows": probabilities,
    "batch_slices": slices,
    "image_dims": image_sizes,
    "clamp_boxes": clamped,
    "largest_image": largest,
    "reading_order": ordered,
    "db_boxes": detected,
    "image_decode": image_sources,
    "image_ocr": image_ocr,
    "base64_images": base64_payloads,
    "pdf_pages": pdf_pages,
    "every_kind": every_kind,
}
