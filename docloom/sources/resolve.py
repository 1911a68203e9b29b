"""Sources: fetched or given bytes, their MIME type and kind, file names, URLs and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import trim

# MIME types by file extension, those that a kind depends on and their usual neighbours.
EXTENSIONS = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "pdf": "application/pdf", "md": "text/markdown", "markdown": "text/markdown",
    "txt": "text/plain", "text": "text/plain", "log": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "text/xml", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml",
}
UNKNOWN = "application/octet-stream"


def essence(mime: Column) -> Column:
    return trim(F.substring_index(mime, ";", 1))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once, where it would else be written out for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def classify_mime(mime: Column) -> Column:
    def kind(m: Column) -> Column:
        return (
            F.when(m.isin("text/html", "application/xhtml+xml"), "web")
            .when(m == "application/pdf", "pdf")
            .when(m.isin("text/markdown", "text/x-markdown"), "markdown")
            .when(m.startswith("image/"), "image")
            .otherwise("plaintext")
        )

    return _let(F.lower(essence(mime)), kind)


def sniff(raw: Column) -> Column:
    """MIME type by the first bytes, or null."""
    text = F.lower(F.make_valid_utf8(F.substring(raw, 1, 256).cast("string")))
    text = F.regexp_replace(text, r"(?U)\A\s+", "")

    def known(head: Column) -> Column:
        return (
            F.when(head.startswith("25504446"), "application/pdf")
            .when(head.startswith("89504E47"), "image/png")
            .when(head.startswith("FFD8FF"), "image/jpeg")
            .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
            .when(text.rlike(r"\A(?:<html|<!doctype)"), "text/html")
            .when(head.rlike(r"\A(?:23){1,3}20"), "text/markdown")
        )

    return F.when(F.octet_length(raw) >= 4, _let(F.hex(F.substring(raw, 1, 12)), known))


def by_extension(filename: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.try_element_at(known, F.lower(F.nullif(F.regexp_extract(filename, r"[^./]\.([^./]+)\z", 1), F.lit(""))))


def determine_mime(content_type: Column, filename: Column, raw: Column) -> Column:
    """Header, then extension, then first bytes."""
    header = _let(essence(content_type), lambda h: F.when((h != "") & (h != UNKNOWN), h))
    return F.coalesce(header, by_extension(filename), sniff(raw), F.lit(UNKNOWN))


def percent_decode(c: Column) -> Column:
    """%XX to bytes, lossy UTF-8; + and malformed escapes stay."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def filename_from_url(url: Column) -> Column:
    name = percent_decode(F.substring_index(F.substring_index(url, "?", 1), "/", -1))
    return F.when(name.contains("."), name)


def filename_from_disposition(header: Column) -> Column:
    """filename*= before filename=."""
    rest = F.transform(F.split(header, ";"), trim)
    rest = F.slice(rest, F.lit(2), F.size(rest))
    wide = F.filter(F.transform(F.filter(rest, lambda p: p.startswith("filename*=")), lambda p: percent_decode(F.split_part(p, F.lit("''"), F.lit(2)))), lambda n: n != "")
    plain = F.filter(rest, lambda p: p.startswith("filename="))
    plain = F.filter(F.transform(plain, lambda p: trim(F.regexp_replace(F.substr(p, F.lit(10)), r'\A"+|"+\z', ""))), lambda n: n != "")
    return F.coalesce(F.get(wide, F.lit(0)), F.get(plain, F.lit(0)))


def upgrade_url(url: Column) -> Column:
    """Abstract pages of a preprint server become their PDF."""
    scheme = F.regexp_extract(url, r"\A(https?)://arxiv\.org/abs/", 1)
    name = F.regexp_replace(F.regexp_extract(url, r"\Ahttps?://arxiv\.org/abs/([^?#]*)", 1), r"/+\z", "")
    return F.when(name != "", F.concat(scheme, F.lit("://arxiv.org/pdf/"), name, F.lit(".pdf"))).otherwise(url)


def host_key(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def decode_base64(c: Column) -> Column:
    """Bytes of base64 with or without padding and a data:image prefix; null if empty or malformed."""
    body = F.regexp_replace(trim(c), r"\Adata:image/[^,]*;base64,", "")
    return F.when(body != "", F.try_to_binary(body, F.lit("base64")))


def _field(name: str, value: Column) -> Column:
    size = lambda n: F.unhex(F.lpad(F.hex(n), 16, "0"))
    raw = value.cast("binary")
    return F.concat(size(F.lit(len(name)).cast("bigint")), F.lit(name).cast("binary"), size(F.octet_length(raw).cast("bigint")), raw)


def _optional(name: str, value: Column) -> Column:
    there = F.concat(_field(f"{name}:present", F.unhex(F.lit("01"))), _field(name, value))
    return F.when(value.isNotNull(), there).otherwise(_field(f"{name}:present", F.unhex(F.lit("00"))))


def url_cache_key(url: Column, mode: Column, max_pages: Column) -> Column:
    """SHA-256 over length-prefixed fields, of the URL as given."""
    return F.sha2(F.concat(_field("kind", F.lit("url")), _field("url", url), _field("mode", trim(mode)), _optional("max_pages", max_pages.cast("string"))), 256)


def bytes_cache_key(body: Column, mime: Column, filename: Column) -> Column:
    kind = F.nullif(F.lower(essence(mime)), F.lit(""))
    return F.sha2(F.concat(_field("kind", F.lit("bytes")), _field("body", body), _optional("mime", kind), _optional("filename", filename)), 256)


def resolve(rows: DataFrame, raw: str, url: str | None = None, content_type: str | None = None, filename: str | None = None) -> DataFrame:
    """``rows`` with canonical_url, source_kind, mime, filename, raw_bytes and error ("empty body" for no bytes)."""
    null = F.lit(None).cast("string")
    address = upgrade_url(F.col(url)) if url else null
    name = F.coalesce(F.col(filename) if filename else null, filename_from_url(address))
    mime = determine_mime(F.col(content_type) if content_type else null, name, F.col(raw).cast("binary"))
    out = rows.withColumns({"canonical_url": address, "mime": mime, "resolved_filename": name, "raw_bytes": F.col(raw).cast("binary")})
    return out.withColumns({"source_kind": classify_mime(F.col("mime")), "error": F.when(F.octet_length("raw_bytes") == 0, "empty body")})


def read_files(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as sources."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return resolve(files.withColumn("name", F.substring_index("path", "/", -1)), "content", filename="name")
