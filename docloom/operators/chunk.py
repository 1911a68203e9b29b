"""Heading- and page-aware chunks of Markdown, over Arrow batches: a document's sections and paragraphs are packed one after
the other, so a fold is what they need, and no shuffle.  Lengths are UTF-8 bytes; no character is ever cut."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import WHITE

MAX_BYTES, OVERLAP = 2200, 150
_OPENS = re.compile(r"#+ ")
_MARKER = re.compile(rb"\f|<!-- page ")


def as_bytes(c: Column) -> Column:
    """One character a byte, so that positions and repeats count bytes."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def as_text(b: Column) -> Column:
    return F.decode(F.encode(b, "ISO-8859-1"), "UTF-8")


def split_sentences(c: Column, most: int = MAX_BYTES) -> Column:
    """Pieces of at most ``most`` bytes: the longest that ends a sentence (". ", "? ", "! "), else the longest whole characters."""
    rule = rf"(?s)\G(?:.{{1,{most}}}\z|.{{0,{most - 2}}}[.?!] |.{{1,{most}}}(?![\x80-\xBF]))"
    return F.transform(F.regexp_extract_all(as_bytes(c), F.lit(rule), F.lit(0)), as_text)


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def sentence_pieces(text: str, most: int) -> Iterator[str]:
    """``split_sentences`` of one text."""
    raw, at = text.encode(), 0
    while len(raw) - at > most:
        end = max(raw.rfind(mark, at, at + most) for mark in (b". ", b"? ", b"! ")) + 2
        if end < at + 2:
            end = at + most
            while raw[end] & 0xC0 == 0x80:
                end -= 1
        yield raw[at:end].decode()
        at = end
    if at < len(raw):
        yield raw[at:].decode()


def packed(body: str, most: int) -> Iterator[str]:
    """Paragraphs packed greedily, larger ones cut at sentences."""
    if size(body) <= most:
        yield body
        return
    held, length = "", 0
    for paragraph in [*body.split("\n\n"), None]:
        n = size(paragraph) if paragraph is not None else 0
        if held and (paragraph is None or length + 2 + n > most):
            yield from sentence_pieces(held, most) if length > most else (held,)
            held, length = "", 0
        if paragraph is not None:
            held, length = (held + "\n\n" + paragraph, length + 2 + n) if held else (paragraph, n)


def page_at(markers: list[int], offset: int) -> int:
    """1 and one more for each page marker that ends in the first ``offset`` bytes."""
    return 1 + sum(end <= offset for end in markers)


def text_sections(text: str) -> list[tuple[str | None, str, int | None, int | None]]:
    """(heading, body, first page, last page) of a trimmed text, blank bodies included.

    A section's place is where its heading line is next found; pages are null without page markers."""
    parts: list[list] = [[None, "", []]]  # heading, its line, the lines below
    for line in text.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        bare = line.strip(WHITE) if "#" in line else ""
        if bare and (opens := _OPENS.match(bare)):
            parts.append([bare[opens.end() :].strip(WHITE), bare, []])
        else:
            parts[-1][2].append(line)
    below = ["\n".join(lines) for _, _, lines in parts]
    if "\f" not in text and "<!-- page " not in text:
        return [(head, b.strip(WHITE), None, None) for (head, _, _), b in zip(parts, below, strict=True)]
    raw = text.encode()
    ends = [m.end() for m in _MARKER.finditer(raw)]
    places = [0]
    for _, line, _ in parts[1:]:
        found = raw.find(line.encode(), places[-1])
        places.append(found if found >= 0 else places[-1])
    out = []
    for k, ((head, _, lines), b) in enumerate(zip(parts, below, strict=True)):
        last = len(raw) if k + 1 == len(parts) else places[k] + size(b) + bool(lines)
        out.append((head, b.strip(WHITE), page_at(ends, places[k]), page_at(ends, last)))
    return out


def tail(text: str, least: int) -> str:
    """The last ``least`` bytes, or up to three more so that no character is cut."""
    if text.isascii():
        return text[-least:] if least else ""
    raw = text.encode()
    at = max(len(raw) - least, 0)
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return raw[at:].decode()


def text_chunks(md: str, most: int = MAX_BYTES, least: int = OVERLAP) -> list[tuple]:
    """(id, text, section, page_start, page_end, char_count, token_estimate) in order."""
    text = md.strip(WHITE)
    fragments = [
        (f, head if k == 0 or head is None else head + " (cont.)", first, last)
        for head, body, first, last in text_sections(text)
        if body
        for k, piece in enumerate(packed(body, most))
        if (f := piece.strip(WHITE))
    ]
    out = []
    for k, (f, section, first, last) in enumerate(fragments):
        whole = tail(fragments[k - 1][0], least) + "\n\n" + f if k else f
        out.append((f"c{k + 1:02d}" if first is None else f"p{first:02d}-c{k + 1:02d}", whole, section, first, last, size(f), size(whole) // 4))
    return out


FIELDS = {"id": pa.string(), "text": pa.string(), "section": pa.string(), "page_start": pa.int32(), "page_end": pa.int32(), "char_count": pa.int32(), "token_estimate": pa.int32()}
SECTION = {"heading": pa.string(), "body": pa.string(), "page_start": pa.int32(), "page_end": pa.int32()}


def _lists(found: list[list[tuple] | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """A list array of structs, column by column."""
    flat = list(zip(*(row for rows in found for row in rows or ()), strict=True)) or [()] * len(fields)
    at = pa.array(accumulate((len(rows or ()) for rows in found), initial=0), pa.int32())
    structs = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(flat, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(at, structs)


def _type(fields: dict[str, pa.DataType]) -> T.ArrayType:
    kinds = {pa.string(): T.StringType(), pa.int32(): T.IntegerType()}
    return T.ArrayType(T.StructType([T.StructField(k, kinds[t]) for k, t in fields.items()]))


@F.arrow_udf(_type(SECTION))
def _sections(texts: pa.Array) -> pa.Array:
    return _lists([text_sections(t or "") for t in texts.to_pylist()], SECTION)


@cache
def _chunker(most: int, least: int):
    @F.arrow_udf(_type(FIELDS))
    def run(texts: pa.Array) -> pa.Array:
        return _lists([text_chunks(t or "", most, least) for t in texts.to_pylist()], FIELDS)

    return run


def sections(md: Column) -> Column:
    """array of (heading, body, page_start, page_end), blank bodies included; ``md`` trimmed."""
    return _sections(md)


def chunks(md: Column, most: int = MAX_BYTES, least: int = OVERLAP) -> Column:
    """array of (id, text, section, page_start, page_end, char_count, token_estimate) in order; none for null."""
    return _chunker(most, least)(md)


def numbered_rows(all_: Column) -> Column:
    """A generator of ordinal (from 1) and the fields of chunks.  Inlined structs, as fields taken out of an exploded struct
    would be pushed below the generator and the chunks made once for each."""
    return F.inline(F.transform(all_, lambda c, i: F.struct((i + 1).alias("ordinal"), *[c[f].alias(f) for f in FIELDS])))


def chunk_rows(docs: DataFrame, key: str, text: str = "text", most: int = MAX_BYTES) -> DataFrame:
    """One row a chunk: key, ordinal from 1 and the chunk's fields."""
    made = docs.select(key, chunks(F.col(text), most).alias("__chunks"))
    return made.select(key, numbered_rows(F.col("__chunks")))
