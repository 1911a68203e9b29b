"""Page texts and images of PDF files with the standard library: what is stored as text in plain or deflated streams.

Covered: object streams, page trees, Flate with PNG predictors, ToUnicode maps, Latin-1 otherwise; RGB and gray images of 8
bits.  Not covered: encryption, other filters, vertical writing.  A richer engine is registered in ``plans/plugins.py``."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import udtf

from docloom.sources.images import _unfiltered

_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%{}]*|[-+.0-9]+|[^\s<>\[\]()/%{}]+|[{})])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
WIDE = -200  # a step back of more than this many thousandths between strings is a space


class Ref(int):
    """A reference to an object, by number."""


class Name(str):
    """A name."""


class Word(bytes):
    """An operator or keyword."""


def _string(raw: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from behind its parenthesis, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at : at + 1]
        at += 1
        if c == b"\\":
            if octal := re.match(rb"[0-7]{1,3}", raw[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += octal.end()
                continue
            e = raw[at : at + 1]
            at += 2 if raw[at : at + 2] == b"\r\n" else 1
            out += b"" if e in (b"\r", b"\n") else _ESCAPES.get(e, e)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(raw: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators with where each ends; dictionaries and arrays are whole values."""
    stack: list[list] = []
    while m := _TOKEN.match(raw, at):
        t, at = m[1], m.end()
        value: object
        if t == b"(":
            value, at = _string(raw, at)
        elif t in (b"<<", b"["):
            stack.append([t])
            continue
        elif t in (b">>", b"]"):
            if not stack:
                continue
            kind, *items = stack.pop()
            value = items if kind == b"[" else dict(zip(items[::2], items[1::2]))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif t[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1"))
        elif re.fullmatch(rb"[-+]?(?:\d+\.?\d*|\.\d+)", t):
            value = float(t) if b"." in t else int(t)
        else:
            value = Word(t)
            if t == b"R" and stack and len(stack[-1]) > 2:
                value = Ref(stack[-1][-2])
                del stack[-1][-2:]
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class Pdf:
    """The objects of a file; ValueError if it is no PDF or has no pages."""

    def __init__(self, raw: bytes):
        if b"%PDF" not in raw[:1024]:
            raise ValueError("not a PDF")
        self.values: dict[int, object] = {}
        self.bodies: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", raw):
            value, end = next(tokens(raw, m.end()), (None, m.end()))
            self.values[int(m[1])] = value
            if isinstance(value, dict) and (s := re.match(rb"\s*stream\r?\n", raw[end : end + 32])):
                begin, size = end + s.end(), value.get("Length")
                if not isinstance(size, int) or isinstance(size, Ref) or not re.match(rb"\s*endstream", raw[begin + size : begin + size + 16]):
                    size = max(raw.find(b"endstream", begin) - begin, 0)
                self.bodies[int(m[1])] = raw[begin : begin + size]
        for n in [n for n, v in self.values.items() if isinstance(v, dict) and v.get("Type") == "ObjStm"]:
            body, head = self.stream(n), self.values[n]
            numbers = [v for v, _ in tokens(body[: head["First"]])]
            for k, at in zip(numbers[::2], numbers[1::2]):
                self.values.setdefault(k, next(tokens(body, head["First"] + at), (None, 0))[0])
        tops = [v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        self.pages = list(self._pages(tops[-1].get("Pages"), {}, 0)) if tops else []
        if not self.pages:
            raise ValueError("PDF without pages")

    def of(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.values.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        """A stream's bytes, unpacked."""
        head, body = self.values[number], self.bodies.get(number, b"")
        filters = self.of(head.get("Filter")) or []
        for f in [filters] if isinstance(filters, str) else filters:
            if f not in ("FlateDecode", "Fl"):
                raise ValueError(f"PDF filter {f} isn't covered")
            body = zlib.decompressobj().decompress(body)
        how = self.of(head.get("DecodeParms"))
        if isinstance(how, dict) and how.get("Predictor", 1) >= 10:
            step = max(1, how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
            line = -(-how.get("Columns", 1) * how.get("Colors", 1) * how.get("BitsPerComponent", 8) // 8)
            body = _unfiltered(np.frombuffer(body, np.uint8), len(body) // (line + 1), line, step).tobytes()
        return body

    def _pages(self, at, given: dict, depth: int) -> Iterator[dict]:
        node = self.of(at)
        if not isinstance(node, dict) or depth > 64:
            return
        node = {**given, **node}
        if "Kids" in node:
            below = {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "Rotate")}
            for kid in self.of(node["Kids"]) or []:
                yield from self._pages(kid, below, depth + 1)
        else:
            yield node

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = parts if isinstance(parts, Ref) and not isinstance(self.of(parts), list) else self.of(parts)
        return b"\n".join(self.stream(int(p)) for p in ([parts] if isinstance(parts, Ref) else parts or []))

    def resources(self, page: dict, kind: str) -> dict:
        return self.of((self.of(page.get("Resources")) or {}).get(kind)) or {}

    def fonts(self, page: dict) -> dict[str, dict[bytes, str]]:
        """ToUnicode maps by font name."""
        out = {}
        for name, ref in self.resources(page, "Font").items():
            font = self.of(ref)
            unicode = font.get("ToUnicode") if isinstance(font, dict) else None
            out[name] = _unicode_map(self.stream(int(unicode))) if isinstance(unicode, Ref) else {}
        return out


def _unicode_map(raw: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    held: list = []
    for value, _ in tokens(raw):
        if value == b"endbfchar":
            out.update({a: text(b) for a, b in zip(held[::2], held[1::2])})
        elif value == b"endbfrange":
            for a, z, to in zip(held[::3], held[1::3], held[2::3]):
                for k in range(int.from_bytes(a), int.from_bytes(z) + 1):
                    i = k - int.from_bytes(a)
                    out[k.to_bytes(len(a))] = text(to[i]) if isinstance(to, list) else text((int.from_bytes(to) + i).to_bytes(len(to)))
        held = [] if isinstance(value, Word) else [*held, value]
    return out


def _shown(raw: bytes, known: dict[bytes, str]) -> str:
    if not known:
        return raw.decode("cp1252", "replace")
    size = max(map(len, known))
    return "".join(known.get(raw[i : i + size], "�") for i in range(0, len(raw), size))


def page_text(pdf: Pdf, page: dict) -> str:
    """The strings that a page shows, in order; a move to another line is a line break."""
    fonts, known = pdf.fonts(page), {}
    out, held, line = [], [], None

    def moved(y) -> None:
        nonlocal line
        if out and y != line:
            out.append("\n")
        line = y

    for value, _ in tokens(pdf.content(page)):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == b"Tf" and len(held) > 1:
            known = fonts.get(held[-2], {})
        elif value in (b"Td", b"TD") and len(held) > 1 and held[-1]:
            moved((line or 0) + held[-1])
        elif value == b"Tm" and len(held) > 5:
            moved(held[-1])
        elif value in (b"T*", b"'", b'"'):
            moved((line or 0) - 1)
        if value in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
            out.append(_shown(held[-1], known))
        elif value == b"TJ" and held and isinstance(held[-1], list):
            out += [_shown(p, known) if isinstance(p, bytes) else " " * (p < WIDE) for p in held[-1] if isinstance(p, bytes | int | float)]
        held = []
    return "".join(out).strip("\n")


def page_texts(raw: bytes) -> list[str]:
    pdf = Pdf(raw)
    return [page_text(pdf, p) for p in pdf.pages]


def page_images(raw: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(page from 1, ordinal from 0, pixels) of the images that can be unpacked."""
    pdf, out = Pdf(raw), []
    for number, page in enumerate(pdf.pages, 1):
        for ordinal, ref in enumerate(pdf.resources(page, "XObject").values()):
            head = pdf.of(ref)
            planes = {"DeviceRGB": 3, "DeviceGray": 1}.get(pdf.of(head.get("ColorSpace")) if isinstance(head, dict) else None)
            if planes and head.get("Subtype") == "Image" and head.get("BitsPerComponent") == 8:
                try:
                    flat = np.frombuffer(pdf.stream(int(ref)), np.uint8)
                    pixels = flat[: head["Height"] * head["Width"] * planes].reshape(head["Height"], head["Width"], planes)
                except ValueError:
                    continue
                out.append((number, ordinal, np.repeat(pixels, 3, 2) if planes == 1 else pixels))
    return out


def engine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ``page_text`` engine: (key, raw) to (key, page_number, text); a file that can't be read has no pages."""
    for batch in batches:
        keys, numbers, texts = [], [], []
        for k, body in enumerate(batch.column(1)):
            try:
                found = page_texts(body.as_py() or b"")
            except (ValueError, zlib.error):
                found = []
            keys += [k] * len(found)
            numbers += range(1, len(found) + 1)
            texts += found
        columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[0], "page_number", "text"])


def pages(files: DataFrame, key: str, raw: str) -> DataFrame:
    """key, page_number, text of PDF files."""
    return files.select(key, raw).mapInArrow(engine, f"`{key}` {dict(files.dtypes)[key]}, page_number int, text string")


class PdfPages:
    """The table function ``pdf_pages(raw)``: page_number and text."""

    def eval(self, raw: bytes):
        try:
            found = page_texts(bytes(raw or b""))
        except (ValueError, zlib.error):
            found = []
        for number, text in enumerate(found, 1):
            yield number, text


def register(spark) -> None:
    """Makes ``pdf_pages`` known to SQL: SELECT d.*, p.* FROM d, LATERAL pdf_pages(d.raw) p."""
    spark.udtf.register("pdf_pages", udtf(PdfPages, returnType="page_number int, text string"))
