import zlib

import numpy as np
import pytest

from docloom.plans import pdf as P
from docloom.sources import pdf_text as X


def file(objects, packed=()):
    """A PDF of object bodies by number; those in ``packed`` go into an object stream."""
    out = b"%PDF-1.5\n"
    if packed:
        parts = [(n, objects.pop(n)) for n in packed]
        heads, body = [], b""
        for n, o in parts:
            heads.append(b"%d %d" % (n, len(body)))
            body += o + b" "
        head = b" ".join(heads) + b" "
        data = zlib.compress(head + body)
        objects[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(parts), len(head), len(data), data)
    for n, o in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, o)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(body, head=b""):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)


def sample():
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange 1 beginbfrange <0005> <0006> [<00E9> <D835DD54>] endbfrange"
    two = zlib.compress(b"BT /F2 9 Tf 1 0 0 1 50 700 Tm <000100020003> Tj 1 0 0 1 50 680 Tm <00050006> Tj ET")
    image = bytes(range(60))
    rows = b"".join(b"\x01" + bytes([r[0], *((b - a) % 256 for a, b in zip(r, r[1:]))]) for r in (image[i : i + 12] for i in range(0, 60, 12)))
    return {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 20 0 R] /Count 3 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        20: b"<< /Type /Pages /Kids [4 0 R 5 0 R] /Count 2 /Parent 2 0 R >>",
        3: b"<< /Type /Page /Contents [10 0 R 11 0 R] >>",
        4: b"<< /Type /Page /Contents 12 0 R >>",
        5: b"<< /Type /Page /Resources << /XObject << /I0 14 0 R /I1 15 0 R /I2 16 0 R >> >> >>",
        7: b"<< /Type /Font >>",
        8: b"<< /Type /Font /ToUnicode 13 0 R >>",
        10: stream(b"BT /F1 12 Tf 72 720 Td (Hello \\(wor\\154d\\)) Tj 0 -14 Td [(Sp) -50 (lit) -400 (words)] TJ ET"),
        11: stream(b"BT /F1 12 Tf (caf\xe9) ' T* (end) Tj ET"),
        12: stream(two, b"/Filter /FlateDecode"),
        13: stream(cmap),
        14: stream(image, b"/Subtype /Image /Width 4 /Height 5 /BitsPerComponent 8 /ColorSpace /DeviceRGB"),
        15: stream(zlib.compress(rows), b"/Subtype /Image /Width 12 /Height 5 /BitsPerComponent 8 /ColorSpace /DeviceGray /Filter [/FlateDecode] /DecodeParms << /Predictor 15 /Columns 12 >>"),
        16: stream(b"...", b"/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /Filter /DCTDecode"),
    }


@pytest.mark.parametrize("packed", [(), (2, 20, 3, 4, 7, 8)])
def test_page_texts_and_images(packed):
    raw = file(sample(), packed)
    assert X.page_texts(raw) == ["Hello (world)\nSplit words\ncafé\nend", "Abc\né𝕔".replace("𝕔", "\U0001d554"), ""]
    found = X.page_images(raw)
    assert [(p, o, i.shape) for p, o, i in found] == [(3, 0, (5, 4, 3)), (3, 1, (5, 12, 3))]
    assert found[0][2].tobytes() == bytes(range(60)) and (found[1][2][:, :, 1] == np.arange(60).reshape(5, 12)).all()
    for bad in (b"", b"hello", b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj"):
        with pytest.raises(ValueError):
            X.Pdf(bad)


def test_files_as_rows(spark):
    rows = spark.createDataFrame([(1, file(sample())), (2, b"junk"), (3, None)], "id int, raw binary")
    assert [(r["id"], r["page_number"], r["text"]) for r in X.pages(rows, "id", "raw").orderBy("page_number").collect()][1] == (1, 2, "Abc\né\U0001d554")
    X.register(spark)
    rows.createOrReplaceTempView("files")
    assert spark.sql("SELECT count(*) c FROM files, LATERAL pdf_pages(raw)").first()["c"] == 3


GOOD = "A page with quite enough text to stand for itself, and more than that; long enough to lift the median of two pages."
PAGES = "k int, page_number int, text string"
READ = PAGES + ", width int, height int"


def decided(spark, fast, **engines):
    make = lambda rows, schema: spark.createDataFrame([(1, n + 1, t, *([100, 200] if schema == READ else [])) for n, t in enumerate(rows) if t is not None], schema)
    given = {k: v if isinstance(v, str) else make(v, PAGES if k == "rich" else READ) for k, v in engines.items()}
    r = P.decide(make(fast, PAGES), "k", **given).first()
    return r["pipeline_used"], r["fallback_reason"], [p["text"] for p in r["pages"]], round(r["text_quality_score"], 2), [m["alt"] for m in r["image_manifest"] or []]


def test_escalation_by_hand(spark):
    good = lambda n: [GOOD] * n
    assert decided(spark, good(2)) == ("pdf-fast", None, good(2), 1.0, [])
    base = "fast PDF text quality 0.00 triggered escalation: low chars/page (avg 0.0, median 0.0), high empty-page ratio (100%), missing text layer"
    none = "no engine is registered"
    assert decided(spark, ["", ""])[:2] == ("pdf-fast", f"{base}; rich extraction unavailable: {none}; OCR unavailable: {none}")
    assert decided(spark, ["", ""], rich=good(2)) == ("pdf-pdfium", f"{base}; rich text extraction improved quality to 1.00", good(2), 1.0, [])
    assert decided(spark, ["", ""], rich=[GOOD, ""], ocr_reason="no model")[:2] == ("pdf-pdfium", f"{base}; rich text quality 0.75 still has poor pages [2]; OCR unavailable: no model")
    got = decided(spark, ["", ""], rich=[GOOD, "x"], rendered=[GOOD + "!", GOOD + "?"])
    assert got == ("pdf-pdfium-ocr", f"{base}; rich text quality 0.75; selective OCR repaired 1/1 poor page(s)", [GOOD, GOOD + "?"], 1.0, ["rendered page image for page 2 (100x200)"])
    got = decided(spark, ["", ""], rich=["x", GOOD], rendered=["", None])
    assert got[:3] == ("pdf-pdfium-ocr", f"{base}; rich text quality 0.75; selective OCR repaired 1/1 poor page(s)", ["", GOOD])
    one = "fast PDF text quality 0.75 triggered escalation: high empty-page ratio (33%)"
    assert decided(spark, [GOOD, GOOD, ""], rich=["", "", "y"], rendered=["", "", ""])[:2] == ("pdf-pdfium", f"{one}; rich text quality 0.35; selective OCR on 3 page(s) did not improve quality")
    assert decided(spark, [GOOD, GOOD, ""], rich=["", "z", "y"], rendered=["a", "b", "c"])[:3] == ("pdf-fast", f"{one}; selective OCR quality 0.35 did not beat fast-path quality 0.75", [GOOD, GOOD, ""])
    assert decided(spark, [GOOD, GOOD, ""], rich=["", "z", "y"])[0] == "pdf-fast"
    assert decided(spark, ["", ""], rich=[None, None], embedded=good(2))[:2] == ("pdf-embedded-image-ocr", f"{base}; rich extraction failed: rich extraction returned no pages; embedded-image OCR repaired 2/2 page(s)")
    got = decided(spark, ["", "é"], embedded=[GOOD, None], rich_reason="no library")
    assert got[0] == "pdf-embedded-image-ocr" and got[2:] == ([GOOD, "e"], 0.75, ["embedded PDF page image for page 1 (100x200)"])
    assert got[1].endswith("; rich extraction unavailable: no library; embedded-image OCR repaired 1/2 page(s)")
    assert decided(spark, [GOOD, GOOD, ""], embedded=["", "", ""])[:2] == ("pdf-fast", f"{one}; rich extraction unavailable: {none}; embedded-image OCR could not improve the document")
