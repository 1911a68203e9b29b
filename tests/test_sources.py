from pyspark.sql import functions as F

from docloom.operators.metrics import nearest_rank
from docloom.plans.pipelines import dispatch
from docloom.plans.plugins import Registry, Settings
from docloom.sources import resolve as R
from docloom.streaming.documents import stream_events, stream_metrics


def values(spark, items, kind, c):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", c(F.col("x"))).collect(), key=lambda r: r[0])]


def test_sniff(spark):
    given = [b"%PDF-1", b"\x89PNG..", b"\xff\xd8\xff\xe0", b"RIFF1234WEBP", b"  <!DOCTYPE html", b"\n<HTML>", b"## x", b"abc", b"abcd", b""]
    assert values(spark, given, "binary", R.sniff) == ["application/pdf", "image/png", "image/jpeg", "image/webp", "text/html", "text/html", "text/markdown", None, None, None]


def test_kinds(spark):
    given = ["Text/HTML; charset=x", "application/pdf", "text/x-markdown", "text/plain", "image/png", "application/zip", ""]
    assert values(spark, given, "string", R.classify_mime) == ["web", "pdf", "markdown", "plaintext", "image", "plaintext", "plaintext"]


def test_names(spark):
    assert values(spark, ["http://h/a%20b.pdf?x=/y", "http://h/dir/", "http://h/x#y.z", "http://h/plain"], "string", R.filename_from_url) == ["a b.pdf", None, "x#y.z", None]
    given = ['attachment; filename="a.txt"; filename*=UTF-8\'\'b%C3%A9.txt', "attachment; filename=c.md", "inline", 'x; filename=""']
    assert values(spark, given, "string", R.filename_from_disposition) == ["bé.txt", "c.md", None, None]
    assert values(spark, ["a+b", "%zz%41%", "%E9"], "string", R.percent_decode) == ["a+b", "%zzA%", "�"]


def test_base64(spark):
    assert values(spark, ["aGk=", " aGk ", "data:image/png;base64,aGk=", "", "!!"], "string", R.decode_base64) == [b"hi", b"hi", b"hi", None, None]


def test_upgrade(spark):
    given = ["https://arxiv.org/abs/1.2/?q#f", "http://arxiv.org/abs/x", "https://arxiv.org/abs/", "https://other.org/abs/1"]
    assert values(spark, given, "string", R.upgrade_url) == ["https://arxiv.org/pdf/1.2.pdf", "http://arxiv.org/pdf/x.pdf", "https://arxiv.org/abs/", "https://other.org/abs/1"]


def test_dispatch(spark, tmp_path):
    rows = [(1, "http://h/a.md", b"# T\n\nbody"), (2, "http://h/x", b"<html><title>A &amp; B</title><body><nav>n</nav><p>x<p><b>y</b> <a href='/z'>z</a><ul><li>i</ul></body>"), (3, "http://h/y.txt", b"")]
    out = {r["id"]: r for r in dispatch(R.resolve(spark.createDataFrame(rows, "id int, u string, b binary"), "b", url="u")).collect()}
    assert (out[1]["title"], out[1]["source_kind"], out[1]["chunks"][0]["text"]) == ("T", "markdown", "body")
    assert (out[2]["title"], out[2]["markdown"]) == ("A & B", "x\n\n**y** [z](/z)\n\n- i\n")
    assert (out[3]["error"], out[3]["markdown"], out[3]["chunks"]) == ("empty body", "\n", [])
    (tmp_path / "a.md").write_text("# F")
    assert R.read_files(spark, str(tmp_path)).first()["source_kind"] == "markdown"


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 1, 9)] + [("b", 7)], "r string, v int")
    got = {r["r"]: (r["n"], r["least"], r["most"], r["p"]) for r in nearest_rank(df, "r", "v", {"p": 0.5}).collect()}
    assert got == {"a": (4, 1, 9, 5), "b": (1, 7, 7, 7)}


def test_plugins(spark):
    r = Registry()
    rows = spark.createDataFrame([(1, b"x")], "id int, raw_bytes binary")
    try:
        r.run("page_text", rows, "id")
        raise AssertionError
    except LookupError as e:
        assert "page_text" in str(e)

    def engine(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "page_number": pa.array([1] * len(b), pa.int32()), "text": ["t"] * len(b)})

    r.register("page_text", "plain", engine)
    assert r.available("page_text") and [tuple(x) for x in r.run("page_text", rows, "id").collect()] == [(1, 1, "t")]
    assert Settings(max_batch=0).normalized().max_batch == 16 and Settings.flag(" On ") and not Settings.flag("0")


def test_streams(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(1, b"# A\n\nx", at, "/health", 200, 7), (2, b"# A\n\nx", at, "/health", 200, 70), (3, b"y", at, "/v1/ocr", 500, 7000)]
    spark.createDataFrame(rows, "id int, b binary, ts timestamp, route string, status int, latency_ms bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id int, b binary, ts timestamp, route string, status int, latency_ms bigint").parquet(str(tmp_path / "in"))
    q = stream_events(source(), "id", "b", "ts").writeStream.format("memory").queryName("ev").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r[0] for r in spark.sql("select count(*) from ev group by id").collect()) == [3, 3]
    q = stream_metrics(source(), "ts").writeStream.format("memory").queryName("me").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["route"], r["requests"], r["le_50"]) for r in spark.sql("select * from me").collect()) == [("/health", 2, 1), ("/v1/ocr", 1, 0)]


def test_fetched_sources(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from docloom.sources import fetch

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body, kind, name = {"/a": (b"# T", "text/markdown; charset=utf-8", None), "/b": (b"%PDF-1.4", "application/octet-stream", 'attachment; filename="x.bin"'), "/empty": (b"", "text/plain", None), "/d.html": (b"<p>x", None, None)}.get(self.path, (None, None, None))
            self.send_response(404 if body is None else 200)
            for k, v in (("Content-Type", kind), ("Content-Disposition", name)):
                if v:
                    self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        rows = spark.createDataFrame([(i, u) for i, u in enumerate([f"{base}/a", f"{base}/b", f"{base}/empty", f"{base}/d.html", f"{base}/none", "ftp://x/y", None])], "id int, u string")
        got = fetch.resolve_urls(rows, "u", timeout=5.0).orderBy("id").collect()
        assert [r["source_kind"] for r in got[:4]] == ["markdown", "pdf", "plaintext", "web"]
        assert (got[1]["resolved_filename"], got[3]["resolved_filename"], got[2]["error"], got[0]["error"]) == ("x.bin", "d.html", "empty body", None)
        assert all(r["error"].startswith("fetch failed: ") for r in got[4:])
        assert bytes(got[0]["raw_bytes"]) == b"# T" and fetch.get(f"{base}/a", 5.0, 2)[3].endswith("more than 2 bytes")
    finally:
        server.shutdown()


def test_small_things(spark, tmp_path):
    from docloom.functions import text as T
    from docloom.operators import cache, metrics, pages
    from docloom.plans.plugins import dictionary

    assert values(spark, ["/health", "/v1/ocr", "/nope", None], "string", metrics.route_label) == ["/health", "/v1/ocr", "unmatched", "unmatched"]
    assert values(spark, [b"ok", b"\xff\xfe", b"a\xc3", "é".encode()], "binary", T.decode_lossy) == ["ok", "��", "a�", "é"]
    one = spark.createDataFrame([("k", "é", None, [("t", "c01", None), ("é", "c02", "s")], 3, 4.0, 4.05)], "k string, a string, b string, c array<struct<text:string,id:string,section:string>>, n int, x double, y double")
    size = cache.entry_size(F.col("k"), [F.col("a"), F.col("b")], F.col("c"))
    same = pages.same_dimensions(F.col("x"), F.col("x"), F.col("y"), F.col("x"))
    none = pages.same_dimensions(F.col("x"), F.col("x"), F.lit(None).cast("double"), F.col("x"))
    far = pages.same_dimensions(F.col("x"), F.col("x"), F.col("y") + 0.1, F.col("x"))
    alt = pages.image_manifest("rendered page image", F.col("n"), F.lit(10), F.lit(20))["alt"]
    assert tuple(one.select(size, same, none, far, alt).first()) == (1 + 2 + 4 + 6, True, False, False, "rendered page image for page 3 (10x20)")
    (tmp_path / "d.txt").write_text("a\nb\n")
    assert dictionary(spark, str(tmp_path / "d.txt")) == ["", "a", "b"]
