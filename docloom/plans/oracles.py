"""DuckDB's SQL for the registered queries, written on its own."""

from __future__ import annotations

from docloom.plans.oracles_chunks import CACHE_HITS, CHUNKS, DOCUMENTS, EVENTS, paged
from docloom.plans.oracles_more import MAP_BOXES, NORMALIZE, embedded_only, escalation, exposition, page_ocr, reading_order

# Written out on their own, not taken from the code they check.
ROUTES = ["/health", "/metrics", "/v1/formats", "/v1/extract/url", "/v1/extract/bytes", "/v1/ocr", "unmatched"]
CACHE_ROUTES = ROUTES[3:5]
BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000, 5000]
FOLD_LONG = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st", 0x2014: "--", 0x2022: "* ", 0x2026: "...", 0xDF: "ss", 0xA9: "(c)", 0xAE: "(R)", 0x2122: "(TM)"}
FOLD_ONE = {"'": [0x2018, 0x2019, 0x201A, 0x2032], '"': [0x201C, 0x201D, 0x201E, 0x2033], "-": [0x2010 + k for k in (2, 3, 5)] + [0x2212], " ": [0xA0, 0x2007, 0x202F, 0x2060], ".": [0xB7], "x": [0xD7]}
FOLD_ONE |= {"A": range(0xC0, 0xC6), "C": [0xC7], "E": range(0xC8, 0xCC), "I": range(0xCC, 0xD0), "N": [0xD1], "O": [*range(0xD2, 0xD7), 0xD8], "U": range(0xD9, 0xDD), "Y": [0xDD]}
FOLD_ONE |= {"a": range(0xE0, 0xE6), "c": [0xE7], "e": range(0xE8, 0xEC), "i": range(0xEC, 0xF0), "n": [0xF1], "o": [*range(0xF2, 0xF7), 0xF8], "u": range(0xF9, 0xFD), "y": [0xFD, 0xFF]}
FOLD_DROP = [0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF, 0xB4, 0x60, 0x2CA, 0x2CB, 0xA8, 0x2C6, 0x2DC]

WS = r"[\pZ\t-\r\x{85}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> ''))"


def fold(c: str) -> str:
    for k, v in FOLD_LONG.items():
        c = f"replace({c}, {q(chr(k))}, {q(v)})"
    c = f"translate({c}, {q(''.join(chr(x) for v in FOLD_ONE.values() for x in v))}, {q(''.join(k * len(v) for k, v in FOLD_ONE.items()))})"
    for k in FOLD_DROP:
        c = f"replace({c}, {q(chr(k))}, '')"
    return f"regexp_replace(regexp_replace({c}, '[\\x{{300}}-\\x{{36f}}]', '', 'g'), '[^\\x00-\\x7f]', '?', 'g')"


LOG = """log AS (SELECT event_id, user_id, ts,
  CASE event_type WHEN 'view' THEN '/v1/extract/url' WHEN 'click' THEN '/v1/extract/bytes' WHEN 'purchase' THEN '/v1/ocr' WHEN 'signup' THEN '/health' ELSE 'unmatched' END AS route,
  CASE event_id % 10 WHEN 9 THEN 500 WHEN 8 THEN 400 ELSE 200 END AS status, CAST(floor(value * 20) AS BIGINT) AS latency_ms,
  event_id % 2 = 0 AS hit, event_id % 3 = 0 AS ocr_used FROM events)"""

PAGES = """pg AS (SELECT doc_id, k AS page_number, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)),
bad AS (SELECT doc_id, page_number, CASE WHEN page_number % 3 = 0 THEN '' WHEN page_number % 5 = 0 THEN repeat(chr(65533), 20) || text ELSE text END AS text FROM pg)"""

SCORED = f"""{PAGES},
counted AS (SELECT *, length({trim("text")}) AS char_count, length(text) AS raw, length(text) - length(replace(text, chr(65533), '')) AS broken FROM bad),
scored AS (SELECT *, coalesce(broken / nullif(raw, 0), 0.0) AS ratio FROM counted),
page AS (SELECT *, greatest(0.0, 1.0 - (CASE WHEN char_count < 50 THEN 0.5 ELSE 0 END) - (CASE WHEN ratio > 0.05 THEN 0.25 ELSE 0 END) - (CASE WHEN char_count = 0 THEN 0.25 ELSE 0 END))::DOUBLE AS score FROM scored),
doc AS (SELECT doc_id, count(*) AS page_count, avg(char_count) AS chars_per_page, median(char_count)::DOUBLE AS median_chars_per_page, avg((char_count < 50)::INT) AS empty_page_ratio,
  coalesce(sum(broken) / nullif(sum(raw), 0), 0.0) AS replacement_ratio, sum(char_count) = 0 AS missing_text_layer,
  coalesce(string_agg(CASE WHEN score <= 0.5 THEN page_number::VARCHAR END, ',' ORDER BY page_number), '') AS poor_pages FROM page GROUP BY doc_id),
judged AS (SELECT *, round(greatest(0.0, 1.0 - (CASE WHEN median_chars_per_page < 50 THEN 0.4 ELSE 0 END) - (CASE WHEN empty_page_ratio > 0.3 THEN 0.25 ELSE 0 END)
   - (CASE WHEN replacement_ratio > 0.05 THEN 0.2 ELSE 0 END) - (CASE WHEN missing_text_layer THEN 0.5 ELSE 0 END))::DOUBLE, 6) AS score,
  concat_ws(',', CASE WHEN median_chars_per_page < 50 THEN 'low_chars_per_page' END, CASE WHEN empty_page_ratio > 0.3 THEN 'high_empty_page_ratio' END,
   CASE WHEN replacement_ratio > 0.05 THEN 'replacement_characters' END, CASE WHEN missing_text_layer THEN 'missing_text_layer' END) AS triggers FROM doc),
decided AS (SELECT *, score < 0.5 OR triggers <> '' AS needs_escalation FROM judged)"""

BOXES = """b AS (SELECT l_orderkey AS image, l_linenumber AS ordinal, (l_partkey % 1000)::INT AS x, (l_linenumber * 20 + l_suppkey % 7)::INT AS y, (floor(l_quantity) + 1)::INT AS width,
  (12 + l_linenumber % 5)::INT AS height, 1 - l_discount AS confidence FROM lineitem)"""

SCORES = "s AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def field(name: str, value: str) -> str:
    return f"unhex(printf('%016x', {len(name)})) || encode('{name}') || unhex(printf('%016x', octet_length({value}))) || {value}"


def optional(name: str, value: str | None) -> str:
    there = field(f"{name}:present", "unhex('01')") if value else field(f"{name}:present", "unhex('00')")
    return f"{there} || {field(name, value)}" if value else there


def values(names: list[str]) -> str:
    return ", ".join(f"({q(n)})" for n in names)


ORACLES = {
    "doc_metadata": f"SELECT doc_id, {words('text')} AS word_count, strlen(text) AS char_count, strlen(text) // 4 AS token_estimate FROM documents",
    "pdf_text_fold": f"SELECT doc_id, md5({fold('text')}) AS folded_md5 FROM documents",
    "split_sentences": f"""WITH RECURSIVE f(doc_id, k, piece, rest) AS (
        SELECT doc_id, -1, '', {fold("text")} FROM documents
        UNION ALL
        SELECT doc_id, k + 1, left(rest, cut), substr(rest, cut + 1) FROM (
          SELECT doc_id, k, rest, CASE WHEN strlen(rest) <= 2200 THEN strlen(rest)
              WHEN greatest(d, e, x) > 0 THEN greatest(d, e, x) ELSE 2200 END AS cut FROM (
            SELECT *, CASE WHEN instr(v, ' .') > 0 THEN 2202 - instr(v, ' .') ELSE 0 END AS d, CASE WHEN instr(v, ' ?') > 0 THEN 2202 - instr(v, ' ?') ELSE 0 END AS e,
              CASE WHEN instr(v, ' !') > 0 THEN 2202 - instr(v, ' !') ELSE 0 END AS x FROM (SELECT doc_id, k, rest, reverse(left(rest, 2200)) AS v FROM f WHERE rest <> ''))))
      SELECT doc_id, k, strlen(piece) AS bytes, md5(piece) AS fragment_md5 FROM f WHERE k >= 0""".replace("2202 -", "2201 -"),
    "sections": f"""SELECT conv_id, role || ' ' || turn AS heading, strlen({trim("text")}) AS body_bytes, md5({trim("text")}) AS body_md5 FROM conversations WHERE {trim("text")} <> ''""",
    "titles": f"""SELECT conv_id, 'Conversation ' || conv_id AS title, 3 + sum(3 + {words("text")}) AS word_count FROM conversations GROUP BY conv_id""",
    "resolve_pages": f"""WITH n AS (SELECT *, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS name FROM pages)
      SELECT page_id, url AS canonical_url, 'text/html' AS mime, 'web' AS source_kind, CASE WHEN contains(name, '.') THEN name END AS resolved_filename,
        lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, strlen(html) AS bytes, NULL::VARCHAR AS error FROM n""",
    "upgrade_url": """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'https' ELSE 'http' END AS scheme, doc_id % 5 = 4 AS pdf, CASE doc_id % 3 WHEN 0 THEN '/?x=1' WHEN 1 THEN '#top' ELSE '' END AS tail FROM documents)
      SELECT doc_id, CASE WHEN pdf THEN scheme || '://arxiv.org/pdf/' || doc_id || tail ELSE scheme || '://arxiv.org/pdf/' || doc_id || '.pdf' END AS url,
        'a b+c%zz' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.html' ELSE '' END AS name, CASE WHEN doc_id % 2 = 0 THEN 'text/html' END AS by_extension FROM u""",
    "cache_key": f"""SELECT page_id,
        sha256({field("kind", "encode('url')")} || {field("url", "encode(url)")} || {field("mode", "encode('auto')")} || {optional("max_pages", None)}) AS url_key,
        sha256({field("kind", "encode('url')")} || {field("url", "encode(url)")} || {field("mode", "encode('auto')")} || {optional("max_pages", "encode((page_id % 9)::VARCHAR)")}) AS url_key_pages,
        sha256({field("kind", "encode('bytes')")} || {field("body", "encode(html)")} || {optional("mime", "encode('text/html')")} || {optional("filename", None)}) AS bytes_key FROM pages""",
    "page_quality": f"""WITH {SCORED} SELECT doc_id, page_number, char_count, round(ratio, 6) AS replacement_ratio, score, concat_ws(',', CASE WHEN char_count < 50 THEN 'low_chars_per_page' END,
        CASE WHEN ratio > 0.05 THEN 'replacement_characters' END, CASE WHEN char_count = 0 THEN 'missing_text_layer' END) AS triggers, score <= 0.5 AS needs_ocr FROM page""",
    "doc_quality": f"""WITH {SCORED} SELECT doc_id, page_count, round(chars_per_page, 6) AS chars_per_page, median_chars_per_page, round(empty_page_ratio, 6) AS empty_page_ratio,
        round(replacement_ratio, 6) AS replacement_ratio, missing_text_layer, poor_pages, score, triggers, needs_escalation FROM decided""",
    "escalation_plan": f"""WITH {SCORED} SELECT doc_id, CASE WHEN NOT needs_escalation THEN 'fast' WHEN doc_id % 4 >= 2 THEN 'pdfium' WHEN doc_id % 4 = 1 THEN 'embedded_image_ocr' ELSE 'fast' END AS plan,
        needs_escalation AND doc_id % 4 = 3 AS allow_ocr, needs_escalation AS has_reason FROM decided""",
    "page_repair": f"""WITH {PAGES}, fixed AS (SELECT doc_id, page_number, {trim("CASE WHEN length(pg.text) < 50 THEN coalesce(benchmark.text, pg.text) ELSE pg.text END")} AS text
        FROM pg LEFT JOIN benchmark ON item_id + 1 = page_number),
      md AS (SELECT doc_id, max(page_number) AS page_count, string_agg('<!-- page ' || page_number || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY page_number) AS m FROM fixed GROUP BY doc_id)
      SELECT doc_id, page_count, strlen(m) AS bytes, md5(m) AS markdown_md5 FROM md""",
    "web_extract": r"""WITH x AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages)
      SELECT page_id, trim(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&')) AS title,
        trim(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&amp;', '&')) AS first_heading FROM x""",
    "ndjson_tally": "SELECT conv_id, 1 AS heads, 1 AS ends, 'Conversation ' || conv_id AS title, true AS all_chunks FROM conversations GROUP BY conv_id",
    "formats": """SELECT * FROM (VALUES ('web', 'text/html', 'Web pages: main content by tags, as Markdown'), ('pdf', 'application/pdf', 'Page texts of a registered PDF engine'),
        ('markdown', 'text/markdown', 'Markdown passthrough with normalization'), ('plaintext', 'text/plain', 'Plain text with minimal processing')) f(kind, mime_types, description)""",
    "request_counts": f"WITH {LOG} SELECT route, status, count(*) AS requests FROM log GROUP BY ALL",
    "latency_histogram": f"""WITH {LOG}, r(route) AS (VALUES {values(ROUTES)}), l(le, b) AS (VALUES {", ".join(f"('{b}', {b})" for b in BOUNDS)}, ('+Inf', 9223372036854775807))
      SELECT r.route, le, count(log.route) AS cumulative FROM r CROSS JOIN l LEFT JOIN log ON log.route = r.route AND latency_ms <= b GROUP BY ALL""",
    "latency_totals": f"WITH {LOG}, r(route) AS (VALUES {values(ROUTES)}) SELECT r.route, coalesce(sum(latency_ms), 0)::BIGINT AS sum_ms, count(log.route) AS requests FROM r LEFT JOIN log USING (route) GROUP BY ALL",
    "hit_ratio": f"""WITH {LOG}, r(route) AS (VALUES {values(CACHE_ROUTES)}), c AS (SELECT r.route, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM r LEFT JOIN log USING (route) GROUP BY ALL)
      SELECT *, round(coalesce(hits / nullif(hits + misses, 0), 0.0), 6) AS ratio FROM c""",
    "ocr_counters": f"WITH {LOG} SELECT count(*) FILTER (WHERE route = '/v1/ocr') AS ocr_requests, count(*) FILTER (WHERE ocr_used) AS ocr_usage FROM log",
    "latency_summary": f"""WITH {LOG}, o AS (SELECT route, list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM log GROUP BY route)
      SELECT route, n, v[1] AS least, v[n] AS most, round(list_sum(v) / n, 6) AS mean, v[floor((n - 1) * 0.5 + 0.5)::INT + 1] AS p50, v[floor((n - 1) * 0.95 + 0.5)::INT + 1] AS p95, v[floor((n - 1) * 0.99 + 0.5)::INT + 1] AS p99 FROM o""",
    "lru_keep": f"""WITH {LOG}, last AS (SELECT user_id, max(event_id) AS last_touched, arg_max((latency_ms % 97) * 100 + 1, event_id) AS bytes FROM log GROUP BY user_id),
      r AS (SELECT *, row_number() OVER w AS k, sum(bytes) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM last WINDOW w AS (ORDER BY last_touched DESC))
      SELECT user_id, last_touched, bytes FROM r WHERE k <= 40 AND upto <= 120000""",
    "cache_miss": f"WITH {LOG} SELECT DISTINCT user_id FROM log WHERE hit AND user_id NOT IN (SELECT user_id FROM log WHERE status = 500)",
    "ctc_decode": f"""WITH {SCORES}, a AS (SELECT label, vec_id, list_max(e) AS p, len(e) - list_position(list_reverse(e), list_max(e)) AS i FROM s),
      l AS (SELECT *, lag(i) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM a), k AS (SELECT *, i > 0 AND i IS DISTINCT FROM before AS kept FROM l)
      SELECT label, coalesce(string_agg('t' || i, '' ORDER BY vec_id) FILTER (WHERE kept), '') AS text, count(*) FILTER (WHERE kept) AS tokens, round(coalesce(avg(p) FILTER (WHERE kept), 0), 6) AS confidence FROM k GROUP BY label""",
    "softmax_rows": f"""WITH {SCORES}, m AS (SELECT vec_id, e, list_max(e) AS top, list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) AS z FROM s)
      SELECT vec_id, len(e) - list_position(list_reverse(e), top) AS best, round(1 / z, 6) AS top,
        len(list_filter(e, lambda x: x < -0.01 OR x > 1.01)) = 0 AND (list_sum(e) = 0 OR abs(list_sum(e) - 1) <= 0.01) AS raw_looks, true AS softmax_looks FROM m""",
    "batch_slices": """WITH r AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS batch FROM embeddings)
      SELECT label, batch, count(*) AS n, min(vec_id) AS first FROM r GROUP BY ALL""",
    "image_dims": """WITH d AS (SELECT p_partkey, p_size * 37 AS w, p_partkey % 1500 + 1 AS h FROM part), r AS (SELECT *, CASE WHEN greatest(w, h) > 960 THEN 960.0::DOUBLE / greatest(w, h) ELSE 1 END AS k FROM d)
      SELECT p_partkey, least(greatest(ceil(48.0::DOUBLE * w / h), 1), 320)::INT AS rec_width, (greatest(floor((greatest(floor(w * k), 1) + 16) / 32), 1) * 32)::INT AS det_width,
        (greatest(floor((greatest(floor(h * k), 1) + 16) / 32), 1) * 32)::INT AS det_height FROM r""",
    "clamp_boxes": f"""WITH {BOXES}, c AS (SELECT image, ordinal, least(x, 900) AS x0, least(y, 130) AS y0, least(x + width, 900) AS x1, least(y + height, 130) AS y1, confidence FROM b)
      SELECT image, ordinal, x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height, round(least(greatest(confidence * 0.9::DOUBLE, 0), 1), 6) AS confidence FROM c WHERE x1 > x0 AND y1 > y0""",
    "largest_image": f"""WITH {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY width::BIGINT * height DESC, ordinal DESC) AS k FROM b)
      SELECT image, ordinal, width, height FROM r WHERE k = 1""",
    "normalize_text": NORMALIZE,
    "escalation_driver": escalation(PAGES, fold),
    "exposition": exposition(LOG, ROUTES, CACHE_ROUTES, BOUNDS),
    "reading_order": reading_order(BOXES),
    "db_boxes": MAP_BOXES,
    "image_decode": """WITH s AS (SELECT n_nationkey, ((6 * greatest(length(n_name), length(r_name)) + 76 + 31) // 32) * 32 AS w FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT n_nationkey, CASE WHEN n_nationkey % 6 <> 5 THEN w END AS width, CASE WHEN n_nationkey % 6 <> 5 THEN 224 END AS height, CASE WHEN n_nationkey % 6 <> 5 THEN w * 224 * 3 END AS bytes, n_nationkey % 6 = 5 AS failed FROM s""",
    "image_ocr": """SELECT n_nationkey, n_name AS title, n_name || chr(10) || r_name || chr(10) AS markdown, 1 AS page_count, 'image-ocr' AS pipeline_used, true AS ocr_used, 2 AS regions FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "base64_images": """WITH i AS (SELECT n_nationkey, n_name, unnest([0, 1, 2]) AS index FROM nation)
      SELECT n_nationkey, index, CASE WHEN index < 2 THEN n_name END AS text, CASE WHEN index = 2 THEN 'images[2]: ' || CASE n_nationkey % 4 WHEN 0 THEN 'image payload must not be empty' WHEN 1 THEN 'data URL is missing a comma separator'
        WHEN 2 THEN 'data URL must use an image MIME type' ELSE 'invalid base64 image payload' END END AS error FROM i""",
    "pdf_pages": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS page_number, regexp_replace(text, '[^ -~]', ' ', 'g') AS text FROM conversations""",
    "every_kind": """SELECT 'm' || conv_id AS id, 'markdown' AS source_kind, NULL AS error, NULL::INT AS page_count, 'markdown' AS pipeline_used, false AS scored FROM conversations GROUP BY conv_id
      UNION ALL SELECT 'w' || page_id, 'web', NULL, NULL, 'web', false FROM pages
      UNION ALL SELECT 'p' || conv_id, 'pdf', CASE WHEN conv_id % 7 = 6 THEN 'no document could be made of this pdf' END, CASE WHEN conv_id % 7 <> 6 THEN count(*) END, CASE WHEN conv_id % 7 <> 6 THEN 'pdf-fast' END, conv_id % 7 <> 6 FROM conversations GROUP BY conv_id
      UNION ALL SELECT 'i' || n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN 'plaintext' ELSE 'image' END, CASE WHEN n_nationkey % 6 = 5 THEN 'empty body' END, CASE WHEN n_nationkey % 6 <> 5 THEN 1 END, CASE WHEN n_nationkey % 6 <> 5 THEN 'image-ocr' END, false FROM nation""",
    "chunks": CHUNKS,
    "ndjson_events": EVENTS,
    "pdf_documents": paged(PAGES, fold),
    "document_json": DOCUMENTS,
    "page_ocr_documents": page_ocr(PAGES),
    "embedded_image_ocr": embedded_only(PAGES, fold),
    "health": "SELECT 'ok' AS status, true AS ready",
    "cache_hits": CACHE_HITS.replace("LOG", LOG),
    "selected_pages": f"WITH {PAGES} SELECT doc_id, count(*) AS pages, sum(page_number)::BIGINT AS numbers FROM pg WHERE doc_id % 3 <> 0 OR page_number % 2 = 1 GROUP BY doc_id",
}
