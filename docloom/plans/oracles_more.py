"""More of DuckDB's SQL for the registered queries: normalization, escalation, exposition, reading order, map boxes.

Written from the documented rules: windows and recursion where the engine folds."""

from __future__ import annotations

WS = r"[\pZ\t-\r\x{85}]"

# Lines spoiled by id and place, then judged by windows: fences by their running count, blank runs as gaps and islands.
NORMALIZE = rf"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
d AS (SELECT doc_id, string_agg(CASE (doc_id + i) % 7 WHEN 0 THEN x || '<br>tail  ' WHEN 1 THEN '<div>' || x || '</div><B>bold</B>' WHEN 2 THEN '## H ' || i || chr(10) || x
  WHEN 3 THEN x || repeat(chr(10), (doc_id % 5 + 1)::BIGINT) WHEN 4 THEN replace(x, ' ', chr(160)) || chr(13) WHEN 5 THEN '```' || chr(10) || x || '   ' || repeat(chr(10), 4) || '```' ELSE x END, chr(10) ORDER BY i) AS md
  FROM x GROUP BY doc_id),
s AS (SELECT doc_id, string_split(replace(md, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM d),
l AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM s),
f AS (SELECT *, regexp_matches(raw, '^{WS}*```') AS fence FROM l),
c AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
t AS (SELECT *, CASE WHEN NOT fence AND NOT inside THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw,
    '<(?:br|hr|BR|HR)(?: ?/)?>|</?(?:p|div|section|article|header|footer|nav|main|aside|P|DIV)>', chr(10), 'g'), '</?(?:span|b|i|em|strong|u|s|del|ins|SPAN|B|I|EM|STRONG)>', '', 'g'),
    '[\x{{A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g'), '{WS}+$', '') END AS text FROM c),
k AS (SELECT *, coalesce(text = '', false) AS blank, coalesce(i > 1 AND regexp_matches(text, '^{WS}*#{{1,6}}(?: |\z)'), false) AS heading FROM t),
g AS (SELECT *, sum((NOT blank)::INT) OVER w AS grp, lag(blank) OVER w AS after_blank, lag(heading) OVER w AS after_heading FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, blank ORDER BY i) AS place, bool_or(heading) OVER (PARTITION BY doc_id, grp) AS under FROM g),
o AS (SELECT doc_id, i, CASE WHEN fence THEN CASE WHEN NOT inside AND i > 1 AND NOT after_blank AND NOT after_heading THEN chr(10) ELSE '' END || regexp_replace(raw, '{WS}+$', '')
  WHEN inside THEN raw WHEN heading THEN CASE WHEN after_blank OR after_heading THEN '' ELSE chr(10) END || text || chr(10) ELSE text END AS piece
  FROM r WHERE NOT blank OR place + under::INT <= 2)
SELECT doc_id, regexp_replace(regexp_replace(string_agg(piece, chr(10) ORDER BY i), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g') || chr(10) AS markdown FROM o GROUP BY doc_id"""


def exposition(log: str, routes: list[str], cached: list[str], bounds: list[int], prefix: str = "docloom") -> str:
    """Five blocks of lines, each after its type: labels by route, then by status or bound."""
    named = lambda names: ", ".join(f"({k}, '{n}')" for k, n in enumerate(names))
    les = ", ".join([*[f"({k}, '{b}', {b})" for k, b in enumerate(bounds)], f"({len(bounds)}, '+Inf', 9223372036854775807)"])
    heads = [("requests_total", "counter"), ("request_duration_ms", "histogram"), ("cache_hits_total", "counter"), ("cache_misses_total", "counter"), ("cache_hit_ratio", "gauge")]
    types = " UNION ALL ".join(f"SELECT {2 * k} AS a, '' AS b, 0 AS c, '# TYPE {prefix}_{n} {t}' AS line" for k, (n, t) in enumerate(heads))
    return f"""WITH {log}, r(k, route) AS (VALUES {named(routes)}), ca(k, route) AS (VALUES {named(cached)}), le(k, le, b) AS (VALUES {les}),
h AS (SELECT ca.k, ca.route, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM ca LEFT JOIN log USING (route) GROUP BY ALL),
u AS ({types}
  UNION ALL SELECT 1, route || chr(0) || status, 0, '{prefix}_requests_total{{route="' || route || '",status="' || status || '"}} ' || count(*) FROM log GROUP BY route, status
  UNION ALL SELECT 3, r.k::VARCHAR, le.k, '{prefix}_request_duration_ms_bucket{{route="' || r.route || '",le="' || le || '"}} ' || count(log.route)
    FROM r CROSS JOIN le LEFT JOIN log ON log.route = r.route AND latency_ms <= b GROUP BY r.k, r.route, le.k, le
  UNION ALL SELECT 3, r.k::VARCHAR, 100, '{prefix}_request_duration_ms_sum{{route="' || r.route || '"}} ' || coalesce(sum(latency_ms), 0)::BIGINT FROM r LEFT JOIN log USING (route) GROUP BY r.k, r.route
  UNION ALL SELECT 3, r.k::VARCHAR, 101, '{prefix}_request_duration_ms_count{{route="' || r.route || '"}} ' || count(log.route) FROM r LEFT JOIN log USING (route) GROUP BY r.k, r.route
  UNION ALL SELECT 5, k::VARCHAR, 0, '{prefix}_cache_hits_total{{route="' || route || '"}} ' || hits FROM h
  UNION ALL SELECT 7, k::VARCHAR, 0, '{prefix}_cache_misses_total{{route="' || route || '"}} ' || misses FROM h
  UNION ALL SELECT 9, k::VARCHAR, 0, '{prefix}_cache_hit_ratio{{route="' || route || '"}} ' || printf('%.6f', coalesce(hits / nullif(hits + misses, 0), 0.0)) FROM h)
SELECT (row_number() OVER (ORDER BY a, b, c) - 1)::INT AS line_number, line FROM u"""


def judged(name: str, pages: str, fold) -> str:
    """CTEs: the quality of each document of a page list, with its poor pages and its pages rendered."""
    trim = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
    return rf"""{name}1 AS (SELECT doc_id, page_number, text, length({trim("text")}) AS n, length(text) AS raw, length(text) - length(replace(text, chr(65533), '')) AS broken FROM ({pages})),
{name}2 AS (SELECT doc_id, count(*) AS pages, avg(n) AS mean, median(n)::DOUBLE AS middle, avg((n < 50)::INT) AS empty, coalesce(sum(broken) / nullif(sum(raw), 0), 0.0) AS bad, sum(n) = 0 AS none,
  list(page_number ORDER BY page_number) FILTER (WHERE greatest(0, 1 - 0.5 * (n < 50)::INT - 0.25 * (coalesce(broken / nullif(raw, 0), 0) > 0.05)::INT - 0.25 * (n = 0)::INT) <= 0.5) AS poor,
  string_agg('<!-- page ' || page_number || ' -->' || chr(10) || {trim(fold("text"))}, chr(10) || chr(10) ORDER BY page_number) AS md FROM {name}1 GROUP BY doc_id),
{name} AS (SELECT *, round(greatest(0.0, 1 - 0.4 * (middle < 50)::INT - 0.25 * (empty > 0.3)::INT - 0.2 * (bad > 0.05)::INT - 0.5 * none::INT)::DOUBLE, 6) AS score FROM {name}2)"""


def escalation(pages: str, fold) -> str:
    """The driver's choice as one CASE: quality of the fast, rich, mixed and embedded page lists side by side."""
    same = lambda c: c
    rich = "SELECT doc_id, page_number, CASE WHEN page_number % 4 = 0 THEN '' ELSE text END AS text FROM pg WHERE doc_id % 3 <> 0"
    read = "read AS (SELECT doc_id, page_number, CASE WHEN item_id % 6 = 5 THEN '' ELSE benchmark.text END AS text FROM pg JOIN benchmark ON item_id + 1 = page_number)"
    mixed = f"SELECT doc_id, page_number, CASE WHEN doc_id % 5 <> 0 AND list_contains(rich.poor, page_number) AND read.text IS NOT NULL THEN read.text ELSE {fold('r.text')} END AS text FROM ({rich}) r JOIN rich USING (doc_id) LEFT JOIN read USING (doc_id, page_number)"
    embedded = f"SELECT doc_id, page_number, CASE WHEN doc_id % 2 = 0 AND page_number % 3 = 0 AND read.text IS NOT NULL THEN read.text ELSE {fold('bad.text')} END AS text FROM bad LEFT JOIN read USING (doc_id, page_number)"
    two = lambda c: f"printf('%.2f', round({c}, 2))"
    return rf"""WITH {pages}, {read}, {judged("fast", "SELECT * FROM bad", fold)}, {judged("rich", rich, fold)}, {judged("mixed", mixed, same)}, {judged("embedded", embedded, same)},
m AS (SELECT doc_id, count(*) AS n FROM rich JOIN read USING (doc_id) WHERE doc_id % 5 <> 0 AND list_contains(poor, page_number) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n FROM read WHERE doc_id % 2 = 0 AND page_number % 3 = 0 GROUP BY doc_id),
a AS (SELECT f.doc_id, f.score, f.pages, f.md, r.score AS rs, r.md AS rmd, len(coalesce(r.poor, [])) AS poor, x.score AS xs, x.md AS xmd, m.n AS xn, b.score AS es, b.md AS emd, e.n AS en,
  f.score < 0.5 OR f.middle < 50 OR f.empty > 0.3 OR f.bad > 0.05 OR f.none AS needs,
  'fast PDF text quality ' || {two("f.score")} || ' triggered escalation: ' || concat_ws(', ', CASE WHEN f.middle < 50 THEN 'low chars/page (avg ' || printf('%.1f', round(f.mean, 1)) || ', median ' || printf('%.1f', round(f.middle, 1)) || ')' END,
    CASE WHEN f.empty > 0.3 THEN 'high empty-page ratio (' || printf('%.0f', round(f.empty * 100, 0)) || '%)' END, CASE WHEN f.bad > 0.05 THEN 'replacement-character issues (' || printf('%.1f', round(f.bad * 100, 1)) || '%)' END,
    CASE WHEN f.none THEN 'missing text layer' END) AS base
  FROM fast f LEFT JOIN rich r USING (doc_id) LEFT JOIN mixed x USING (doc_id) LEFT JOIN embedded b USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN e USING (doc_id)),
w AS (SELECT *, CASE WHEN rs IS NULL THEN 'rich extraction returned no pages' WHEN poor > 0 AND xn IS NULL THEN 'rendering returned no pages for selective OCR' END AS failure FROM a),
o AS (SELECT *, CASE WHEN NOT needs THEN 'pdf-fast' WHEN failure IS NOT NULL THEN CASE WHEN en IS NOT NULL AND es + 0.01 >= score THEN 'pdf-embedded-image-ocr' ELSE 'pdf-fast' END
  WHEN poor > 0 THEN CASE WHEN xs + 0.01 < rs THEN 'pdf-pdfium' WHEN xs + 0.01 < score THEN 'pdf-fast' ELSE 'pdf-pdfium-ocr' END WHEN rs + 0.01 < score THEN 'pdf-fast' ELSE 'pdf-pdfium' END AS u FROM w)
SELECT doc_id, u AS pipeline_used, u IN ('pdf-pdfium-ocr', 'pdf-embedded-image-ocr') AS ocr_used, u = 'pdf-pdfium-ocr' AS render_used, needs AS fallback_used,
  CASE WHEN NOT needs THEN NULL
    WHEN failure IS NOT NULL THEN base || '; rich extraction failed: ' || failure || CASE WHEN u = 'pdf-embedded-image-ocr' THEN '; embedded-image OCR repaired ' || en || '/' || pages || ' page(s)' ELSE '' END
    WHEN poor > 0 THEN CASE u WHEN 'pdf-pdfium' THEN base || '; rich text quality ' || {two("rs")} || '; selective OCR on ' || poor || ' page(s) did not improve quality'
      WHEN 'pdf-fast' THEN base || '; selective OCR quality ' || {two("xs")} || ' did not beat fast-path quality ' || {two("score")}
      ELSE base || '; rich text quality ' || {two("rs")} || '; selective OCR repaired ' || xn || '/' || poor || ' poor page(s)' END
    ELSE base || '; rich text extraction improved quality to ' || {two("rs")} || CASE WHEN u = 'pdf-fast' THEN '; rich text quality ' || {two("rs")} || ' did not improve over fast-path quality ' || {two("score")} ELSE '' END END AS fallback_reason,
  CASE u WHEN 'pdf-fast' THEN score WHEN 'pdf-pdfium' THEN rs WHEN 'pdf-pdfium-ocr' THEN xs ELSE es END AS score, CASE u WHEN 'pdf-pdfium-ocr' THEN xn WHEN 'pdf-embedded-image-ocr' THEN en END AS images,
  CASE WHEN u LIKE 'pdf-pdfium%' THEN (SELECT pages FROM rich WHERE rich.doc_id = o.doc_id) ELSE pages END AS page_count,
  md5(CASE u WHEN 'pdf-fast' THEN md WHEN 'pdf-pdfium' THEN rmd WHEN 'pdf-pdfium-ocr' THEN xmd ELSE emd END) AS rendered_md5 FROM o"""


READ = "read AS (SELECT doc_id, page_number, CASE WHEN item_id % 6 = 5 THEN '' ELSE benchmark.text END AS text FROM pg JOIN benchmark ON item_id + 1 = page_number)"


def page_ocr(pages: str) -> str:
    """Recognized pages alone: their quality, and the image of the first."""
    recognized = "SELECT * FROM read WHERE doc_id % 5 <> 0"
    return f"""WITH {pages}, {READ}, {judged("q", recognized, lambda c: c)}, i AS (SELECT doc_id, max(page_number) AS page_count, min(page_number) AS p FROM ({recognized}) GROUP BY doc_id)
SELECT doc_id, page_count, score, 'rendered page image for page ' || p || ' (' || 10 * p || 'x' || 20 * p || ')' AS first_image FROM q JOIN i USING (doc_id)"""


def embedded_only(pages: str, fold) -> str:
    """The driver without rich text: embedded images repair, or the fast text stays."""
    mixed = f"SELECT doc_id, page_number, CASE WHEN doc_id % 2 = 0 AND page_number % 3 = 0 AND read.text IS NOT NULL THEN read.text ELSE {fold('bad.text')} END AS text FROM bad LEFT JOIN read USING (doc_id, page_number)"
    return f"""WITH {pages}, {READ}, {judged("fast", "SELECT * FROM bad", fold)}, {judged("mixed", mixed, lambda c: c)}, e AS (SELECT doc_id, count(*) AS n FROM read WHERE doc_id % 2 = 0 AND page_number % 3 = 0 GROUP BY doc_id),
a AS (SELECT f.*, m.score AS ms, m.md AS mmd, e.n, f.score < 0.5 OR f.middle < 50 OR f.empty > 0.3 OR f.bad > 0.05 OR f.none AS needs FROM fast f JOIN mixed m USING (doc_id) LEFT JOIN e USING (doc_id)),
b AS (SELECT *, needs AND n IS NOT NULL AND ms + 0.01 >= score AS repaired FROM a)
SELECT doc_id, CASE WHEN repaired THEN 'pdf-embedded-image-ocr' ELSE 'pdf-fast' END AS pipeline_used, CASE WHEN repaired THEN ms ELSE score END AS score, CASE WHEN repaired THEN n END AS images,
  CASE WHEN repaired THEN 'embedded-image OCR repaired ' || n || '/' || pages || ' page(s)' WHEN needs THEN 'embedded-image OCR could not improve the document' END AS outcome, md5(CASE WHEN repaired THEN mmd ELSE md END) AS rendered_md5 FROM b"""


def banded(name: str, source: str) -> str:
    """A recursive CTE: boxes (image, n, y, height) one by one in order n, each with its band."""
    joins = f"abs(s.y + s.height / 2 - {name}.centre) <= greatest(greatest({name}.tall, s.height) * 0.6, 12) OR coalesce(greatest(least(s.y + s.height, {name}.bottom) - greatest(s.y, {name}.top), 0) / nullif(least(s.height, {name}.bottom - {name}.top), 0), 0) >= 0.35"
    pick = lambda yes, no, as_: f"CASE WHEN {joins} THEN {yes} ELSE {no} END AS {as_}"
    return f"""{name} AS (SELECT image, n, 0 AS band, y::DOUBLE AS top, (y + height)::DOUBLE AS bottom, (y + height / 2)::DOUBLE AS centre, height::DOUBLE AS tall FROM {source} WHERE n = 1
  UNION ALL SELECT s.image, s.n, {name}.band + CASE WHEN {joins} THEN 0 ELSE 1 END, {pick(f"least({name}.top, s.y)", "s.y", "top")}, {pick(f"greatest({name}.bottom, s.y + s.height)", "s.y + s.height", "bottom")},
    {pick(f"({name}.centre + s.y + s.height / 2) / 2", "s.y + s.height / 2", "centre")}, {pick(f"({name}.tall + s.height) / 2", "s.height", "tall")} FROM {name} JOIN {source} s ON s.image = {name}.image AND s.n = {name}.n + 1)"""


def reading_order(boxes: str) -> str:
    return f"""WITH RECURSIVE {boxes}, down AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y, x) AS n FROM b), {banded("first", "down")},
ordered AS (SELECT down.* EXCLUDE (n), row_number() OVER (PARTITION BY image ORDER BY band, x, y) AS n FROM down JOIN first USING (image, n)), {banded("second", "ordered")},
line AS (SELECT image, band, string_agg(ordinal::VARCHAR, ' ' ORDER BY n) AS t, arg_max(top, n) AS top, arg_max(bottom, n) AS bottom FROM second JOIN ordered USING (image, n) GROUP BY ALL),
gap AS (SELECT *, lag(top) OVER w AS top0, lag(bottom) OVER w AS bottom0 FROM line WINDOW w AS (PARTITION BY image ORDER BY band)),
merged AS (SELECT image, string_agg(CASE WHEN top0 IS NULL THEN '' WHEN greatest(top - bottom0, 0) > greatest(bottom0 - top0, bottom - top) * 1.2 THEN chr(10) || chr(10) ELSE chr(10) END || t, '' ORDER BY band) AS merged FROM gap GROUP BY image)
SELECT image, string_agg(ordinal::VARCHAR, ',' ORDER BY n) AS reading_order, any_value(merged) AS merged FROM ordered JOIN merged USING (image) GROUP BY image"""


# Pixels at the threshold, what is reachable over eight neighbours, and one padded box for each region.
MAP_BOXES = """WITH RECURSIVE v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE * 12 - 1.2 AS z FROM embeddings),
l AS (SELECT *, min(z) OVER (PARTITION BY vec_id) < 0 OR max(z) OVER (PARTITION BY vec_id) > 1 AS logits FROM v),
p AS (SELECT vec_id, k % 8 AS x, k // 8 AS y, CASE WHEN logits THEN 1 / (1 + exp(-z)) ELSE z END AS p FROM l),
i AS (SELECT * FROM p WHERE p >= 0.3),
reach AS (SELECT vec_id, x, y, x AS x2, y AS y2 FROM i UNION SELECT r.vec_id, r.x, r.y, i.x, i.y FROM reach r JOIN i ON i.vec_id = r.vec_id AND abs(i.x - r.x2) <= 1 AND abs(i.y - r.y2) <= 1),
c AS (SELECT vec_id, x, y, min(y2 * 8 + x2) AS region FROM reach GROUP BY ALL),
b AS (SELECT vec_id, region, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n, sum(p) AS total FROM c JOIN p USING (vec_id, x, y) GROUP BY ALL HAVING count(*) >= 4),
s AS (SELECT vec_id, greatest(x0 - 1, 0) * 8 AS x, greatest(y0 - 1, 0) * 8 AS y, least(x1 + 2, 8) * 8 AS x2, least(y1 + 2, 8) * 8 AS y2, total / n * sqrt(n / ((x1 - x0 + 1) * (y1 - y0 + 1))) AS confidence FROM b)
SELECT vec_id, x, y, x2 - x AS width, y2 - y AS height, round(least(confidence, 1), 6) AS confidence FROM s"""
