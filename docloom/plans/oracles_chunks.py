"""DuckDB's SQL for chunks and what is made of them, over strings of one character a byte."""

from __future__ import annotations

WS = r"[\pZ\t-\r\x{85}]"


def as_bytes(c: str) -> str:
    """One character a byte."""
    return f"array_to_string(list_transform(range(0, octet_length(encode({c}))), lambda i: chr(('0x' || substr(hex(encode({c})), (2 * i + 1)::BIGINT, 2))::INT)), '')"


def as_text(c: str) -> str:
    return f"decode(unhex(array_to_string(list_transform(string_split({c}, ''), lambda x: printf('%02x', ord(x))), '')))"


def back(at: str, text: str) -> str:
    """``at``, or up to three less, so that the character behind it is not the middle of one."""
    inner = lambda k: f"regexp_matches(substr({text}, ({at} - {k} + 1)::BIGINT, 1), '[\\x{{80}}-\\x{{BF}}]')"
    return f"CASE WHEN NOT {inner(0)} THEN {at} WHEN NOT {inner(1)} THEN {at} - 1 WHEN NOT {inner(2)} THEN {at} - 2 ELSE {at} - 3 END"


def chunks(sections: str) -> str:
    """CTEs that end in ``chunk`` (key, ordinal, ...): paragraphs packed one by one, long packs cut piece by piece.

    ``sections`` is a query of key, sec (order), heading, body (bytes, trimmed), first and last page."""
    find = lambda m: f"CASE WHEN instr(v, ' {m}') > 0 THEN 2201 - instr(v, ' {m}') ELSE 0 END"
    ends = f"greatest({find('.')}, {find('?')}, {find('!')})"
    return f"""sect AS ({sections}),
para AS (SELECT key, sec, unnest(string_split(body, chr(10) || chr(10))) AS p, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS n FROM sect WHERE body <> ''),
pack AS (SELECT key, sec, n, p, 0 AS g, length(p) AS held FROM para WHERE n = 1
  UNION ALL SELECT x.key, x.sec, x.n, x.p, g + CASE WHEN held > 0 AND held + 2 + length(x.p) > 2200 THEN 1 ELSE 0 END, CASE WHEN held > 0 AND held + 2 + length(x.p) <= 2200 THEN held + 2 ELSE 0 END + length(x.p)
  FROM pack JOIN para x ON x.key = pack.key AND x.sec = pack.sec AND x.n = pack.n + 1),
packed AS (SELECT key, sec, g, string_agg(p, chr(10) || chr(10) ORDER BY n) AS t FROM pack GROUP BY ALL),
piece AS (SELECT key, sec, g, -1 AS k, '' AS f, t AS rest FROM packed
  UNION ALL SELECT key, sec, g, k + 1, left(rest, stop::BIGINT), substr(rest, stop::BIGINT + 1) FROM (SELECT *, CASE WHEN length(rest) <= 2200 THEN length(rest) WHEN {ends} > 0 THEN {ends} ELSE {back("2200", "rest")} END AS stop
    FROM (SELECT *, reverse(left(rest, 2200)) AS v FROM piece WHERE rest <> ''))),
frag AS (SELECT key, sec, regexp_replace(f, '^{WS}+|{WS}+$', '', 'g') AS f, row_number() OVER (PARTITION BY key, sec ORDER BY g, k) AS nth FROM piece WHERE k >= 0),
placed AS (SELECT frag.*, CASE WHEN nth = 1 THEN heading ELSE heading || ' (cont.)' END AS section, first, last, row_number() OVER w AS ordinal, lag(f) OVER w AS before
  FROM frag JOIN sect USING (key, sec) WHERE f <> '' WINDOW w AS (PARTITION BY key ORDER BY sec, nth)),
tailed AS (SELECT *, CASE WHEN before IS NULL THEN f WHEN length(before) <= 150 THEN before || chr(10) || chr(10) || f ELSE substr(before, ({back("(length(before) - 150)", "before")})::BIGINT + 1) || chr(10) || chr(10) || f END AS whole FROM placed),
chunk AS (SELECT key, ordinal, CASE WHEN first IS NULL THEN '' ELSE printf('p%02d-', first::INT) END || printf('c%02d', ordinal::INT) AS id, {as_text("whole")} AS text, section, first AS page_start, last AS page_end,
  length(f) AS char_count, length(whole) // 4 AS token_estimate FROM tailed)"""


TRIMMED = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
TURNS = f"SELECT conv_id AS key, turn AS sec, role || ' ' || turn AS heading, {as_bytes(TRIMMED)} AS body, NULL::INT AS first, NULL::INT AS last FROM conversations"
TEXTS = f"SELECT -1 - doc_id AS key, 0 AS sec, NULL AS heading, {as_bytes(TRIMMED)} AS body, NULL::INT AS first, NULL::INT AS last FROM documents"

CHUNKS = f"WITH RECURSIVE {chunks(f'{TURNS} UNION ALL {TEXTS}')} SELECT key AS conv_id, * EXCLUDE (key) FROM chunk"

FLAGS = '"ocr_used":false,"render_used":false,"fallback_used":false,"fallback_reason":null,"text_quality_score":null'

EVENTS = f"""WITH RECURSIVE {chunks(TURNS)}, k AS (SELECT DISTINCT conv_id AS key FROM conversations), n AS (SELECT k.key, count(chunk.key) AS n FROM k LEFT JOIN chunk USING (key) GROUP BY k.key)
SELECT key AS conv_id, 0 AS seq, '{{"event":"metadata","title":"Conversation ' || key || '","url":null,"source_kind":"markdown","page_count":null,{FLAGS}}}' AS line FROM k
UNION ALL SELECT key, ordinal, '{{"event":"chunk","id":"' || id || '","text":' || to_json(text) || ',"section":' || to_json(section) || ',"token_estimate":' || token_estimate || '}}' FROM chunk
UNION ALL SELECT key, n + 1, '{{"event":"done","chunks_total":' || n || ',"latency_ms":0,"pipeline_used":"markdown",{FLAGS}}}' FROM n"""


# The Markdown of a conversation as normalization leaves it: a heading's own blank line, and the one that was there.
WORDS = f"len(list_filter(regexp_split_to_array({TRIMMED}, '{WS}+'), lambda x: x <> ''))"
DOCUMENTS = f"""WITH RECURSIVE {chunks(TURNS)},
md AS (SELECT conv_id AS key, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || repeat(chr(10), 3) || {TRIMMED}, chr(10) || chr(10) ORDER BY turn) || chr(10) AS m,
  3 + sum(3 + {WORDS})::BIGINT AS words FROM conversations GROUP BY conv_id),
c AS (SELECT key, string_agg('{{"id":"' || id || '","text":' || to_json(text) || ',"section":' || to_json(section) || ',"page_start":null,"page_end":null,"char_count":' || char_count || ',"token_estimate":' || token_estimate || '}}', ',' ORDER BY ordinal) AS c FROM chunk GROUP BY key)
SELECT key AS conv_id, '{{"title":"Conversation ' || key || '","canonical_url":null,"markdown":' || to_json(m) || ',"chunks":[' || coalesce(c, '') || '],"metadata":{{"page_count":null,"word_count":' || words || ',"char_count":' || strlen(m)
  || '}},"diagnostics":{{"pipeline_used":"markdown","ocr_used":false,"render_used":false,"fallback_used":false,"latency_ms":0}},"image_manifest":null}}' AS json FROM md LEFT JOIN c USING (key)"""


# An entry's bytes: its key, its Markdown, and its chunks' texts, ids and sections.
CACHE_HITS = f"""WITH RECURSIVE LOG, {chunks(TURNS)},
c AS (SELECT key, sum(strlen(text) + strlen(id) + strlen(section)) AS n FROM chunk GROUP BY key),
m AS (SELECT conv_id AS key, strlen('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS n FROM conversations GROUP BY conv_id)
SELECT user_id, count(*) AS hits, max(strlen(user_id::VARCHAR) + m.n + coalesce(c.n, 0))::BIGINT AS bytes FROM log JOIN m ON m.key = user_id LEFT JOIN c ON c.key = user_id WHERE status = 200 GROUP BY user_id"""


def paged(pages: str, fold) -> str:
    """Documents of page lists by the fast path: pages rendered after their markers, in one section without a heading."""
    trim = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
    words = f"len(list_filter(regexp_split_to_array(md, '{WS}+'), lambda x: x <> ''))"
    return f"""WITH RECURSIVE {pages}, page AS (SELECT doc_id, page_number, regexp_replace({trim(fold("text"))}, '{WS}+(\\n|$)', '\\1', 'g') AS t FROM pg),
doc AS (SELECT doc_id, count(*) AS pages, {trim("string_agg('<!-- page ' || page_number || ' -->' || chr(10) || t, chr(10) || chr(10) ORDER BY page_number)")} AS md,
  arg_min(t, page_number) FILTER (WHERE length(t) > 3) AS title FROM page GROUP BY doc_id),
{chunks("SELECT doc_id AS key, 0 AS sec, NULL AS heading, md AS body, 1 AS first, (pages + 1)::INT AS last FROM doc")}
SELECT doc_id, title, pages AS page_count, {words} AS word_count, chunk.* EXCLUDE (key) FROM doc JOIN chunk ON key = doc_id"""
