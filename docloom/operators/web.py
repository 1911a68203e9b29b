"""HTML to Markdown: the main content by tags, with patterns only, so that it stays in the JVM.

Scripts, styles, comments, navigation, headers outside the article, footers, asides and advertisement blocks go; of the
rest the article, else main, else the body stays.  Headings become #, items -, links [text](address), strong text **."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import trim

# Entities.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&euro;": "€"}


def unescape(c: Column) -> Column:
    for name, char in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def html_title(html: Column) -> Column:
    return F.nullif(trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def html_to_markdown(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    c = F.regexp_replace(c, r"(?is)<(nav|footer|aside)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"""(?is)<div\s+class=["']?ad["']?\s*>.*?</div\s*>""", "")
    inner = lambda tag: F.nullif(F.regexp_extract(c, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)", 1), F.lit(""))
    c = F.coalesce(inner("article"), inner("main"), F.nullif(F.regexp_extract(c, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1), F.lit("")), c)
    c = F.regexp_replace(c, r"\s+", " ")
    for level in range(1, 7):
        c = F.regexp_replace(c, rf"(?i)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    c = F.regexp_replace(c, r"""(?i)<a\b[^>]*?href=["']?([^"'\s>]+)["']?[^>]*>(.*?)</a\s*>""", "[$2]($1)")
    c = F.regexp_replace(c, r"(?i)<(b|strong)\b[^>]*>([^<]*)</\1\s*>", "**$2**")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>\s*", "\n- ")
    c = F.regexp_replace(c, r"(?i)</?(?:p|div|ul|ol|table|tr|section|header|blockquote)\b[^>]*>", "\n\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
    c = F.regexp_replace(F.regexp_replace(unescape(c), r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return trim(c)
