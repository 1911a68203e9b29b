"""Column functions over text.  Lengths are UTF-8 bytes unless a name says characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that become line breaks, tags that vanish, spaces that become U+0020.
BLOCK_TAGS = (
    "<br>", "<br/>", "<br />", "<hr>", "<hr/>", "<hr />", "<p>", "</p>", "<div>", "</div>", "<section>", "</section>", "<article>", "</article>",
    "<header>", "</header>", "<footer>", "</footer>", "<nav>", "</nav>", "<main>", "</main>", "<aside>", "</aside>", "<BR>", "<BR/>", "<BR />",
    "<HR>", "<HR/>", "<HR />", "<P>", "</P>", "<DIV>", "</DIV>",
)
INLINE_TAGS = (
    "<span>", "</span>", "<b>", "</b>", "<i>", "</i>", "<em>", "</em>", "<strong>", "</strong>", "<u>", "</u>", "<s>", "</s>", "<del>", "</del>",
    "<ins>", "</ins>", "<SPAN>", "</SPAN>", "<B>", "</B>", "<I>", "</I>", "<EM>", "</EM>", "<STRONG>", "</STRONG>",
)
SPACES = "              　"

# How extracted page text is folded to ASCII.
FOLD_LONG = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "—": "--", "•": "* ", "…": "...", "ß": "ss", "©": "(c)", "®": "(R)", "™": "(TM)",
}
FOLD_ONE = {
    "'": "‘’‚′", '"': "“”„″", "-": "–‒―−", " ": "   ⁠", ".": "·", "x": "×",
    "A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏ", "N": "Ñ", "O": "ÒÓÔÕÖØ", "U": "ÙÚÛÜ", "Y": "Ý",
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ýÿ",
}
FOLD_DROP = "­​‌‍﻿´`ˊˋ¨ˆ˜"

# Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def strip_html_tags(c: Column) -> Column:
    """Exact block tags become line breaks, then exact inline tags vanish; most lines have none and are left alone."""
    block = reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("\n")), BLOCK_TAGS, c)
    return F.when(c.contains("<"), reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), INLINE_TAGS, block)).otherwise(c)


def normalize_whitespace(c: Column) -> Column:
    return F.translate(c, SPACES, " " * len(SPACES))


def process_line(c: Column) -> Column:
    return rtrim(normalize_whitespace(strip_html_tags(c)))


def is_heading(c: Column) -> Column:
    return c.rlike(r"(?U)\A\s*#{1,6}(?: |\z)")


def is_list_item(c: Column) -> Column:
    return c.rlike(r"(?U)\A\s*(?:[-*+] |[0-9]+\.)")


def opens_section(trimmed: Column) -> Column:
    """Any number of # and a space, on a trimmed line."""
    return trimmed.rlike(r"\A#+ ")


def has_page_markers(c: Column) -> Column:
    return c.contains("\f") | c.contains("<!-- page ")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def token_estimate(c: Column) -> Column:
    return F.floor(F.octet_length(c) / 4).cast("int")


def lines(c: Column) -> Column:
    """Lines without their ends, \\n or \\r\\n; no empty line after the last end."""
    return F.transform(F.split(F.regexp_replace(c, r"\n\z", ""), "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))


def first_or_null(values: Column) -> Column:
    return F.get(values, F.lit(0))


def title(c: Column) -> Column:
    """The first "# " heading that isn't blank."""
    found = F.transform(F.filter(F.transform(lines(c), trim), lambda x: x.startswith("# ")), lambda x: trim(F.substr(x, F.lit(3))))
    return first_or_null(F.filter(found, lambda x: x != ""))


def document_title(c: Column) -> Column:
    """title, or the first line of more than three bytes that isn't a comment."""
    usable = F.filter(F.transform(lines(c), trim), lambda x: (F.octet_length(x) > 3) & ~x.startswith("<!--"))
    return F.coalesce(title(c), first_or_null(usable))


def image_title(c: Column) -> Column:
    return F.coalesce(title(c), first_or_null(F.filter(F.transform(lines(c), trim), lambda x: x != "")))


def web_title(extracted: Column, c: Column) -> Column:
    return F.coalesce(F.nullif(extracted, F.lit("")), title(c))


def decode_lossy(raw: Column) -> Column:
    """UTF-8 with U+FFFD for what isn't."""
    return F.make_valid_utf8(raw.cast("string"))


def fold_page_text(c: Column) -> Column:
    """Ligatures, quotes, dashes, spaces and accents to ASCII; the rest that isn't ASCII to ?."""
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLD_LONG.items(), c)
    source, target = "".join(FOLD_ONE.values()), "".join(k * len(v) for k, v in FOLD_ONE.items())
    c = F.translate(c, source + FOLD_DROP, target)
    return F.regexp_replace(F.regexp_replace(c, "[̀-ͯ]", ""), r"[^\x00-\x7f]", "?")
