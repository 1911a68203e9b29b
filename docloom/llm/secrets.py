"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

Patterns (code points, leftmost non-overlapping for each kind, failing matches dropped afterwards): ``assign``,
``access`` and ``hex``.  Novelty (kind ``novel``): a candidate is a run of 16 or more characters of ``[A-Za-z0-9+/_-]``
that holds a letter, lies outside the patterns' spans, and has a sensitive word in the 64 characters before or after it; a
run that holds such a word is measured before and after the word.  Its marginal size is the compressed size of (surroundings + candidate) less that of the surroundings alone, with a
dictionary of code identifiers, sensitive names and ordinary assignments as history; at ``LEAST_RATIO`` bytes a character
or more it is reported.  Identifiers, paths and words repeated nearby cost little and are not.

Whole texts are scanned: a byte-level pass over each batch picks the texts that can match at all, and only those are
decoded and searched.  Null and empty texts have no spans; repeated rows get equal results; empty tables none.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shielded, slices, table, utf8
from .words import runs

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Words that make what follows them sensitive; those of ASSIGN among them.
SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "bearer", "authorization", "signature", "access_key", "client_id", "passphrase", "pwd")
CONTEXT = re.compile("|".join(SENSITIVE), re.I | re.A)
#: Ordinary code: what costs nothing extra after a sensitive word.
IDENTIFIERS = """self request response config settings environ getenv os.environ.get process.env return import from class def function const let var public private static
final string integer boolean true false null none undefined example placeholder changeme default localhost username password_hash password_field token_type token_count
access_token refresh_token csrf_token session_token secret_key secret_name api_key_name client_secret client_id authorization_header private_key_path public_key signature_version
credential_provider bearer_token https://www.example.com/api/v1/auth/login /usr/local/lib/python /etc/ssl/certs application/json content-type x-api-key abcdefghijklmnopqrstuvwxyz
site-packages dist-packages node_modules src/main/java/com/ resources templates static settings.py config.yml docker-compose.yaml requirements.txt https://docs. https://github.com/
expiration_seconds default_value provider storage manager handler service repository controller middleware validator serializer permission required optional timeout
ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890123456 xxxxxxxxxxxxxxxx your_secret_here your-api-key-here insert_token_here"""
#: Names of the language's own library, as it knows them: ordinary identifiers, without a list of ours.
NAMES = " ".join(sorted({*keyword.kwlist, *dir(builtins), *sys.stdlib_module_names, *dir(str), *dir(dict), *dir(list)}))
AROUND, LEAST_RATIO, LEVEL = 64, 0.45, 3
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_WORDS = [w.encode() for w in SENSITIVE]


class Novelty:
    def __init__(self, primed: str = NAMES + IDENTIFIERS):
        raw = zstandard.ZstdCompressionDict(primed.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False)

    def marginal(self, around: str, candidate: str) -> int:
        """Compressed bytes that the candidate adds to its surroundings."""
        size = lambda s: len(self.zstd.compress(s.encode("utf-8", "replace")))
        return size(around + candidate) - size(around)

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        words, looked, last = [m.span() for m in CONTEXT.finditer(text)], [], 0
        for _, end in words:  # what follows a sensitive word, each place once
            at = max(end, last)
            while (m := CANDIDATE.search(text, at, end + AROUND + 16)) and m.start() <= end + AROUND:
                at = last = CANDIDATE.match(text, m.start()).end()
                looked.append((m.start(), at))
        starts, after = [a for a, _ in words], [a for a, _ in looked]
        for m in CANDIDATE.finditer(text) if words else ():  # what stands before one
            a, b = m.span()
            k = bisect_left(starts, a + 16)
            if k < len(starts) and starts[k] <= b + AROUND:
                b = min(b, starts[k])
                i = bisect_left(after, b)
                if not i or looked[i - 1][1] <= a:
                    looked.append((a, b))
        return sorted(x for x in looked if self.novel(text, *x, taken))

    def novel(self, text: str, a: int, b: int, taken: list[tuple[int, int]]) -> bool:
        if not re.search(r"[A-Za-z]", text[a:b]) or any(x < b and a < y for x, y in taken):
            return False
        return self.marginal(text[max(0, a - AROUND) : a] + text[b : b + AROUND], text[a:b]) >= LEAST_RATIO * (b - a)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def all_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    more = novelty.spans(text, [(a, b) for a, b, _ in base])
    return sorted([*base, *((a, b, "novel") for a, b in more)], key=lambda x: (x[0], KINDS.index(x[2])))


def worth_a_look(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Texts that may hold a span: a long hexadecimal run, AKIA or a sensitive word, from their bytes alone."""
    starts, ends = runs(_HEX[raw], offsets)
    look = np.zeros(len(offsets) - 1, bool)
    long = starts[ends - starts >= 32]
    look[np.searchsorted(offsets, long, "right") - 1] = True
    whole = raw.tobytes()
    low = whole.lower()
    for word, where in [(b"AKIA", whole), *((w, low) for w in _WORDS)]:
        at = where.find(word)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, "right")) - 1
            look[i] = True
            at = where.find(word, int(offsets[i + 1]))  # the rest of that text needs no second hit
    return look


def text_of(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, keep: list[str], redacted: bool = False) -> DataFrame:
    """Columns ``keep`` with n_assign, n_access, n_hex, base and spans ("kind:start:end,..."), and the text with every span replaced."""
    extra = ["n_assign bigint", "n_access bigint", "n_hex bigint", "base string", "spans string", *["redacted string"] * redacted]
    if taken := {x.split()[0] for x in extra} & set(keep):
        raise ValueError(f"columns already there: {sorted(taken)}")
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            offsets, raw = utf8(texts)
            for i, j in slices(offsets, 1 << 22):
                part = raw[offsets[i] : offsets[j]]
                n = j - i
                counts, base, spans = np.zeros((3, n), np.int64), [""] * n, [""] * n
                clean = texts.slice(i, n).to_pylist() if redacted else []
                for k in np.flatnonzero(worth_a_look(offsets[i : j + 1] - offsets[i], part)):
                    text = raw[offsets[i + k] : offsets[i + k + 1]].tobytes().decode("utf-8", "replace")
                    found = base_spans(text)
                    for _, _, kind in found:
                        counts[KINDS.index(kind), k] += 1
                    every = all_spans(text, found, novelty)
                    base[k], spans[k] = text_of(found), text_of(every)
                    if redacted:
                        clean[k] = redact(text, every)
                columns = [*[batch.column(c).slice(i, n) for c in range(len(keep))], *[pa.array(x) for x in counts], pa.array(base), pa.array(spans), *[pa.array(clean, pa.string())] * redacted]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[x.split()[0] for x in extra]])

    return kept.mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in kept.drop("__text").dtypes] + extra))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """Overlapping spans become one mark."""
    out, at, end = [], 0, -1
    for a, b, _ in spans:
        if a >= end:
            out += [text[at:a], mark]
        at = end = max(b, end)
    return "".join([*out, text[at:]])


def query(spark, sf_dir):
    out = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def stage(spark, docs, sf_dir):
    """Documents with every secret replaced by a mark; n_chars follows."""
    rows, names = shielded(docs)
    out = scan(rows, names, redacted=True)
    own = dict(zip(docs.columns, names, strict=True))
    columns = {c: F.col(n) for c, n in own.items()} | {"text": F.col("redacted")}
    if "n_chars" in own:
        n = F.length("redacted").cast(dict(docs.dtypes)["n_chars"])
        columns["n_chars"] = F.when(F.col("spans") == "", F.col(own["n_chars"])).otherwise(n)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
