"""Plain Python models of the document operators, for comparison."""

import re

# Written out on their own, not taken from the code under test.
BLOCK_TAGS = [f"<{a}{n}{z}>" for n in ("br", "hr", "BR", "HR") for a, z in (("", ""), ("", "/"), ("", " /"))]
BLOCK_TAGS += [f"<{a}{n}>" for n in "p div section article header footer nav main aside P DIV".split() for a in ("", "/")]
INLINE_TAGS = [f"<{a}{n}>" for n in "span b i em strong u s del ins SPAN B I EM STRONG".split() for a in ("", "/")]
SPACES = {0xA0, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)}
WS = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def heading(s):
    return re.match(r"#{1,6}( |\Z)", s.lstrip(WS)) is not None


def clean(s):
    for t in BLOCK_TAGS:
        s = s.replace(t, "\n")
    for t in INLINE_TAGS:
        s = s.replace(t, "")
    return "".join(" " if ord(c) in SPACES else c for c in s).rstrip(WS)


def normalize(text):
    out, code, blanks = [], False, 0
    for raw in text.replace("\r\n", "\n").split("\n"):
        if raw.lstrip(WS).startswith("```"):
            code = not code
            if code and out and out[-1]:
                out.append("")
            out.append(raw.rstrip(WS))
            blanks = 0
        elif code:
            out.append(raw)
            blanks = 0
        elif not (s := clean(raw)):
            blanks += 1
            out += [""] * (blanks <= 2)
        elif heading(s) and out:
            out += [""] * (not blanks) + [s, ""]
            blanks = 1
        else:
            out.append(s)
            blanks = 0
    return re.sub("\n{4,}", "\n\n\n", "\n".join(out)).strip(WS) + "\n"


def sentences(b, most):
    out = []
    while b:
        if len(b) <= most:
            out.append(b)
            break
        cut = max((b.rfind(p, 0, most) + 2 for p in (b". ", b"? ", b"! ") if b.rfind(p, 0, most) >= 0), default=0)
        if not cut:
            cut = most
            while b[cut] & 0xC0 == 0x80:
                cut -= 1
        out.append(b[:cut])
        b = b[cut:]
    return [x.decode() for x in out]


def pack(body, most):
    if len(body.encode()) <= most:
        return [body]
    out, cur = [], ""
    for p in body.split("\n\n"):
        if cur and len(cur.encode()) + 2 + len(p.encode()) > most:
            out.append(cur)
            cur = ""
        cur = cur + "\n\n" + p if cur else p
    out += [cur] * bool(cur)
    return [y for x in out for y in (sentences(x.encode(), most) if len(x.encode()) > most else [x])]


def chunks(text, most=2200, least=150):
    text = text.strip(WS)
    parts, head, body = [], None, []
    for line in re.split("\r?\n", text):
        if re.match("#+ ", line.strip(WS)):
            parts.append((head, "\n".join(body).strip(WS)))
            head, body = line.strip(WS).split(" ", 1)[1].strip(WS), []
        else:
            body.append(line)
    parts.append((head, "\n".join(body).strip(WS)))
    out, before = [], ""
    for head, body in parts:
        for i, f in enumerate(pack(body, most) if body else []):
            if not (f := f.strip(WS)):
                continue
            tail = before.encode()
            if len(tail) > least:
                k = len(tail) - least
                while tail[k] & 0xC0 == 0x80:
                    k -= 1
                tail = tail[k:]
            full = tail.decode() + "\n\n" + f if out else f
            out.append((f"c{len(out) + 1:02d}", full, None if head is None else head + " (cont.)" * (i > 0), len(f.encode()), len(full.encode()) // 4))
            before = f
    return out
