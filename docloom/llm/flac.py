"""FLAC as a media column: encode, verify, decode, and PCM blocks with seekable sample offsets.

Streams are mono, 8 bits a sample, 192 samples a frame.  A frame is CONSTANT, VERBATIM, FIXED (order 1) or LPC (order
4, from the frame's autocorrelation), whichever is smallest, with Rice-coded residuals; STREAMINFO holds the MD5 of the
samples and a SEEKTABLE has a point for every 64 frames.

Reading back, frames are found by sync code, header CRC-8 and frame number; where chance makes samples look like a header,
frames are walked in order and the CRC-16 of the one before decides.  Every frame's CRC-16 and the stream's MD5 must hold.
``samples_at`` decodes a range of samples from the nearest point of the seek table on.  All frames of a batch are decoded side by side: step t takes the t-th residual of each frame, whatever its
predictor, partition order and Rice parameter.  Frames that aren't in this profile (other block sizes, stereo, wide
samples) make ``decode`` raise ``ValueError``, and so does any damage.

Texts are taken as UTF-8 (null: empty), padded with spaces to a positive multiple of 192 bytes.  Long texts are encoded
in chunks of frames, so memory follows the chunk.  Equal texts give equal streams; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, utf8

BLOCK, ORDER, PRECISION, SHIFT, POINT, CHUNK = 192, 4, 7, 5, 64, 4096
RATE, START = 8000, bytes([0xFF, 0xF8, 0x14, 0x02])  # fixed block size; 192 samples, 8 kHz; mono, 8 bits


def _table(bits: int, poly: int, steps: int) -> np.ndarray:
    """CRC of each number below 2**steps, most significant bit first."""
    t = np.arange(1 << steps, dtype=np.int64) << max(0, bits - steps)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(steps):
        t = np.where(t & top, (t << 1) ^ poly, t << 1) & mask
    return t


CRC8, CRC16 = _table(8, 0x07, 8), _table(16, 0x8005, 16)
LEADING = np.array([16] + [16 - int(i).bit_length() for i in range(1, 1 << 16)], np.int64)


def crc16(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of raw[start:end] for each range; ranges end together, as leading zeros don't count."""
    width = int((end - start).max(initial=0) + 1) // 2 * 2
    at = end[:, None] - width + np.arange(width)
    m = np.where(at >= start[:, None], raw[np.maximum(at, 0)], 0).astype(np.int64)
    two = np.ascontiguousarray((m[:, ::2] << 8 | m[:, 1::2]).T)
    crc = np.zeros(len(start), np.int64)
    for x in two:
        crc = CRC16[crc ^ x]
    return crc


def number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as in UTF-8, up to 31 bits: (rows of 6 bytes, lengths)."""
    size = np.searchsorted([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26], n, "right") + 1
    out = np.zeros((len(n), 6), np.int64)
    for k in range(1, 7):
        rows = np.flatnonzero(size == k)
        for j in range(k):
            part = n[rows] >> (6 * (k - 1 - j))
            out[rows, j] = part & 0x3F | 0x80 if j else part | (0xFF00 >> k & 0xFF if k > 1 else 0)
    return out, size


def _lpc(s: np.ndarray) -> np.ndarray:
    """Quantized predictor coefficients of each frame: Levinson-Durbin on its autocorrelation."""
    x = s.astype(np.float64)
    r = np.stack([(x[:, k:] * x[:, : BLOCK - k]).sum(1) for k in range(ORDER + 1)], 1)
    a, err = np.zeros((len(s), ORDER)), r[:, 0] + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - sum(a[:, j] * r[:, i - j] for j in range(i))) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int64)


def _residuals(s: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    predicted = sum(coefs[:, j, None] * s[:, ORDER - 1 - j : BLOCK - 1 - j] for j in range(ORDER)) >> SHIFT
    return s[:, ORDER:] - predicted


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best parameter of each row and the bits that it takes."""
    u = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    n = u.shape[1]
    guess = np.clip(np.floor(np.log2(np.maximum(u.mean(1) * 0.7, 1))).astype(np.int64), 0, 13)
    bits = np.stack([(u >> (guess + d)[:, None]).sum(1) + n * (guess + d + 1) for d in (0, 1)], 1)
    d = bits.argmin(1)
    return u, guess + d, bits[np.arange(len(u)), d]


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, their lengths) of rows of BLOCK bytes."""
    s = x.astype(np.int64) - 128
    n = len(s)
    coefs = _lpc(s)
    lpc_u, lpc_k, lpc_bits = _rice(_residuals(s, coefs))
    diff_u, diff_k, diff_bits = _rice(s[:, 1:] - s[:, :-1])
    sizes = np.stack([np.where((s == s[:, :1]).all(1), 8, 1 << 30), np.full(n, 8 * BLOCK), 8 + 10 + diff_bits, 8 * ORDER + 9 + ORDER * PRECISION + 10 + lpc_bits], 1)
    kind = sizes.argmin(1)
    head, used = number_bytes(numbers)
    bits = sizes[np.arange(n), kind] + 8  # with the subframe's header
    length = 4 + used + 1 + (bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(length)])
    out = np.zeros(start[-1] + 2, np.float64)
    for j, b in enumerate(START):
        out[start[:-1] + j] = b
    crc = np.zeros(n, np.int64)
    for b in START:
        crc = CRC8[crc ^ b]
    for j in range(int(used.max(initial=0))):
        rows = np.flatnonzero(used > j)
        out[start[rows] + 4 + j] = head[rows, j]
        crc[rows] = CRC8[crc[rows] ^ head[rows, j]]
    out[start[:-1] + 4 + used] = crc
    first = (start[:-1] + 5 + used) * 8
    pieces = []
    for k in range(4):
        rows = np.flatnonzero(kind == k)
        if not len(rows):
            continue
        m = len(rows)
        one = lambda v, w: (np.broadcast_to(np.asarray(v, np.int64).reshape(-1, 1) if np.ndim(v) else np.int64(v), (m, 1)), np.full((m, 1), w, np.int64))
        many = lambda v, w: (v, np.full(v.shape, w, np.int64))
        signed = lambda v, w: v & ((1 << w) - 1)
        rice = lambda u, p: ((np.int64(1) << p[:, None]) | (u & ((np.int64(1) << p[:, None]) - 1)), (u >> p[:, None]) + 1 + p[:, None])
        if k == 0:
            fields = [one(0, 8), one(signed(s[rows, 0], 8), 8)]
        elif k == 1:
            fields = [one(0b10, 8), many(signed(s[rows], 8), 8)]
        elif k == 2:
            fields = [one((0b001000 | 1) << 1, 8), many(signed(s[rows, :1], 8), 8), one(diff_k[rows], 10), rice(diff_u[rows], diff_k[rows])]
        else:
            fields = [one((0b100000 | ORDER - 1) << 1, 8), many(signed(s[rows, :ORDER], 8), 8), one((PRECISION - 1) << 5 | SHIFT, 9)]
            fields += [many(signed(coefs[rows], PRECISION), PRECISION), one(lpc_k[rows], 10), rice(lpc_u[rows], lpc_k[rows])]
        value, width = (np.concatenate(f, 1) for f in zip(*fields, strict=True))
        end = first[rows, None] + np.cumsum(width, 1)
        pieces.append(((end - 1 >> 3).ravel(), (value << (-end & 7)).ravel()))
    at, value = (np.concatenate(p) for p in zip(*pieces, strict=True))
    for back in range(3):  # a field of up to 14 bits touches three bytes
        out += np.bincount(np.maximum(at - back, 0), value >> (8 * back) & 255, len(out))[: len(out)]
    raw = out[:-2].astype(np.uint8)
    crc = crc16(raw, start[:-1], start[1:] - 2)
    raw[start[1:] - 2], raw[start[1:] - 1] = crc >> 8, crc & 255
    return raw, length


def _stream(payload: bytes, lengths: np.ndarray, frames: bytes) -> bytes:
    samples = len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", BLOCK, BLOCK) + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | samples).to_bytes(8, "big") + hashlib.md5(signed).digest()
    at = np.concatenate([[0], np.cumsum(lengths)])
    seek = b"".join(struct.pack(">QQH", i * BLOCK, at[i], BLOCK) for i in range(0, len(lengths), POINT))
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + frames


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of BLOCK."""
    count = np.array([len(p) // BLOCK for p in payloads], np.int64)
    x = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    start = np.concatenate([[0], np.cumsum(count)])
    numbers = np.arange(len(x)) - np.repeat(start[:-1], count)
    done = [encode_frames(x[i : i + CHUNK], numbers[i : i + CHUNK]) for i in range(0, len(x), CHUNK)]
    raw, lengths = b"".join(r.tobytes() for r, _ in done), np.concatenate([n for _, n in done])
    at = np.concatenate([[0], np.cumsum(lengths)])
    return [_stream(p, lengths[a:b], raw[at[a] : at[b]]) for p, a, b in zip(payloads, start[:-1], start[1:], strict=True)]


def _info(stream: bytes) -> tuple[int, int, bytes]:
    """(where the frames begin, samples, MD5)."""
    if stream[:4] != b"fLaC" or stream[4] & 127:
        raise ValueError("not a FLAC stream")
    body = int.from_bytes(stream[18:26], "big")
    if stream[8:12] != struct.pack(">HH", BLOCK, BLOCK) or body >> 41 & 7 or (body >> 36 & 31) != 7:
        raise ValueError("not mono, 8 bits, 192 samples a frame")
    at, last = 4, 0
    while not last:
        last, at = stream[at] >> 7, at + 4 + int.from_bytes(stream[at + 1 : at + 4], "big")
    return at, body & ((1 << 36) - 1), stream[26:42]


def _headers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, frame numbers, sizes before the CRC-8) of all that looks like a frame header and has a fitting CRC-8."""
    hits = np.flatnonzero((raw[:-3] == START[0]) & (raw[1:-2] == START[1]) & (raw[2:-1] == START[2]) & (raw[3:] == START[3]))
    pad = np.concatenate([raw, np.zeros(16, np.uint8)]).astype(np.int64)
    lead = pad[hits + 4]
    size = np.where(lead < 128, 1, np.where(lead >> 5 == 6, 2, np.where(lead >> 4 == 14, 3, np.where(lead >> 3 == 30, 4, np.where(lead >> 2 == 62, 5, 6)))))
    number = np.where(size == 1, lead, lead & (127 >> size))
    crc = np.zeros(len(hits), np.int64)
    for j in range(4):
        crc = CRC8[crc ^ pad[hits + j]]
    for j in range(6):
        b = pad[hits + 4 + j]
        crc = np.where(j < size, CRC8[crc ^ b], crc)
        number = np.where((0 < j) & (j < size), number << 6 | b & 63, number)
    good = crc == pad[hits + 4 + size]
    return hits[good], number[good], size[good]


def _numbered(raw: np.ndarray, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, header sizes) of the ``count`` frames numbered from ``first`` that raw begins with."""
    hits, number, size = _headers(raw)
    keep = _walk(raw, hits, number - first, 0)
    if keep.sum() != count:
        raise ValueError("frames are missing, damaged or of another profile")
    return hits[keep], size[keep] + 5


def _find(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame starts, ends and header sizes in raw[begin:end] of each stream."""
    hits, number, size = _headers(raw)
    stream = np.searchsorted(begin, hits, "right") - 1
    inside = (stream >= 0) & (hits < end[stream])
    hits, number, size, stream = (a[inside] for a in (hits, number, size, stream))
    keep, first = np.ones(len(hits), bool), np.searchsorted(stream, np.arange(len(begin) + 1))
    for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if (z - a) * BLOCK != samples[k] or (number[a:z] != np.arange(z - a)).any():
            keep[a:z] = _walk(raw, hits[a:z], number[a:z], int(begin[k]))
    hits, stream, number, size = (a[keep] for a in (hits, stream, number, size))
    count = np.bincount(stream, minlength=len(begin))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    if (count * BLOCK != samples).any() or (number != np.arange(len(hits)) - first[stream]).any() or (hits[first] != begin).any():
        raise ValueError("frames are missing, damaged or of another profile")
    last = np.concatenate([stream[1:] != stream[:-1], [True]])
    return hits, np.where(last, end[stream], np.concatenate([hits[1:], [0]])), size + 5


def _walk(raw: np.ndarray, hits: np.ndarray, number: np.ndarray, begin: int) -> np.ndarray:
    """Which of one stream's likely headers are headers: each carries the next number where the frame before it ends well."""
    keep, at, due = np.zeros(len(hits), bool), -1, 0
    for k in range(len(hits)):
        if number[k] != due or (due == 0 and hits[k] != begin):
            continue
        if at >= 0:
            stored = int(raw[hits[k] - 2]) << 8 | int(raw[hits[k] - 1])
            if crc16(raw, np.array([at]), np.array([hits[k] - 2]))[0] != stored:
                continue
        keep[k], at, due = True, int(hits[k]), due + 1
    return keep


def _samples(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed samples of all frames, decoded side by side."""
    pad = np.concatenate([raw, np.zeros(16, np.uint8)]).astype(np.uint64)
    four = pad[:-3] << np.uint64(24) | pad[1:-2] << np.uint64(16) | pad[2:-1] << np.uint64(8) | pad[3:]
    full = np.uint64(0xFFFFFFFF)

    def window(p):
        return four[p >> 3] << (p & 7).astype(np.uint64) & full

    def take(p, width: int):  # up to 25 bits
        return (window(p) >> np.uint64(32 - width)).astype(np.int64)

    def signed(v, width):
        return v - ((v >> (width - 1)) << width)

    n = len(start)
    p = (start + size) * 8
    head = take(p, 8)
    kind = head >> 1
    if (head & 0x81).any():
        raise ValueError("wasted bits aren't in this profile")
    fixed, lpc = kind >> 3 == 1, kind >> 5 == 1
    order = np.where(fixed, kind & 7, np.where(lpc, (kind & 31) + 1, 0))
    if (fixed & (order > 4)).any() or (~fixed & ~lpc & (kind > 1)).any():
        raise ValueError("reserved subframe type")
    p += 8
    s = np.zeros((n, BLOCK), np.int64)
    flat = np.flatnonzero(kind == 0)
    s[flat] = signed(take(p[flat], 8), 8)[:, None]
    plain = np.flatnonzero(kind == 1)
    s[plain] = signed((pad[(p[plain] >> 3)[:, None] + np.arange(BLOCK)]).astype(np.int64), 8)
    for t in range(int(order.max(initial=0))):
        rows = np.flatnonzero(order > t)
        s[rows, t] = signed(take(p[rows], 8), 8)
        p[rows] += 8
    coefs, shift = np.zeros((n, int(order[lpc].max(initial=0))), np.int64), np.zeros(n, np.int64)
    rows = np.flatnonzero(lpc)
    if len(rows):
        precision, shift[rows] = take(p[rows], 4) + 1, signed(take(p[rows] + 4, 5), 5)
        if (precision == 16).any() or (shift < 0).any():
            raise ValueError("reserved predictor")
        p[rows] += 9
        for j in range(coefs.shape[1]):
            more = order[rows] > j
            v = (window(p[rows]) >> (32 - precision).astype(np.uint64)).astype(np.int64)
            coefs[rows, j] = np.where(more, v - (v >> (precision - 1) << precision), 0)
            p[rows] += np.where(more, precision, 0)
    coded = np.flatnonzero(fixed | lpc)
    if not len(coded):
        return s
    q, order = p[coded], order[coded]
    method, parts = take(q, 2), take(q + 2, 4)
    if (method > 1).any() or (BLOCK % (1 << parts)).any():
        raise ValueError("reserved residual coding")
    q += 6
    each, wide = BLOCK >> parts, 4 + method
    k, escape = np.zeros(len(q), np.int64), np.zeros(len(q), bool)
    residual = np.zeros((BLOCK, len(q)), np.int64)
    raw_bits = np.zeros(len(q), np.int64)
    for t in range(BLOCK):
        opens = np.flatnonzero((t % each == 0) & (t < BLOCK)) if t else np.arange(len(q))
        if t == 0 or (parts > 0).any():
            if len(opens):
                v = np.where(wide[opens] == 4, take(q[opens], 4), take(q[opens], 5))
                q[opens] += wide[opens]
                escape[opens] = v == (1 << wide[opens]) - 1
                k[opens] = v
                e = opens[escape[opens]]
                raw_bits[e] = take(q[e], 5)
                q[e] += 5
        live = t >= order
        w = window(q)
        zeros = LEADING[(w >> np.uint64(16)).astype(np.int64)]
        far = np.flatnonzero((zeros == 16) & live & ~escape)
        skipped = np.zeros(len(q), np.int64) if len(far) else 0
        while len(far):  # sixteen zeros or more: rare
            q[far] += 16
            skipped[far] += 16
            w[far] = window(q[far])
            zeros[far] = LEADING[(w[far] >> np.uint64(16)).astype(np.int64)]
            if (skipped[far] > 1 << 12).any():
                raise ValueError("damaged residual")
            far = far[zeros[far] == 16]
        used = zeros + 1 + k
        low = (w >> np.maximum(32 - used, 0).astype(np.uint64)).astype(np.int64) & ((np.int64(1) << k) - 1)
        u = (zeros + skipped) << k | low
        value = u >> 1 ^ -(u & 1)
        if escape.any():
            e = np.flatnonzero(escape)
            v = (window(q[e]) >> (32 - raw_bits[e]).astype(np.uint64)).astype(np.int64)
            value[e] = np.where(raw_bits[e] > 0, v - (v >> np.maximum(raw_bits[e] - 1, 0) << raw_bits[e]), 0)
            used[e] = raw_bits[e]
        residual[t] = value
        q += used if t >= 32 or live.all() else np.where(live, used, 0)
    out, res = s[coded], residual.T
    for o in range(5):  # order o: o-fold sums, started from the warm-up samples
        rows = np.flatnonzero(fixed[coded] & (order == o))
        if len(rows):
            v = res[rows, o:].copy()
            warm = out[rows, :o]
            for level in range(o, 0, -1):
                d = np.diff(warm, level - 1, axis=1)[:, -1:]
                v = d + np.cumsum(v, 1)
            out[rows, o:] = v
    c, sh = coefs[coded], shift[coded]
    for o in np.unique(order[lpc[coded]]):
        rows = np.flatnonzero(lpc[coded] & (order == o))
        back = np.ascontiguousarray(out[rows].T)
        factor = c[rows, :o].T
        for t in range(int(o), BLOCK):
            back[t] = res[rows, t] + (sum(factor[j] * back[t - 1 - j] for j in range(int(o))) >> sh[rows])
        out[rows] = back.T
    s[coded] = out
    return s


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """Payloads, and where each frame begins in its stream; raises ValueError on any damage."""
    if not streams:
        return [], []
    infos = [_info(x) for x in streams]
    raw = np.frombuffer(b"".join(streams), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    start, end, size = _find(raw, at[:-1] + [i[0] for i in infos], at[1:], np.array([i[1] for i in infos], np.int64))
    out = np.empty((len(start), BLOCK), np.uint8)
    for i in range(0, len(start), CHUNK):
        part, a = slice(i, i + CHUNK), int(start[i])
        z = int(end[part].max())
        if (crc16(raw[a:z], start[part] - a, end[part] - a - 2) != raw[end[part] - 2].astype(np.int64) * 256 + raw[end[part] - 1]).any():
            raise ValueError("CRC-16 of a frame is wrong")
        s = _samples(raw[a:z], start[part] - a, size[part])
        if s.min() < -128 or s.max() > 127:
            raise ValueError("sample out of range")
        out[part] = s + 128
    first = np.concatenate([[0], np.cumsum([i[1] // BLOCK for i in infos])])
    payloads, places = [], []
    for k, (_, _, md5) in enumerate(infos):
        x = out[first[k] : first[k + 1]]
        if hashlib.md5((x ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("MD5 of the samples is wrong")
        payloads.append(x.tobytes())
        places.append(start[first[k] : first[k + 1]] - at[k])
    return payloads, places


def samples_at(stream: bytes, first: int, count: int) -> bytes:
    """``count`` unsigned samples from the ``first`` on, decoded from the seek point before them to the one after."""
    begin, samples, _ = _info(stream)
    first, last = min(max(first, 0), samples), min(max(first, 0) + max(count, 0), samples)
    if first >= last:
        return b""
    at = 42
    while stream[at] & 127 != 3:
        if stream[at] >> 7:
            raise ValueError("no seek table")
        at += 4 + int.from_bytes(stream[at + 1 : at + 4], "big")
    points = list(struct.iter_unpack(">QQH", stream[at + 4 : at + 4 + int.from_bytes(stream[at + 1 : at + 4], "big")]))
    from_ = max(p for p in points if p[0] <= first)
    to = min((p for p in points if p[0] >= last), default=(samples, len(stream) - begin, 0))
    raw = np.frombuffer(stream[begin + from_[1] : begin + to[1]], np.uint8)
    start = _numbered(raw, from_[0] // BLOCK, (to[0] - from_[0]) // BLOCK)
    end = np.concatenate([start[0][1:], [len(raw)]])
    if (crc16(raw, start[0], end - 2) != raw[end - 2].astype(np.int64) * 256 + raw[end - 1]).any():
        raise ValueError("CRC-16 of a frame is wrong")
    out = (_samples(raw, *start) + 128).astype(np.uint8).tobytes()
    return out[first - from_[0] : last - from_[0]]


def pad(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // BLOCK)) * BLOCK, b" ")


def to_media(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with n_bytes and media: each whole text as a FLAC stream."""
    if taken := {"n_bytes", "media"} & set(keep):
        raise ValueError(f"columns already there: {sorted(taken)}")
    kept = docs.select(*keep, F.col("text").alias("__text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = utf8(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, 1 << 20):
                texts = [raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                media = encode([pad(t) for t in texts])
                columns = [*[batch.column(c).slice(i, j - i) for c in range(len(keep))], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "media"])

    return kept.mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in kept.drop("__text").dtypes] + ["n_bytes bigint", "media binary"]))


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], list[bytes], list[np.ndarray]]]:
    offsets, raw = utf8(batch.column(batch.schema.get_field_index("media")))
    for i, j in slices(offsets, 1 << 20):
        streams = [raw[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
        yield i, j, streams, *decode(streams)


def pcm_blocks(media: DataFrame, key: str, frames: int = POINT) -> DataFrame:
    """key, block, first_sample, n_samples, byte_offset, pcm: unsigned 8-bit blocks of ``frames`` frames, to be sought by sample."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, _, payloads, places in _read(batch):
                ids = batch.column(0)
                for k, (payload, place) in enumerate(zip(payloads, places, strict=True)):
                    step = frames * BLOCK
                    n = -(-len(payload) // step)
                    pcm = [payload[b * step : (b + 1) * step] for b in range(n)]
                    rows = [pa.concat_arrays([ids.slice(i + k, 1)] * n), pa.array(range(n), pa.int64()), pa.array([b * step for b in range(n)], pa.int64()), pa.array([len(x) for x in pcm], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(place[::frames], pa.int64()), pa.array(pcm, pa.binary())], names=[key, "block", "first_sample", "n_samples", "byte_offset", "pcm"])

    kind = dict(media.dtypes)[key]
    return media.select(key, "media").mapInArrow(apply, f"`{key}` {kind}, block bigint, first_sample bigint, n_samples bigint, byte_offset bigint, pcm binary")


def feature(payload: bytes) -> str:
    """Integers of the samples: frames, least, most, sum, energy and changes of sign about the middle."""
    s = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    low = s < 0
    return f"frames={len(s) // BLOCK};min={s.min()};max={s.max()};sum={s.sum()};energy={(s * s).sum()};crossings={np.count_nonzero(low[1:] != low[:-1])}"


def read_back(media: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with digests and features of the stored stream and of the samples read back from it."""
    extra = ["payload_bytes bigint", "payload_sha256 string", "tail_crc32 bigint", "media_bytes bigint", "media_sha256 string", "feature string"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, streams, payloads, _ in _read(batch):
                digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                columns = [pa.array([len(p) for p in payloads], pa.int64()), digest(payloads), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64())]
                columns += [pa.array([len(x) for x in streams], pa.int64()), digest(streams), pa.array([feature(p) for p in payloads])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in range(len(keep))], *columns], names=[*keep, *[x.split()[0] for x in extra]])

    kept = media.select(*keep, "media")
    return kept.mapInArrow(apply, ", ".join([f"`{n}` {t}" for n, t in kept.drop("media").dtypes] + extra))


def query(spark, sf_dir):
    media = to_media(table(spark, sf_dir, "documents"), ["doc_id"])
    return read_back(media, ["doc_id", "n_bytes"])
