"""FLAC columns: bytes to mono 8-bit streams and back, many frames at a time in numpy.

A sample is a byte less 128. The writer uses constant, verbatim, fixed (orders 0 to 2) and linear-predictor (order 4)
subframes with Rice residuals; the reader takes any mono stream of up to 24 bits, all fixed and linear orders and every
partition order, verifies the checksums of headers, frames and streams, and gives PCM blocks with their sample offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import lean, ready

BLOCK = 4096
RATE = 8000
_LPC, _PRECISION, _SHIFT = 4, 12, 9
#: Bytes of payload that are encoded or decoded together.
BATCH = 1 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = np.zeros(256, dtype="u2"), 1 << (bits - 1), (1 << bits) - 1
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[i] = c
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_FAR = np.zeros((0, 256), dtype="u2")


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def _far(n: int) -> np.ndarray:
    """Row d: what a byte adds to the 16-bit checksum with d bytes after it."""
    global _FAR
    if len(_FAR) < n:
        size = 1 << max(13, (n - 1).bit_length())
        rows = np.empty((size, 256), dtype="u2")
        rows[0] = _CRC16
        for d in range(1, size):
            last = rows[d - 1]
            rows[d] = (last << 8) ^ _CRC16[last >> 8]
        _FAR = rows
    return _FAR


def crc16s(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksums of byte ranges that follow each other in flat."""
    after = np.repeat(starts + sizes - 1, sizes) - np.arange(len(flat))
    return np.bitwise_xor.reduceat(_far(int(sizes.max()))[after, flat], starts)


def _utf8_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    out, width = [], 1
    while n >= 1 << (6 - width):
        out.append(0x80 | n & 0x3F)
        n >>= 6
        width += 1
    return bytes([(0xFF << (7 - (width - 1))) & 0xFF | n if width < 7 else 0xFE, *reversed(out)])


def _shifted(x: np.ndarray, n: int) -> np.ndarray:
    out = np.empty_like(x)
    out[:n], out[n:] = 0, x[:-n] if n else x
    return out


def _frames(blocks: list[tuple[int, bytes]]) -> list[bytes]:
    """The frames of blocks of samples, each with its number in its stream."""
    number = [n for n, _ in blocks]
    flat = (np.frombuffer(b"".join(x for _, x in blocks), dtype="u1") ^ 0x80).view("i1").astype("i4")
    sizes = np.array([len(x) for _, x in blocks])
    starts = np.cumsum(sizes) - sizes
    # the first samples of a block are warm-up: what a predictor of order o says of sample j < o is set to nothing
    warm = [starts + j for j in range(_LPC)]  # blocks hold 64 samples at least

    def clear(x, order):
        for j in range(order):
            x[warm[j]] = 0
        return x

    lag1, lag2 = _shifted(flat, 1), _shifted(flat, 2)
    rest = [flat, clear(flat - lag1, 1), clear(flat - 2 * lag1 + lag2, 2)]
    # linear prediction from whole-number autocorrelations, so equal blocks get equal coefficients
    lags = [lag1, lag2, _shifted(flat, 3), _shifted(flat, 4)]
    corr = np.stack([np.add.reduceat(flat * flat, starts), *[np.add.reduceat(clear(flat * x, o + 1), starts) for o, x in enumerate(lags)]], axis=1).astype("f8")
    toeplitz = corr[:, np.abs(np.arange(_LPC)[:, None] - np.arange(_LPC)[None, :])]
    toeplitz = toeplitz + np.eye(_LPC) * (corr[:, :1, None] * 1e-6 + 1.0)
    coefs = np.clip(np.rint(np.linalg.solve(toeplitz, corr[:, 1:, None])[:, :, 0] * (1 << _SHIFT)), -(1 << (_PRECISION - 1)), (1 << (_PRECISION - 1)) - 1).astype("i4")
    guess = np.repeat(coefs[:, 0], sizes) * lags[0]
    for j in range(1, _LPC):
        guess += np.repeat(coefs[:, j], sizes) * lags[j]
    rest.append(clear(flat - (guess >> _SHIFT), _LPC))
    del guess, lags, lag1, lag2
    costs = np.stack([np.add.reduceat(np.abs(r), starts) for r in rest], axis=1)
    costs[:, 3] += 40
    kind = costs.argmin(axis=1)
    order = np.array([0, 1, 2, _LPC])[kind]
    res = rest[3].copy()
    for f in np.flatnonzero(kind != 3):
        res[starts[f] : starts[f] + sizes[f]] = rest[kind[f]][starts[f] : starts[f] + sizes[f]]
    u = (res << 1) ^ (res >> 31)
    count = sizes - order
    mean = np.add.reduceat(u, starts) / count
    k0 = np.clip(np.floor(np.log2(np.maximum(mean, 1.0))).astype("i4"), 1, 14)
    best = [np.add.reduceat(u >> np.repeat(kk, sizes), starts) + count * (kk + 1) for kk in (k0 - 1, k0)]
    k = np.where(best[0] < best[1], k0 - 1, k0).astype("i4")
    best = np.minimum(*best)
    same = np.maximum.reduceat(flat, starts) == np.minimum.reduceat(flat, starts)
    head_bits = np.where(kind == 3, 8 + 8 * order + 9 + _PRECISION * _LPC + 10, 8 + 8 * order + 10)
    raw = ~same & (head_bits + best >= 8 + 8 * sizes)
    body = np.where(same, 16, np.where(raw, 8 + 8 * sizes, head_bits + best))
    headers = []
    for n, s in zip(number, sizes.tolist()):
        h = b"\xff\xf8\x74\x02" + _utf8_number(n) + struct.pack(">H", s - 1)
        headers.append(h + bytes([crc8(h)]))
    head_bytes = np.array([len(h) for h in headers])
    frame_bytes = head_bytes + (body + 7) // 8
    begin = np.concatenate([[0], np.cumsum(frame_bytes)])[:-1]
    # a code is its quotient's zeros, a one and k bits; only the last k + 1 bits are written, into two 32-bit words
    coded = ~(same | raw)
    on = np.repeat(coded, sizes)
    for j in range(_LPC):
        on[warm[j][order > j]] = False
    owners = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)[on]
    kk, uu = k[owners], u[on]
    length = (uu >> kk) + 1 + kk
    ends = np.cumsum(length, dtype="i8")
    words = np.zeros(int(frame_bytes.sum()) // 4 + 3, dtype="u4")
    if len(owners):
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        shift = np.zeros(len(sizes), dtype="i8")
        shift[owners[first]] = (8 * (begin + head_bytes) + head_bits)[owners[first]] - (ends[first] - length[first])
        ends += shift[owners]
        word = (ends - kk - 1) >> 5
        value = ((1 << kk) | (uu & ((1 << kk) - 1))).astype("u8") << (64 - (ends - 32 * word)).astype("u8")
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        own = word[edge]
        words[own] = np.add.reduceat(value >> np.uint64(32), edge)
        np.add.at(words, own + 1, np.add.reduceat(value & np.uint64(0xFFFFFFFF), edge).astype("u4"))
    packed = words.astype(">u4").view("u1")[: int(frame_bytes.sum())]
    sample = (flat & 0xFF).astype("u1")
    for f in range(len(sizes)):
        at, s0 = int(begin[f] + head_bytes[f]), int(starts[f])
        packed[begin[f] : at] = np.frombuffer(headers[f], dtype="u1")
        if same[f]:
            value, width = int(sample[s0]), 16
        elif raw[f]:
            packed[at] = 0x02
            packed[at + 1 : at + 1 + int(sizes[f])] = sample[s0 : s0 + int(sizes[f])]
            continue
        else:
            o = int(order[f])
            value, width = (0x40 | (o - 1) << 1) if kind[f] == 3 else (0x10 | o << 1), 8
            for j in range(o):
                value, width = value << 8 | int(sample[s0 + j]), width + 8
            if kind[f] == 3:
                value, width = value << 9 | (_PRECISION - 1) << 5 | _SHIFT, width + 9
                for c in coefs[f].tolist():
                    value, width = value << _PRECISION | c & ((1 << _PRECISION) - 1), width + _PRECISION
            value, width = value << 10 | int(k[f]), width + 10
        n = (width + 7) // 8
        packed[at : at + n] |= np.frombuffer((value << (-width % 8)).to_bytes(n, "big"), dtype="u1")
    sums = crc16s(packed, begin, frame_bytes)
    return [packed[b : b + n].tobytes() + struct.pack(">H", int(c)) for b, n, c in zip(begin.tolist(), frame_bytes.tolist(), sums.tolist())]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload; none may be empty. About BATCH bytes are worked on at a time, inside long payloads too."""
    frames: list = [[] for _ in payloads]
    part, owners, total = [], [], 0
    for i, p in enumerate(payloads):
        for k, at in enumerate(range(0, len(p), BLOCK)):
            part.append((k, p[at : at + BLOCK]))
            owners.append(i)
            total += len(part[-1][1])
            if total >= BATCH or (i == len(payloads) - 1 and at + BLOCK >= len(p)):
                for owner, frame in zip(owners, _frames(part)):
                    frames[owner].append(frame)
                part, owners, total = [], [], 0
    out = []
    for p, own in zip(payloads, frames):
        digest, points, offset = hashlib.md5(), [], 0
        for at in range(0, len(p), BATCH):
            digest.update((np.frombuffer(p[at : at + BATCH], dtype="u1") ^ 0x80).tobytes())
        for k, frame in enumerate(own):
            points.append((k * BLOCK, offset, min(BLOCK, len(p) - k * BLOCK)))
            offset += len(frame)
        least, most = min(map(len, own)), max(map(len, own))
        info = struct.pack(">HHBHBH", BLOCK, BLOCK, least >> 16, least & 0xFFFF, most >> 16, most & 0xFFFF) + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + digest.digest()
        seek = b"".join(struct.pack(">QQH", *x) for x in points)
        # a metadata block holds 24 bits of length, some 3.8 GB of samples; beyond, frames are found one after the other
        table = b"\x83" + len(seek).to_bytes(3, "big") + seek if len(seek) < 1 << 24 else b""
        out.append(b"fLaC" + (b"\x00" if table else b"\x80") + len(info).to_bytes(3, "big") + info + table + b"".join(own))
    return out


# -- reading -----------------------------------------------------------------------------------------------------------


class FlacError(ValueError):
    """The stream is no FLAC of the supported kind, or a checksum fails."""


@dataclass
class Stream:
    samples: int
    bits: int
    md5: bytes
    block: int
    points: list
    at: int  # of the first frame


def read_head(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("metadata ends early")
        last, kind, size = data[at] >= 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        own = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(own[10:18], "big")
            if packed >> 41 & 7:
                raise FlacError("only mono is read")
            info = (packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, own[18:34], int.from_bytes(own[2:4], "big"))
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", own) if p[0] != (1 << 64) - 1]
        at += 4 + size
    if info is None:
        raise FlacError("no stream information")
    return Stream(info[0], info[1], info[2], info[3], points, at)


def _frame_head(data: bytes, at: int, bits: int) -> tuple[int, int, int]:
    """(samples, sample size, bytes of the header), its checksum verified."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should start")
    code, rate, size = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 1 & 7
    if data[at + 3] >> 4:
        raise FlacError("only mono is read")
    p = at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length()
    if code == 6:
        n, p = data[p] + 1, p + 1
    elif code == 7:
        n, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        n = 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise FlacError("a frame header's checksum fails")
    return n, {0: bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24}[size], p + 1 - at


class _Reader:
    """Numbers of any width at a bit position."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, width: int) -> int:
        end = self.at + width
        if end > 8 * len(self.data):
            raise FlacError("a frame ends early")
        raw = int.from_bytes(self.data[self.at // 8 : (end + 7) // 8], "big")
        self.at = end
        return raw >> (-end % 8) & ((1 << width) - 1)

    def signed(self, width: int) -> int:
        x = self.take(width)
        return x - (1 << width) if width and x >> (width - 1) else x

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _restore(samples: list, residual: list, coefs: list, shift: int) -> list:
    out, order = list(samples), len(coefs)
    for r in residual:
        out.append(r + (sum(c * out[-1 - j] for j, c in enumerate(coefs)) >> shift) if order else r)
    return out


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _slow_frame(data: bytes, at: int, bits: int) -> tuple[list, int]:
    """Samples of any frame, a code at a time, and its bytes without the checksum."""
    n, bits, head = _frame_head(data, at, bits)
    r = _Reader(data, 8 * (at + head))
    kind = r.take(8)
    waste = 0
    if kind & 1:
        waste = r.unary() + 1
        bits -= waste
    kind = kind >> 1 & 63
    if kind == 0:
        out = [r.signed(bits)] * n
    elif kind == 1:
        out = [r.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm = [r.signed(bits) for _ in range(order)]
        coefs, shift = FIXED.get(order, []), 0
        if kind >= 32:
            width, shift = r.take(4) + 1, r.signed(5)
            coefs = [r.signed(width) for _ in range(order)]
        method, parts = r.take(2), r.take(4)
        residual = []
        for part in range(1 << parts):
            k = r.take(4 + method)
            m = (n >> parts) - (order if part == 0 else 0)
            if k == (15, 31)[method]:
                width = r.take(5)
                residual += [r.signed(width) if width else 0 for _ in range(m)]
            else:
                for _ in range(m):
                    u = r.unary() << k | r.take(k)
                    residual.append(u >> 1 ^ -(u & 1))
        out = _restore(warm, residual, coefs, shift)
    else:
        raise FlacError("a reserved subframe")
    return [x << waste for x in out], (r.at + 7) // 8 - at


def _fast_frames(data: bytes, frames: list[tuple[int, int]]) -> dict:
    """Samples by frame of those (offset, end) frames with one Rice partition and 8 bits, all decoded together.

    A unary end is found by following, from code to code, the next one bit at or after a position; all frames step together.
    """
    flat = np.frombuffer(data + b"\0\0\0\0", dtype="u1")
    lanes = []
    for f, (at, end) in enumerate(frames):
        try:
            n, bits, head = _frame_head(data, at, 8)
        except FlacError:
            continue
        p = at + head
        kind = data[p] >> 1
        if bits != 8 or data[p] & 1 or not (8 <= kind <= 10 or 32 <= kind <= 39):
            continue
        order = kind - 8 if kind < 32 else kind - 31
        warm = np.frombuffer(data, dtype="i1", count=order, offset=p + 1)
        r = _Reader(data, 8 * (p + 1 + order))
        coefs, shift = None, 0
        if kind >= 32:
            width, shift = r.take(4) + 1, r.signed(5)
            coefs = [r.signed(width) for _ in range(order)]
        if r.take(6) or n <= order or shift < 0:
            continue
        k = r.take(4)
        if k < 15:
            lanes.append((n - order, f, order, warm, coefs, shift, k, r.at))
    out: dict = {}
    if not lanes:
        return out
    lanes.sort(key=lambda x: -x[0])
    bits = np.unpackbits(flat)
    size = len(bits)
    nxt = np.where(bits, np.arange(size, dtype="i4"), np.int32(size - 1))
    del bits
    nxt = np.minimum.accumulate(nxt[::-1])[::-1].copy()
    counts = np.array([x[0] for x in lanes])
    ks = np.array([x[6] for x in lanes], dtype="i4")
    live = len(lanes) - np.searchsorted(counts[::-1], np.arange(1, counts[0] + 1), side="left")
    ends = np.zeros((counts[0], len(lanes)), dtype="i4")
    cur, jump = np.array([x[7] for x in lanes], dtype="i4"), ks + 1
    start = cur.copy()
    for i, n in enumerate(live.tolist()):
        found = nxt[cur[:n]]
        ends[i, :n] = found
        cur[:n] = np.minimum(found + jump[:n], size - 1)
    begin = np.empty_like(ends)
    begin[0], begin[1:] = start, ends[:-1] + jump
    at = np.minimum(ends + 1, size - 32)
    byte = at >> 3
    at &= 7
    low = flat[byte].astype("i4") << 16
    byte += 1
    low |= flat[byte].astype("i4") << 8
    byte += 1
    low |= flat[byte]
    low >>= (24 - ks) - at
    low &= (1 << ks) - 1
    u = ((ends - begin) << ks) | low
    res = (u >> 1) ^ -(u & 1)
    last_ends = ends[counts - 1, np.arange(len(lanes))]
    del u, low, at, byte, begin, ends, nxt
    linear = [j for j, x in enumerate(lanes) if x[4] is not None]
    restored = {}
    if linear:
        most = max(lanes[j][2] for j in linear)
        tall = max(lanes[j][0] for j in linear)
        c = np.zeros((most, len(linear)), dtype="i4")
        x = np.zeros((tall + most, len(linear)), dtype="i4")
        shifts = np.array([lanes[j][5] for j in linear], dtype="i4")
        for i, j in enumerate(linear):
            order = lanes[j][2]
            c[:order, i] = lanes[j][4]
            x[most - order : most, i] = lanes[j][3]
        own = res[:tall, linear]
        widths = len(linear) - np.searchsorted(counts[linear][::-1], np.arange(1, tall + 1), side="left")
        total, part = np.empty(len(linear), dtype="i4"), np.empty(len(linear), dtype="i4")
        multiply, add, shift_right = np.multiply, np.add, np.right_shift
        width = 0
        for t, m in enumerate(widths.tolist()):
            if m != width:
                width, a, b, sh = m, total[:m], part[:m], shifts[:m]
                cs = [c[j, :m] for j in range(most)]
            multiply(cs[0], x[t + most - 1, :m], a)
            for j in range(1, most):
                multiply(cs[j], x[t + most - 1 - j, :m], b)
                add(a, b, a)
            shift_right(a, sh, a)
            add(a, own[t, :m], x[t + most, :m])
        flipped = np.ascontiguousarray(x.T.astype("i1"))
        restored = {j: flipped[i, most - lanes[j][2] : most + lanes[j][0]] for i, j in enumerate(linear)}
    for j, (n, f, order, warm, coefs, _, k, _) in enumerate(lanes):
        if coefs is None:
            r = res[:n, j]
            w = warm.astype("i4")
            for lvl in range(order, 0, -1):
                lead = np.diff(w, n=lvl - 1)[-1]
                r = lead + np.cumsum(r)
            samples = np.concatenate([w, r])
        else:
            samples = restored[j]
        last = int(last_ends[j]) + 1 + k
        out[f] = (samples.astype("i1"), (last + 7) // 8 - frames[f][0])
    return out


def decode(streams: list[bytes]) -> list:
    """For each stream its blocks as (sample offset, samples), or the FlacError that stopped it."""
    heads, out, jobs = [], [None] * len(streams), []
    base, parts = 0, []
    for i, data in enumerate(streams):
        try:
            head = read_head(data)
        except (FlacError, IndexError, struct.error) as e:
            out[i] = e if isinstance(e, FlacError) else FlacError("damaged metadata")
            head = None
        heads.append(head)
        if head and head.bits == 8 and sum(p[2] for p in head.points) == head.samples:
            edges = [p[1] for p in head.points] + [len(data) - head.at]
            jobs += [(i, base + head.at + a, base + head.at + b) for a, b in zip(edges, edges[1:])]
        parts.append(data)
        base += len(data)
    whole = b"".join(parts)
    fast, good, at = {}, set(), 0
    while at < len(jobs):  # about BATCH bytes of frames at a time
        to = at + 1
        while to < len(jobs) and jobs[to][2] - jobs[at][1] <= BATCH:
            to += 1
        first = jobs[at][1]
        data = whole[first : jobs[to - 1][2]]
        own = {at + f: x for f, x in _fast_frames(data, [(a - first, b - first) for _, a, b in jobs[at:to]]).items()}
        fits = [f for f, x in own.items() if x[1] + 2 == jobs[f][2] - jobs[f][1]]
        if fits:
            sizes, flat = np.array([own[f][1] for f in fits]), np.frombuffer(data, dtype="u1")
            joined = np.concatenate([flat[jobs[f][1] - first :][: own[f][1]] for f in fits])
            sums = crc16s(joined, np.cumsum(sizes) - sizes, sizes)
            good |= {f for f, s in zip(fits, sums.tolist()) if whole[jobs[f][2] - 2 : jobs[f][2]] == struct.pack(">H", s)}
        fast.update(own)
        at = to
    by_stream: dict = {}
    for f, (i, _, _) in enumerate(jobs):
        by_stream.setdefault(i, []).append(f)
    base = 0
    for i, data in enumerate(streams):
        head = heads[i]
        if head:
            try:
                own = by_stream.get(i, [])
                blocks, at, done = [], head.at, 0
                for f in own:
                    if f in good:
                        blocks.append((done, fast[f][0]))
                    else:
                        got, _ = _checked(data, jobs[f][1] - base, head.bits)
                        blocks.append((done, got))
                    done += len(blocks[-1][1])
                while not own and at < len(data):
                    got, size = _checked(data, at, head.bits)
                    blocks.append((done, got))
                    done, at = done + len(got), at + size
                if head.samples and done != head.samples:
                    raise FlacError("samples are missing")
                width, digest = (head.bits + 7) // 8, hashlib.md5()
                for _, own_samples in blocks:
                    digest.update(pcm(own_samples, width))
                if any(head.md5) and digest.digest() != head.md5:
                    raise FlacError("the stream's checksum fails")
                out[i] = blocks
            except (FlacError, IndexError, KeyError) as e:
                out[i] = e if isinstance(e, FlacError) else FlacError("a frame is damaged")
        base += len(data)
    return out


def _checked(data: bytes, at: int, bits: int) -> tuple[np.ndarray, int]:
    got, size = _slow_frame(data, at, bits)
    own = np.frombuffer(data, dtype="u1", count=size, offset=at)
    if data[at + size : at + size + 2] != struct.pack(">H", int(crc16s(own, np.array([0]), np.array([size]))[0])):
        raise FlacError("a frame's checksum fails")
    return np.array(got, dtype="i1" if bits <= 8 else "i4"), size + 2


def pcm(samples: np.ndarray, width: int = 1) -> bytes:
    """Little-endian signed PCM of that many bytes a sample."""
    if width == 1:
        return samples.astype("i1").tobytes()
    return np.ascontiguousarray(samples.astype("<i4").view("u1").reshape(-1, 4)[:, :width]).tobytes()


# -- columns -----------------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    return raw + bytes(64 if not raw else -len(raw) % 64)


def _groups(items, size):
    part, total = [], 0
    for x in items:
        part.append(x)
        total += size(x)
        if total >= BATCH:
            yield part
            part, total = [], 0
    if part:
        yield part


def encode_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, flac: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a stream."""
    ready(spark)

    @lean
    def run(batches):
        for batch in batches:
            at = 0
            for raws in _groups(((t.as_py() or "").encode() for t in batch.column(1)), len):
                made = encode([padded(r) for r in raws])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raws)), pa.array([len(r) for r in raws], pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "flac"])
                at += len(raws)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, flac binary")


def decode_blocks(spark: SparkSession, media: DataFrame, key: str = "doc_id", column: str = "flac") -> DataFrame:
    """A row per PCM block: key, block, sample_offset, n_samples, pcm (signed little-endian), error.

    A null stream, or one whose checksums fail, gives one row with block -1, a null pcm and what is wrong.
    """
    ready(spark)
    kind = media.schema[key].dataType.simpleString()

    @lean
    def run(batches):
        for batch in batches:
            at = 0
            for part in _groups((x.as_py() or b"" for x in batch.column(1)), lambda x: 2 * len(x)):
                keys, rows = batch.column(0).slice(at, len(part)), []
                at += len(part)
                for i, got in enumerate(decode(part)):
                    if isinstance(got, FlacError):
                        rows.append((i, -1, None, None, None, str(got)))
                    else:
                        rows += [(i, b, off, len(x), pcm(x, 1 if x.dtype.itemsize == 1 else (read_head(part[i]).bits + 7) // 8), None) for b, (off, x) in enumerate(got)]
                i, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), *[pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()))]], names=[key, "block", "sample_offset", "n_samples", "pcm", "error"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, block int, sample_offset long, n_samples int, pcm binary, error string")


def describe(blocks: list) -> tuple:
    """Of a stream's blocks: payload bytes, their sha256, crc32 of the last 64, the feature, blocks, digest of their offsets.

    The feature holds whole numbers: samples, sum, sum of squares, sign changes, least and greatest.
    """
    digest, tail, n, total, energy, turns, least, most, below = hashlib.sha256(), b"", 0, 0, 0, 0, 127, -128, None
    for _, x in blocks:
        payload = (x.view("u1") ^ 0x80).tobytes()
        digest.update(payload)
        tail = (tail + payload[-64:])[-64:]
        wide, sign = x.astype("i4"), x < 0
        n, total, energy = n + len(x), total + int(wide.sum()), energy + int((wide * wide).sum())
        turns += int(np.count_nonzero(sign[1:] != sign[:-1])) + (below is not None and bool(sign[0]) != below)
        least, most, below = min(least, int(x.min())), max(most, int(x.max())), bool(sign[-1])
    offsets = hashlib.sha256(",".join(str(at) for at, _ in blocks).encode()).hexdigest()
    return n, digest.hexdigest(), zlib.crc32(tail), f"n={n};sum={total};energy={energy};turns={turns};min={least};max={most}", len(blocks), offsets


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, offsets_sha256 string"


def read_back(spark: SparkSession, media: DataFrame) -> DataFrame:
    """What is in the streams of encode_texts: sizes, digests and features, from the decoded blocks.

    n_blocks and offsets_sha256 (of the comma-joined sample offsets) describe the same blocks that decode_blocks writes.
    """
    ready(spark)

    @lean
    def run(batches):
        for batch in batches:
            at = 0
            for part in _groups((x.as_py() for x in batch.column(2)), lambda x: 2 * len(x)):
                rows = []
                for stream, got in zip(part, decode(part)):
                    if isinstance(got, FlacError):
                        raise got
                    n, sha, tail, feature, blocks, offsets = describe(got)
                    rows.append((n, sha, tail, len(stream), hashlib.sha256(stream).hexdigest(), feature, blocks, offsets))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                head = [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part))]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(x, t) for x, t in zip(zip(*rows), kinds)]], names=[c.split()[0] for c in _READ.split(", ")])

    return media.mapInArrow(run, _READ)


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`: written as FLAC, read back, and described.

    A null text is empty, so its payload is 64 zeros. A very long text is coded and read a megabyte at a time. Repeated rows are stored each; an empty table gives no rows; other
    columns are not read.
    """
    return read_back(spark, encode_texts(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")))
