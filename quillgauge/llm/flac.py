"""Media columns: FLAC streams of one 8-bit channel.

The encoder writes frames of a fixed number of samples: constant, verbatim, or
the shortest of the fixed predictors and a linear predictor of the frame's own,
with Rice parameters for the whole frame or for each quarter of it, and a seek
table that lists every frame.  The decoder verifies the checksums of headers
and frames and the digest of all samples, decodes constant, verbatim, fixed and
linear-predictor subframes with partitioned Rice residuals and escaped
partitions, and gives blocks of PCM with their sample offsets, which are written
as a table.  All frames of a batch advance together, one sample at a time, as
rows of a matrix.

Edge cases: a null or empty text is a payload of blanks; an empty payload gives
a stream of no frames; null media decode to no blocks and no error; a stream
that fails a check raises ValueError in ``decode_batch``, and in ``pcm_table``
gives a row with the error and no blocks, while its neighbours decode; a very
long text is one stream, coded frame by frame with its neighbours; repeated rows
and equal payloads give equal streams; ties between ways to code a frame go to
the first in order; an empty table gives no rows; other columns of documents,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a frame; this size has a code of its own in frame headers.
BLOCK = 192
RATE = 8000
PAD = 192
#: Order and bits of a weight of the encoder's linear predictor, and its largest Rice parameter.
LPC_ORDER, PRECISION, MOST_RICE = 4, 7, 8
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
#: Frames that are coded together.
TOGETHER = 4096


def crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc_rows(data: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Checksum of the first ``lengths[i]`` bytes of each row."""
    table, crc = (CRC8 if bits == 8 else CRC16), np.zeros(len(data), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    data, crc = data[order], crc[order]
    for i, n in enumerate(live):
        c = crc[:n]
        crc[:n] = ((c << 8) & ((1 << bits) - 1)) ^ table[(c >> (bits - 8)) ^ data[:n, i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the variable-length code of frame headers (as UTF-8, up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 2
    while n >= 1 << (5 * size + 1 if size < 7 else 36):
        size += 1
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF00 >> size & 0xFF) | n, *reversed(tail)])


def zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def linear_predictor(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the weights of the ``order`` samples before, as integers, and by how many bits they are scaled up.

    Weights solve the normal equations of the row's autocorrelation (Levinson
    and Durbin's recursion, all rows at once).
    """
    f = x.astype(np.float64)
    r = [np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(order + 1)]
    a, error = np.zeros((len(x), order)), r[0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[i + 1] - sum((a[:, j] * r[i - j] for j in range(i)), np.zeros(len(x)))) / error
        a[:, :i], a[:, i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1], k
        error = error * np.maximum(1 - k * k, 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    shift = np.clip(np.floor(np.log2(top / np.maximum(np.abs(a).max(axis=1, initial=1e-3), 1e-3))), 0, 15).astype(np.int64)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -top - 1, top).astype(np.int64), shift


def lpc_residuals(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order = weights.shape[1]
    p = sum(weights[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j] for j in range(order))
    return x[:, order:] - (p >> shift[:, None])


@dataclass
class Subframes:
    """One way to code the rows of a matrix: what their residuals are, and the Rice parameters that suit these best."""

    kind: int  # six bits of the subframe header
    order: int
    codes: np.ndarray  # residuals as unsigned numbers, 0 for warm-up samples
    parts: int = 1
    params: np.ndarray | None = None
    bits: np.ndarray | None = None

    def choose(self, extra: int) -> Subframes:
        """Rice parameters and size in bits; in four partitions where all rows together are shorter that way, row by row decided by the caller."""
        n, block = self.codes.shape
        count = np.full(self.parts, block // self.parts)
        count[0] -= self.order
        sums = np.array([(self.codes >> k).reshape(n, self.parts, -1).sum(axis=2, dtype=np.int64) + count * (k + 1) for k in range(MOST_RICE + 1)])
        self.params = sums.argmin(axis=0)
        self.bits = sums.min(axis=0).sum(axis=1) + 4 * self.parts + extra
        return self


def candidates(x: np.ndarray) -> tuple[list[Subframes], np.ndarray, np.ndarray]:
    """The ways to code frames of these rows, and the weights and scales of the linear predictor."""
    n, block = x.shape
    small = x.astype(np.int32)
    out, weights, shift = [], np.zeros((n, LPC_ORDER), np.int64), np.zeros(n, np.int64)
    for order in range(3):
        if block > order:
            codes = np.zeros((n, block), np.int32)
            codes[:, order:] = zigzag(np.diff(small, n=order, axis=1))
            out.append(Subframes(8 + order, order, codes).choose(8 * order + 6))
    if block >= 4 * LPC_ORDER:
        weights, shift = linear_predictor(x, LPC_ORDER)
        codes = np.zeros((n, block), np.int32)
        codes[:, LPC_ORDER:] = zigzag(lpc_residuals(x, weights, shift))
        out.append(Subframes(31 + LPC_ORDER, LPC_ORDER, codes).choose((8 + PRECISION) * LPC_ORDER + 9 + 6))
    for c in list(out):
        if block % 4 == 0 and block // 4 > c.order:
            more = (8 + PRECISION) * c.order + 9 if c.kind >= 32 else 8 * c.order
            out.append(Subframes(c.kind, c.order, c.codes, 4).choose(more + 6))
    return out, weights, shift


def put(bits: np.ndarray, at: int, values: np.ndarray, width: int) -> int:
    """Write a value of ``width`` bits into each row; where the next bit goes."""
    for j in range(width):
        bits[:, at + j] = values >> (width - 1 - j) & 1
    return at + width


def subframe_bits(c: Subframes, rows: np.ndarray, at: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the subframes of some rows (samples ``rows``, numbers ``at``), and where each ends."""
    raw, n, block = rows.astype(np.int8).view(np.uint8), len(rows), rows.shape[1]
    u, k = c.codes[at], np.repeat(c.params[at], block // c.parts, axis=1)
    sizes = (u >> k) + 1 + k
    sizes[:, : c.order] = 0
    first = 8 + 8 * c.order + ((9 + PRECISION * c.order) if c.kind >= 32 else 0) + 6
    lead = np.zeros(block, np.int64)
    lead[:: block // c.parts] = 4  # the parameter before each partition
    ends = first + np.cumsum(sizes + lead, axis=1)
    bits = np.zeros((n, int(ends[:, -1].max()) + 1 + MOST_RICE), np.uint8)
    put(bits, 0, np.full(n, c.kind << 1), 8)
    bits[:, 8 : 8 + 8 * c.order] = np.unpackbits(raw[:, : c.order], axis=1)
    here = 8 + 8 * c.order
    if c.kind >= 32:
        here = put(bits, here, np.full(n, PRECISION - 1), 4)
        here = put(bits, here, shift[at], 5)
        for j in range(c.order):
            here = put(bits, here, weights[at, j] & ((1 << PRECISION) - 1), PRECISION)
    put(bits, here, np.full(n, c.parts.bit_length() - 1), 6)
    r = np.arange(n)
    for p in range(c.parts):
        begin = ends[:, p * (block // c.parts)] - sizes[:, p * (block // c.parts)] - 4
        for j in range(4):
            bits[r, begin + j] = c.params[at, p] >> (3 - j) & 1
    u, k, stop = u[:, c.order :], k[:, c.order :], ends[:, c.order :] - 1 - k[:, c.order :]
    r = r[:, None]
    bits[r, stop] = 1
    waste = bits.shape[1] - 1
    for j in range(int(k.max(initial=0))):
        bits[r, np.where(j < k, stop + 1 + j, waste)] = u >> np.maximum(k - 1 - j, 0) & 1
    bits[:, waste] = 0
    return bits, ends[:, -1]


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of equally many samples (rows of signed 8-bit values) with the given frame numbers."""
    n, block = x.shape
    ways, weights, shift = candidates(x)
    cost = np.array([np.where((x == x[:, :1]).all(axis=1), 8, 8 * block + 1), np.full(n, 8 * block), *(w.bits for w in ways)])  # constant, verbatim, predicted
    choice = cost.argmin(axis=0)
    head = [struct.pack(">HBB", 0xFFF8, (1 if block == BLOCK else 7) << 4, 0x02) + coded_number(int(i)) + (b"" if block == BLOCK else struct.pack(">H", block - 1)) for i in numbers]
    sizes = np.array([len(h) for h in head])
    heads = np.zeros((n, sizes.max() + 1), np.uint8)
    heads[:, : sizes.max()] = np.frombuffer(b"".join(h.ljust(sizes.max(), b"\0") for h in head), np.uint8).reshape(n, -1)
    heads[np.arange(n), sizes] = crc_rows(heads, sizes, 8)
    out: list[bytes] = [b""] * n
    for way in np.unique(choice).tolist():
        at = np.flatnonzero(choice == way)
        rows = x[at]
        raw = rows.astype(np.int8).view(np.uint8)
        if way < 2:
            kept = raw[:, :1] if way == 0 else raw
            body = np.concatenate([np.full((len(at), 1), way << 1, np.uint8), kept], axis=1)
            ends = np.full(len(at), 8 * body.shape[1])
        else:
            bits, ends = subframe_bits(ways[way - 2], rows, at, weights, shift)
            body = np.packbits(bits, axis=1)
        own = sizes[at] + 1
        lengths = own + (ends + 7) // 8
        whole = np.zeros((len(at), int(lengths.max()) + 2), np.uint8)
        for h in np.unique(own):
            m = own == h
            whole[m, :h] = heads[at[m], :h]
            width = min(body.shape[1], whole.shape[1] - h)
            whole[m, h : h + width] = body[m, :width]
        crc = crc_rows(whole, lengths, 16)
        i = np.arange(len(at))
        whole[i, lengths], whole[i, lengths + 1] = crc >> 8, crc & 0xFF
        flat = whole.tobytes()
        for j, (row, end) in enumerate(zip(at.tolist(), (lengths + 2).tolist(), strict=True)):
            out[row] = flat[j * whole.shape[1] : j * whole.shape[1] + end]
    return out


def metadata(kind: int, body: bytes, last: bool) -> bytes:
    return bytes([kind | (0x80 if last else 0)]) + len(body).to_bytes(3, "big") + body


def encode_batch(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """FLAC streams of payloads; a byte b is the sample b - 128."""
    whole = [np.frombuffer(p, np.uint8, len(p) - len(p) % block).astype(np.int16).reshape(-1, block) - 128 for p in payloads]
    numbers = np.concatenate([np.arange(len(w)) for w in whole]) if whole else np.zeros(0, np.int64)
    rows = np.concatenate(whole) if whole else np.zeros((0, block), np.int16)
    frames: list[bytes] = []
    for i in range(0, len(rows), TOGETHER):
        frames += encode_frames(rows[i : i + TOGETHER].astype(np.int64), numbers[i : i + TOGETHER])
    out, at = [], 0
    for p, w in zip(payloads, whole, strict=True):
        own = frames[at : at + len(w)]
        at += len(w)
        if rest := len(p) % block:
            tail = np.frombuffer(p, np.uint8, rest, len(p) - rest).astype(np.int64).reshape(1, -1) - 128
            own = own + encode_frames(tail, np.array([len(w)]))
        sizes = [len(f) for f in own]
        info = struct.pack(">HH", max(block, 16), max(block, 16)) + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        starts = np.cumsum([0, *sizes])[:-1]
        points = np.zeros(len(own), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = np.arange(len(own)) * block, starts, block
        if rest:
            points["n"][-1] = rest
        seek = points.tobytes()
        parts = [b"fLaC", metadata(0, info, not own)]
        if own:
            step = 18 * 900_000  # a block of metadata holds less than 16 MiB
            parts += [metadata(3, seek[i : i + step], i + step >= len(seek)) for i in range(0, len(seek), step)]
        out.append(b"".join([*parts, *own]))
    return out


@dataclass
class Stream:
    """What precedes the frames of one stream."""

    data: bytes
    total: int
    digest: bytes
    bits: int
    channels: int
    block: int
    start: int
    points: list[tuple[int, int, int]]

    @classmethod
    def parse(cls, data: bytes) -> Stream:
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, info, points = 4, False, None, []
        while not last:
            if at + 4 > len(data):
                raise ValueError("metadata cut short")
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            at += 4 + size
            if kind == 0:
                info = body
            elif kind == 3:
                points += [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        if info is None or len(info) < 34:
            raise ValueError("no stream information")
        packed = int.from_bytes(info[10:18], "big")
        return cls(data, packed & ((1 << 36) - 1), info[18:34], (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, struct.unpack(">H", info[2:4])[0], at, points)

    def complete(self) -> bool:
        """Whether the seek table lists every frame, end to end."""
        at = 0
        for sample, _, n in self.points:
            if sample != at:
                return False
            at += n
        return at == self.total and bool(self.points)


def frame_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Block size, frame number and length in bytes of a verified frame header."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame header")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    end, lead = at + 5, data[at + 4]
    number = lead
    if lead & 0x80:
        size = 8 - (lead ^ 0xFF).bit_length()
        number = lead & ((1 << (7 - size)) - 1)
        for b in data[end : end + size - 1]:
            number = number << 6 | b & 0x3F
        end += size - 1
    if code == 1:
        block = 192
    elif 2 <= code <= 5:
        block = 576 << (code - 2)
    elif code == 6:
        block, end = data[end] + 1, end + 1
    elif code == 7:
        block, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    elif code >= 8:
        block = 256 << (code - 8)
    else:
        raise ValueError("reserved block size")
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(data) or int(crc_rows(np.frombuffer(data, np.uint8, end - at, at)[None, :], np.array([end - at]), 8)[0]) != data[end]:
        raise ValueError("header checksum differs")
    return block, number, end + 1 - at


#: Zeros before the first one of 16 bits.
ZEROS = np.full(1 << 16, 16, np.uint8)
for _b in range(16):
    ZEROS[1 << (15 - _b) : 1 << (16 - _b)] = _b


class Bits:
    """Rows of bits with a reading position for each row; 57 bits or more from any position are at hand in one word."""

    def __init__(self, rows: np.ndarray):
        width = rows.shape[1]
        wide = np.concatenate([rows, np.full((len(rows), 16), 0xFF, np.uint8)], axis=1).astype(np.uint64)
        self.words = np.zeros((len(rows), width + 8), np.uint64)
        for j in range(8):
            self.words |= wide[:, j : j + width + 8] << np.uint64(56 - 8 * j)
        self.flat, self.stride = self.words.ravel(), width + 8
        self.at = np.zeros(len(rows), np.int64)
        self.row = np.arange(len(rows))
        self.last = 8 * (width + 7)

    def peek(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The bits of some rows from these positions on, in the upper part of 64."""
        at = np.minimum(at, self.last)
        return self.flat[rows * self.stride + (at >> 3)] << (at & 7).astype(np.uint64)

    def take(self, n: int, rows: np.ndarray | None = None) -> np.ndarray:
        rows = self.row if rows is None else rows
        if not n:
            return np.zeros(len(rows), np.int64)
        out = (self.peek(rows, self.at[rows]) >> np.uint64(64 - n)).astype(np.int64)
        self.at[rows] += n
        return out

    def signed(self, n: int, rows: np.ndarray | None = None) -> np.ndarray:
        v = self.take(n, rows)
        return np.where(v >> (n - 1) & 1, v - (1 << n), v) if n else v

    def rice(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """A signed number in Rice code from each of some rows, with the parameter of each."""
        at = self.at[rows]
        x = self.peek(rows, at)
        q = ZEROS[x >> np.uint64(48)].astype(np.int64)
        long = np.flatnonzero(q == 16)
        far = long
        while len(far):
            more = ZEROS[self.peek(rows[far], at[far] + q[far]) >> np.uint64(48)]
            q[far] += more
            far = far[(more == 16) & (at[far] + q[far] < self.last)]
        if len(long):
            x[long] = self.peek(rows[long], at[long] + q[long])
        used = q + 1
        used[long] = 1
        low = np.where(k > 0, (x << used.astype(np.uint64)) >> (64 - np.maximum(k, 1)).astype(np.uint64), 0).astype(np.int64)
        self.at[rows] = at + q + 1 + k
        u = (q << k) | low
        return np.where(u & 1, -(u >> 1) - 1, u >> 1)


def decode_subframes(b: Bits, kinds: int, block: int, depth: int) -> np.ndarray:
    """Samples of rows whose subframes are all of the kind given (six bits), read from behind the header."""
    n = len(b.row)
    if kinds == 0:
        return np.repeat(b.signed(depth)[:, None], block, axis=1)
    out = np.zeros((n, block), np.int64)
    if kinds == 1:
        for i in range(block):
            out[:, i] = b.signed(depth)
        return out
    if 8 <= kinds <= 12:
        order = kinds - 8
    elif kinds >= 32:
        order = kinds - 31
    else:
        raise ValueError("reserved subframe")
    for i in range(order):
        out[:, i] = b.signed(depth)
    if kinds >= 32:
        precision, shift = b.take(4) + 1, b.take(5)
        if (precision != precision[0]).any():
            raise ValueError("rows of different precision")
        weights, shift = [b.signed(int(precision[0])) for _ in range(order)], shift
    else:
        weights, shift = [np.full(n, w) for w in FIXED[order]], np.zeros(n, np.int64)
    method, parts = b.take(2), b.take(4)
    if (method > 1).any() or (method != method[0]).any() or (parts != parts[0]).any():
        raise ValueError("reserved or mixed residual coding")
    wide, cut = 4 + int(method[0]), block >> int(parts[0])
    k = None
    for i in range(order, block):
        if k is None or i % cut == 0:
            k = b.take(wide)
            raw = k == (1 << wide) - 1
            plain, escaped = np.flatnonzero(~raw), np.flatnonzero(raw)
            width = np.zeros(n, np.int64)
            if len(escaped):
                width[escaped] = b.take(5, escaped)
        if len(escaped):
            r = np.zeros(n, np.int64)
            for w in np.unique(width[escaped]).tolist():
                some = escaped[width[escaped] == w]
                r[some] = b.signed(w, some)
            if len(plain):
                r[plain] = b.rice(plain, k[plain])
        else:
            r = b.rice(b.row, k)
        if order:
            p = sum(weights[j] * out[:, i - 1 - j] for j in range(order))
            r = r + (p >> shift)
        out[:, i] = r
    return out


def decode_rows(rows: np.ndarray, heads: np.ndarray, ends: np.ndarray | None, block: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of frames (rows of bytes that begin at the frame) of one block size, and their lengths in bytes."""
    n = len(rows)
    kind = rows[np.arange(n), heads]
    if (kind & 1).any():
        raise ValueError("wasted bits are not supported")
    shape = kind.astype(np.int64) >> 1
    extra = np.zeros(n, np.int64)  # rows that differ in what all rows of a matrix must share go separately
    lpc = shape >= 32
    if lpc.any():
        first = 8 * heads + 8 + depth * (shape - 31)
        for i in np.flatnonzero(lpc):
            bits = np.unpackbits(rows[i, first[i] // 8 : first[i] // 8 + 2])[first[i] % 8 : first[i] % 8 + 4]
            extra[i] = int("".join(map(str, bits)), 2)
    for i in np.flatnonzero((shape >= 8)):
        order = shape[i] - 31 if shape[i] >= 32 else shape[i] - 8
        first = 8 * heads[i] + 8 + depth * order + (9 + (extra[i] + 1) * order if shape[i] >= 32 else 0)
        lo = int(first // 8)
        v = int.from_bytes(rows[i, lo : lo + 2].tobytes().ljust(2, b"\0"), "big")
        extra[i] |= (v >> (10 - int(first % 8)) & 63) << 4 if first % 8 <= 10 else 0
    out, sizes = np.zeros((n, block), np.int64), np.zeros(n, np.int64)
    groups: dict[tuple[int, int, int], list[int]] = {}
    for i, key in enumerate(zip(shape.tolist(), extra.tolist(), heads.tolist(), strict=True)):
        groups.setdefault(key, []).append(i)
    for (s, _, h), members in groups.items():
        at = np.array(members)
        b = Bits(rows[at, h + 1 :])
        out[at] = decode_subframes(b, s, block, depth)
        sizes[at] = h + 1 + (b.at + 7) // 8 + 2
    if (sizes > rows.shape[1]).any() or (ends is not None and (sizes != ends).any()):
        raise ValueError("frame cut short")
    crc = crc_rows(rows, sizes - 2, 16)
    i = np.arange(n)
    if (crc != rows[i, sizes - 2].astype(np.uint32) << 8 | rows[i, sizes - 1]).any():
        raise ValueError("frame checksum differs")
    return out, sizes


def decode_unlisted(data: bytes, at: int, head: int, block: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A frame whose end is not known: read in what most frames fit in, else in ever more of the stream."""
    width, rest = 64 + 8 * block, len(data) - at
    while True:
        try:
            return decode_rows(np.frombuffer(data, np.uint8, min(width, rest), at)[None, :], np.array([head]), None, block, depth)
        except (ValueError, IndexError):
            if width >= rest:
                raise
            width *= 8


def decode_batch(media: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """For each stream its samples and (first sample, number of samples) of every block."""
    streams = [Stream.parse(m) for m in media]
    jobs: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = {}
    got: list[dict[int, np.ndarray]] = [{} for _ in media]
    for s, st in enumerate(streams):
        if st.channels != 1 or st.bits > 16:
            raise ValueError("more than one channel or 16 bits")
        if st.complete():
            offsets = [p[1] for p in st.points] + [len(st.data) - st.start]
            for (sample, offset, n), nxt in zip(st.points, offsets[1:], strict=True):
                jobs.setdefault((n, st.bits), []).append((s, sample, st.start + offset, nxt - offset, sample // max(st.block, 1)))
        else:  # without a seek table a frame's end is known only when it is decoded
            at, sample = st.start, 0
            while sample < st.total:
                block, _, head = frame_header(st.data, at)
                x, size = decode_unlisted(st.data, at, head, block, st.bits)
                got[s][sample] = x[0]
                at, sample = at + int(size[0]), sample + block
    for (block, bits), frames in jobs.items():
        frames.sort(key=lambda f: f[3])
        for i in range(0, len(frames), TOGETHER):
            part = frames[i : i + TOGETHER]
            sizes = np.array([f[3] for f in part])
            widest = int(sizes.max())
            rows = np.frombuffer(b"".join([streams[s].data[at : at + n].ljust(widest, b"\0") for s, _, at, n, _ in part]), np.uint8).reshape(len(part), widest)
            heads = check_headers(rows, block)
            x, _ = decode_rows(rows, heads, sizes, block, bits)
            for (s, sample, _, _, _), row in zip(part, x, strict=True):
                got[s][sample] = row
    out = []
    for st, blocks in zip(streams, got, strict=True):
        order = sorted(blocks)
        x = np.concatenate([blocks[k] for k in order]) if order else np.zeros(0, np.int64)
        if len(x) != st.total:
            raise ValueError("samples missing")
        raw = x.astype(np.int8 if st.bits <= 8 else "<i2").tobytes()
        if any(st.digest) and hashlib.md5(raw).digest() != st.digest:
            raise ValueError("digest of the samples differs")
        out.append((x, [(k, len(blocks[k])) for k in order]))
    return out


def check_headers(rows: np.ndarray, block: int) -> np.ndarray:
    """Lengths of the frame headers, all verified together."""
    if rows.shape[1] < 8 or (rows[:, 0] != 0xFF).any() or (rows[:, 1] & 0xFE != 0xF8).any():
        raise ValueError("no frame header")
    lead = rows[:, 4].astype(np.int64)
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code, rate = rows[:, 2] >> 4, rows[:, 2] & 15
    end = 4 + size + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (crc_rows(rows, end, 8) != rows[np.arange(len(rows)), end]).any():
        raise ValueError("header checksum differs")
    for i in np.unique(code, return_index=True)[1]:
        if frame_header(rows[i].tobytes(), 0)[0] != block:
            raise ValueError("block size differs from the seek table")
    return end + 1


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, filled with blanks to a positive multiple of PAD bytes."""
    raw = (text or "").encode("utf-8", "replace")
    return raw.ljust(max(PAD, -(-len(raw) // PAD) * PAD), b" ")


#: Documents that are coded together.
DOCS = 256


def in_parts(frames: Iterator[pa.RecordBatch], docs: int = DOCS) -> Iterator[pa.RecordBatch]:
    for batch in frames:
        for i in range(0, batch.num_rows, docs):
            yield batch.slice(i, docs)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream; a null text counts as empty."""
    key = docs.select("doc_id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(frames):
            texts = [t or "" for t in part.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "replace")) for t in texts]
            media = encode_batch([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {key.dtypes[0][1]}, n_bytes long, media binary")


def decode_each(media: list[bytes | None]) -> list[tuple[np.ndarray, list[tuple[int, int]], str | None]]:
    """Samples, blocks and error of each stream: all together, or one by one where one of them is damaged."""
    there = [m for m in media if m is not None]
    try:
        got = iter([(x, blocks, None) for x, blocks in decode_batch(there)])
    except (ValueError, IndexError, struct.error):
        each = []
        for m in there:
            try:
                each.append((*decode_batch([m])[0], None))
            except (ValueError, IndexError, struct.error) as e:
                each.append((np.zeros(0, np.int64), [], str(e) or type(e).__name__))
        got = iter(each)
    return [(np.zeros(0, np.int64), [], None) if m is None else next(got) for m in media]


BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))


def pcm_table(media: DataFrame) -> DataFrame:
    """The rows of media with media_bytes, media_sha256, blocks and error in place of the stream.

    A block holds its first sample's offset, the number of its samples and
    these as signed bytes, so that any sample is found by its offset alone.
    Null media have null sizes and no blocks; of a stream that fails a check
    the error says which, and it has no blocks.
    """
    others = [c for c in media.columns if c != "media"]
    kinds = dict(media.dtypes)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(frames):
            streams = part.column(len(others)).to_pylist()
            got = decode_each(streams)
            spans = [(a, n) for _, blocks, _ in got for a, n in blocks]
            first, count = (np.array(c, np.int64) for c in (zip(*spans, strict=True) if spans else ([], [])))
            samples = np.concatenate([x for x, _, _ in got]).astype(np.int8)
            pcm = pa.Array.from_buffers(pa.binary(), len(spans), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.py_buffer(samples)])
            rows = pa.StructArray.from_arrays([pa.array(first), pa.array(count.astype(np.int32)), pcm], fields=list(BLOCKS.value_type))
            ends = np.cumsum([0, *[len(blocks) for _, blocks, _ in got]]).astype(np.int32)
            sizes = [None if m is None else len(m) for m in streams]
            digests = [None if m is None else hashlib.sha256(m).hexdigest() for m in streams]
            columns = [*(part.column(i) for i in range(len(others))), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends), rows), pa.array([e for _, _, e in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "media_bytes", "media_sha256", "blocks", "error"])

    schema = [f"`{c}` {kinds[c]}" for c in others] + ["media_bytes long", "media_sha256 string", "blocks array<struct<first_sample: long, n_samples: int, pcm: binary>>", "error string"]
    return media.select(*others, F.col("media").cast("binary")).mapInArrow(run, ", ".join(schema))


def write_pcm(media: DataFrame, path: str) -> DataFrame:
    """Write the blocks of all media as Parquet and read them back."""
    table = pcm_table(media)
    table.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(table.schema).parquet(path)


def samples_at(pcm: DataFrame, start: Column, length: Column) -> Column:
    """The samples from ``start`` on, as signed bytes, out of the blocks that hold them."""
    end = start + length
    some = F.filter("blocks", lambda b: (b.first_sample < end) & (b.first_sample + b.n_samples > start))
    cut = F.transform(some, lambda b: F.substring(b.pcm, (F.greatest(start - b.first_sample, F.lit(0)) + 1).cast("int"), (F.least(end - b.first_sample, b.n_samples.cast("long")) - F.greatest(start - b.first_sample, F.lit(0))).cast("int")))
    return F.aggregate(cut, F.lit(b""), lambda a, x: F.concat(a, x))


def pcm_features(pcm: DataFrame) -> DataFrame:
    """doc_id, n_bytes, sizes and digests of payload and stream, frames and features of the sound, read from the blocks."""
    kind = dict(pcm.dtypes)["doc_id"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(frames, 1024):
            told = []
            blocks = part.column(2)
            ends = blocks.offsets.to_numpy()
            pcm_bytes = blocks.values.field("pcm")
            for i in range(part.num_rows):
                run_ = pcm_bytes.slice(ends[i], ends[i + 1] - ends[i])
                raw = b"".join(run_.to_pylist())
                x = np.frombuffer(raw, np.int8)
                text, wide = (x.view(np.uint8) ^ 0x80).tobytes(), x.astype(np.int32)
                energy, crossings = int((wide * wide).sum(dtype=np.int64)), int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
                feature = f"energy={energy // max(len(x), 1)};crossings={crossings};low={x.min(initial=0)};high={x.max(initial=0)};frames={len(run_)}"
                told.append((len(text), hashlib.sha256(text).hexdigest(), zlib.crc32(text[-16:]), len(run_), feature))
            size, digest, tail, count, feature = zip(*told, strict=True)
            columns = [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(digest), pa.array(tail, pa.int64()), part.column(3), part.column(4), pa.array(count, pa.int64()), pa.array(feature), part.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "feature", "error"])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, feature string, error string"
    return pcm.select("doc_id", "n_bytes", "blocks", "media_bytes", "media_sha256", "error").mapInArrow(run, schema)


def media_features(media: DataFrame, path: str) -> DataFrame:
    """Decode the media, write their PCM blocks below ``path`` and describe what is read back."""
    return pcm_features(write_pcm(media, path))
