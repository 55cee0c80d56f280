"""FLAC media columns: encode, decode with checks, and PCM blocks with seekable sample offsets.

The decoder reads Rice residuals (both parameter widths, all partition orders, escaped partitions), fixed
and linear predictors, constant and verbatim subframes, wasted bits and all channel layouts, and verifies
each frame's CRC-8 and CRC-16 and the stream's MD5. Python works on arrays: the frames of a batch are
decoded side by side, sample by sample, so cost is per byte and not per row.

Frames are found by their sync code, header checksum and running number. Should that mistake audio for a
header (the CRC-16 tells), the stream is decoded frame after frame instead.

As the source has texts, `encode` stores UTF-8 bytes, padded with 0 to a positive multiple of 64, as
8-bit samples (byte - 128), and the unpadded length in an application block. A frame takes
the fixed predictor of order 0 to 2 with the smallest residuals, a linear one with weights of its own where
that is shorter, or plain bytes where these are.

Edge cases: null and empty texts become 64 samples of byte 0; long texts have many frames, which are coded and
decoded in runs of about `CHUNK` samples, so that a text takes about ten times its size beside a fixed amount; repeated rows give equal media; a null doc_id stays null;
an empty table gives an empty result; further columns of the input are ignored; a null media value gives
no row; a stream without samples gives no blocks; damaged media raise FlacError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .packing import chunks

BLOCK = 256
RATE = 8000
#: Bytes that are coded side by side; what that takes is about 150 times as much.
CHUNK = 1 << 20
#: Samples in a block of decoded PCM.
PCM_BLOCK = 4096
APPLICATION = b"tdmk"


class FlacError(ValueError):
    pass


def _crc_table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        t = np.where(t >> (width - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t.astype(np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, wide: bool) -> np.ndarray:
    """The checksums of buf[begin:end] for many ranges at once."""
    order = np.argsort(begin - end, kind="stable")
    at, n = begin[order], (end - begin)[order]
    out = np.zeros(len(order), np.uint16)
    active = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), "right")
    for j, m in enumerate(active.tolist()):
        b = buf[at[:m] + j]
        out[:m] = (out[:m] << 8) ^ CRC16[(out[:m] >> 8) ^ b] if wide else CRC8[out[:m] ^ b]
    back = np.empty_like(out)
    back[order] = out
    return back


# ---------------------------------------------------------------- encoding


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... for lengths[0] places, then the same of the next."""
    upto = np.cumsum(lengths)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begins - (upto - lengths), lengths)


#: Samples that a linear predictor of the encoder looks back on; bits of a weight, and by how many of them it is scaled.
ORDER, PRECISION, SHIFT = 4, 8, 6


def _weights(x: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Weights [frame, ORDER] of the predictors that fit the frames' autocorrelation (Levinson-Durbin), as integers.

    Sums are exact and the rest goes element by element, so a frame's weights don't depend on those beside it.
    """
    wide = x.astype(np.int32)
    r = [np.add.reduceat((wide * wide).astype(np.int64), begin).astype(np.float64)]
    for lag in range(1, ORDER + 1):
        before = np.concatenate([np.zeros(lag, np.int32), wide[:-lag]])
        r.append(np.add.reduceat(np.where(place >= lag, wide * before, 0).astype(np.int64), begin).astype(np.float64))
    w, error = np.zeros((len(begin), ORDER)), r[0]
    for i in range(ORDER):
        rest = r[i + 1]
        for j in range(i):
            rest = rest - w[:, j] * r[i - j]
        step = np.where(error > 0, rest / np.where(error > 0, error, 1), 0)
        last = w.copy()
        for j in range(i):
            w[:, j] = last[:, j] - step * last[:, i - 1 - j]
        w[:, i] = step
        error = error * (1 - step * step)
    top = 1 << PRECISION - 1
    return np.clip(np.rint(w * (1 << SHIFT)), -top, top - 1).astype(np.int32)


def _code(pieces: list[bytes], first: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """The frames of each piece, numbered from its first, and their sizes."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    x = raw.astype(np.int16) - 128
    n_frames = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(pieces)), n_frames)
    local = _spread(np.zeros(len(pieces), np.int64), n_frames)
    number = local + np.array(first, np.int64)[stream]
    begin = np.repeat(np.cumsum(sizes) - sizes, n_frames) + local * BLOCK
    length = np.minimum(BLOCK, sizes[stream] - local * BLOCK)
    frames = len(begin)

    # Residuals of the fixed predictors 0 to 2; a frame takes the one with the smallest sum. Warm-up samples
    # don't count: their differences reach into the frame before, which may be another text's.
    d1 = np.diff(x, prepend=x[:1])
    d2 = np.diff(d1, prepend=d1[:1])
    residuals = [x, d1, d2]
    sums = [np.add.reduceat(np.abs(r).astype(np.int64), begin) for r in residuals]
    order = np.argmin(np.stack([s - sum(np.abs(r[begin + j]) for j in range(o)) for o, (s, r) in enumerate(zip(sums, residuals))]), axis=0)
    e = np.where(np.repeat(order, length) == 0, x, np.where(np.repeat(order, length) == 1, d1, d2)).astype(np.int32)
    place = _spread(np.zeros(frames, np.int64), length)

    def rice(e, order, extra):
        """Of residuals: their unsigned form, which of them are coded, the Rice parameter for their mean, the bits of samples and those of a subframe."""
        u = np.where(e < 0, -2 * e - 1, 2 * e)
        mine = place >= np.repeat(order, length)
        total = np.add.reduceat(np.where(mine, u, 0).astype(np.int64), begin)
        k = np.clip(np.floor(np.log2(np.maximum(total / (length - order) * 0.7, 1))).astype(np.int64), 0, 14)
        ks = np.repeat(k, length)
        bits = np.where(mine, (u >> ks) + 1 + ks, 8)
        return u, mine, k, ks, bits, 8 + 2 + 4 + 4 + extra + np.add.reduceat(bits, begin)

    # A predictor with weights of its own where that is shorter, weights included.
    coded = rice(e, order, 0)
    weights = _weights(x, place, begin)
    guess = sum(np.repeat(weights[:, j], length) * np.concatenate([np.zeros(j + 1, np.int32), x[: -j - 1]]) for j in range(ORDER))
    own = rice(x - (guess >> SHIFT), np.full(frames, ORDER), 9 + PRECISION * ORDER)
    linear = own[-1] < coded[-1]
    of_linear = np.repeat(linear, length)
    u, mine, k, ks, bits, body = (np.where(linear if len(a) == frames else of_linear, b, a) for a, b in zip(coded, own))
    order = np.where(linear, ORDER, order)
    extra = np.where(linear, 9 + PRECISION * ORDER, 0)
    del coded, own, guess
    # Whether verbatim bytes are shorter.
    verbatim = body >= 8 + 8 * length
    body = np.where(verbatim, 8 + 8 * length, body)
    body_bytes = -(-body // 8)

    bit_begin = np.concatenate([[0], np.cumsum(body_bytes * 8)])
    out = np.zeros(int(bit_begin[-1]), np.uint8)
    bit_begin = bit_begin[:-1]

    def put(at, value, width):
        for b in range(width):
            out[at + b] = (value >> (width - 1 - b)) & 1

    put(bit_begin, np.where(verbatim, 0b00000010, np.where(linear, (0b100000 | ORDER - 1) << 1, 0b00010000 | order << 1)), 8)
    told = np.flatnonzero(~verbatim)
    # Warm-up samples, and weights if there are any, come before the residual's header.
    for o in range(ORDER):
        has = told[order[told] > o]
        put(bit_begin[has] + 8 + 8 * o, x[begin[has] + o] & 0xFF, 8)
    has = told[linear[told]]
    put(bit_begin[has] + 8 + 8 * ORDER, PRECISION - 1, 4)
    put(bit_begin[has] + 12 + 8 * ORDER, SHIFT, 5)
    for j in range(ORDER):
        put(bit_begin[has] + 17 + 8 * ORDER + PRECISION * j, weights[has, j], PRECISION)
    put(bit_begin[told] + 8 + (8 * order + extra)[told] + 6, k[told], 4)
    # Where each sample's code ends.
    code = np.where(mine, bits, 0)
    cum = np.cumsum(code)
    ends = cum - np.repeat(cum[begin] - code[begin], length) + np.repeat(bit_begin + 18 + 8 * order + extra, length)
    coded = mine & ~np.repeat(verbatim, length)
    ends, uu, kk = ends[coded], u[coded], ks[coded]
    out[ends - kk - 1] = 1
    for b in range(int(kk.max()) if len(kk) else 0):
        if (has := kk > b).all():
            out[ends - 1 - b] = (uu >> b) & 1
        else:
            out[ends[has] - 1 - b] = (uu[has] >> b) & 1
    plain = np.flatnonzero(np.repeat(verbatim, length))
    if len(plain):
        at = (np.repeat(bit_begin, length) + 8 + 8 * place)[plain]
        put(at, x[plain] & 0xFF, 8)
    packed = np.packbits(out)

    # Frame headers: sync, block size, rate, mono, 8 bits, the number in UTF-8's manner, perhaps the size.
    full = length == BLOCK
    heads = np.zeros((frames, 12), np.uint8)
    heads[:, 0], heads[:, 1] = 0xFF, 0xF8
    heads[:, 2] = np.where(full, 0x80, 0x60)
    heads[:, 3] = 0x02
    at = np.full(frames, 4)
    more = np.where(number < 0x80, 0, np.where(number < 0x800, 1, np.where(number < 0x10000, 2, np.where(number < 0x200000, 3, 4))))
    for extra in range(5):
        rows = np.flatnonzero(more == extra)
        if len(rows):
            lead = 0 if extra == 0 else (0xFF00 >> (extra + 1)) & 0xFF
            heads[rows, 4] = lead | number[rows] >> (6 * extra)
            for j in range(extra):
                heads[rows, 5 + j] = 0x80 | (number[rows] >> (6 * (extra - 1 - j)) & 0x3F)
    at += more + 1
    rows = np.flatnonzero(~full)
    heads[rows, at[rows]] = length[rows] - 1
    at[rows] += 1
    flat = heads.reshape(-1)
    base = np.arange(frames) * 12
    heads[np.arange(frames), at] = crc(flat, base, base + at, False)
    at += 1

    frame_bytes = at + body_bytes + 2
    to = np.cumsum(frame_bytes) - frame_bytes
    final = np.zeros(int(frame_bytes.sum()), np.uint8)
    final[_spread(to, at)] = flat[_spread(base, at)]
    final[_spread(to + at, body_bytes)] = packed
    check = crc(final, to, to + frame_bytes - 2, True)
    final[to + frame_bytes - 2], final[to + frame_bytes - 1] = check >> 8, check & 0xFF
    blob = final.tobytes()

    bounds = np.concatenate([[0], np.cumsum(n_frames)]).tolist()
    at_frame = np.append(to, len(blob)).tolist()
    return [(blob[at_frame[i] : at_frame[j]], frame_bytes[i:j]) for i, j in zip(bounds, bounds[1:])]


def encode_batch(texts: list[bytes]) -> list[bytes]:
    """A FLAC stream for each text's padded bytes. At most CHUNK bytes are coded side by side; a long text takes several runs."""
    padded = [t + bytes(-len(t) % 64 or (0 if t else 64)) for t in texts]
    coded: list[list] = [[] for _ in texts]
    run, held = [], 0

    def code():
        for (i, _, _), frames in zip(run, _code([p for _, _, p in run], [first for _, first, _ in run])):
            coded[i].append(frames)

    for i, p in enumerate(padded):
        for o in range(0, len(p), CHUNK):
            piece = p[o : o + CHUNK]
            if run and held + len(piece) > CHUNK:
                code()
                run, held = [], 0
            run.append((i, o // BLOCK, piece))
            held += len(piece)
    if run:
        code()
    return [_stream(t, p, [blob for blob, _ in c], np.concatenate([sizes for _, sizes in c])) for t, p, c in zip(texts, padded, coded)]


def _stream(text: bytes, padded: bytes, blobs: list[bytes], sizes: np.ndarray) -> bytes:
    """The stream of a text, whose frames are there."""
    md5 = hashlib.md5()
    for o in range(0, len(padded), CHUNK):
        md5.update((np.frombuffer(padded[o : o + CHUNK], np.uint8) ^ 0x80).tobytes())
    at = np.cumsum(sizes) - sizes
    points = range(0, len(sizes), max(16, -(-len(sizes) // 900_000)))
    seek = b"".join(struct.pack(">QQH", p * BLOCK, int(at[p]), min(BLOCK, len(padded) - p * BLOCK)) for p in points)
    packed_info = RATE << 44 | 0 << 41 | 7 << 36 | len(padded)
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big") + packed_info.to_bytes(8, "big") + md5.digest()
    app = APPLICATION + len(text).to_bytes(8, "big")
    return b"".join(
        [
            b"fLaC",
            b"\x00" + len(info).to_bytes(3, "big") + info,
            b"\x02" + len(app).to_bytes(3, "big") + app,
            b"\x83" + len(seek).to_bytes(3, "big") + seek,
            *blobs,
        ]
    )


# ---------------------------------------------------------------- decoding


class _Info:
    """What a stream's metadata say."""

    def __init__(self, media: bytes):
        if media[:4] != b"fLaC":
            raise FlacError("no FLAC stream")
        at, last, self.length, self.seek, info = 4, False, None, [], None
        while not last:
            if at + 4 > len(media):
                raise FlacError("metadata are cut off")
            last, kind, n = media[at] >> 7, media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
            body = media[at + 4 : at + 4 + n]
            if kind == 0:
                info = body
            elif kind == 2 and body[:4] == APPLICATION:
                self.length = int.from_bytes(body[4:], "big")
            elif kind == 3:
                self.seek = [p for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
            at += 4 + n
        if info is None or len(info) != 34:
            raise FlacError("no stream information")
        self.frames_at = at
        self.block, self.longest = int.from_bytes(info[2:4], "big"), int.from_bytes(info[7:10], "big")
        x = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.bits, self.samples = x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1
        self.md5 = info[18:34]


_FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
_ZEROS = np.array([16, *[15 - (i.bit_length() - 1) for i in range(1, 1 << 16)]], np.uint8)
_SIZES = {0: 0, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


class _Frames:
    """Frames that begin at the given bytes of buf, decoded side by side."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, bits: np.ndarray):
        """buf ends in at least 16 bytes of padding. bits: of a sample, by stream."""
        self.buf, self.starts, self.stream_bits = buf, starts, bits
        self._words = None

    def headers(self) -> np.ndarray:
        """Reads the headers; tells which are right."""
        b, s = self.buf, self.starts
        size, rate, self.layout, bits = b[s + 2] >> 4, b[s + 2] & 15, b[s + 3] >> 4, b[s + 3] >> 1 & 7
        lead = b[s + 4]
        extra = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead < 0xFF], [0, -1, 1, 2, 3, 4, 5, 6], -1)
        right = (extra >= 0) & (size > 0) & (rate < 15) & (self.layout < 11) & (bits != 3) & (b[s + 3] & 1 == 0)
        extra = np.maximum(extra, 0)
        number = (lead & np.where(extra == 0, 0x7F, 0x3F >> extra)).astype(np.int64)
        for j in range(int(extra.max()) if len(extra) else 0):
            number = np.where(j < extra, number << 6 | (b[s + 5 + j] & 0x3F), number)
        at = s + 5 + extra
        n = np.select([size == 1, size < 6, size > 7], [192, 576 << np.maximum(size.astype(np.int64) - 2, 0), 256 << np.maximum(size.astype(np.int64) - 8, 0)], 0)
        n = np.where(size == 6, b[at].astype(np.int64) + 1, np.where(size == 7, (b[at].astype(np.int64) << 8 | b[at + 1]) + 1, n))
        at = at + np.where(size == 6, 1, np.where(size == 7, 2, 0)) + np.where(rate == 12, 1, np.where(rate > 12, 2, 0))
        right &= crc(b, s, at, False) == b[at]
        self.number, self.n, self.at = number, n.astype(np.int64), at + 1
        self.bits = np.where(bits == 0, self.stream_bits, np.array([_SIZES.get(i, 0) for i in range(8)])[bits])
        self.channels = np.where(self.layout < 8, self.layout.astype(np.int64) + 1, 2)
        return right

    def _peek(self, pos, width):
        """width (up to 32) bits at pos, by frame."""
        w = self._words[pos >> 3] << (pos & 7).astype(np.uint64)
        return ((w >> np.uint64(1)) >> (63 - width).astype(np.uint64)).astype(np.int64) if isinstance(width, np.ndarray) else ((w >> np.uint64(1)) >> np.uint64(63 - width)).astype(np.int64)

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """Samples by channel, frame and place, and the byte after each frame's last bit. headers() comes first."""
        b = self.buf.astype(np.uint64)
        w32 = b[:-3] << np.uint64(24) | b[1:-2] << np.uint64(16) | b[2:-1] << np.uint64(8) | b[3:]
        self._words = w32[:-4] << np.uint64(32) | w32[4:]
        top = int(self.channels.max())
        out = np.zeros((top, len(self.starts), int(self.n.max())), np.int64)
        pos = self.at * 8
        for c in range(top):
            has = np.flatnonzero(self.channels > c)
            side = ((self.layout == 8) & (c == 1)) | ((self.layout == 9) & (c == 0)) | ((self.layout == 10) & (c == 1))
            samples, pos[has] = self._subframes(pos[has], self.n[has], (self.bits + side)[has])
            out[c, has, : samples.shape[1]] = samples
        if top > 1:
            a, d = out[0].copy(), out[1].copy()
            for kind, left, right in ((8, a, a - d), (9, a + d, d), (10, (2 * a + (d & 1) + d) >> 1, (2 * a + (d & 1) - d) >> 1)):
                rows = np.flatnonzero(self.layout == kind)
                out[0, rows], out[1, rows] = left[rows], right[rows]
        return out, -(-pos // 8)

    def _signed(self, pos, width):
        v = self._peek(pos, width)
        return np.where(width > 0, v - ((v >> np.maximum(width - 1, 0) & 1) << width), 0)

    def _subframes(self, pos, n, bits):
        head = self._peek(pos, 8)
        if (head >> 7).any():
            raise FlacError("a subframe's header is wrong")
        kind, pos = head >> 1 & 0x3F, pos + 8
        wasted = np.zeros_like(pos)
        rows = np.flatnonzero(head & 1)
        open_rows = rows
        while len(open_rows):  # unary
            wasted[open_rows] += 1
            one = self._peek(pos[open_rows], 1) == 1
            pos[open_rows] += 1
            open_rows = open_rows[~one]
        bits = bits - wasted
        order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
        known = (kind < 2) | ((kind >= 8) & (kind <= 12)) | (kind >= 32)
        if not known.all():
            raise FlacError("a subframe's type is reserved")
        out = np.zeros((len(pos), int(n.max())), np.int64)
        rows = np.flatnonzero(kind == 0)
        if len(rows):
            out[rows] = self._signed(pos[rows], bits[rows])[:, None]
            pos[rows] += bits[rows]
        rows = np.flatnonzero(kind == 1)
        for j in range(int(n[rows].max()) if len(rows) else 0):
            now = rows[n[rows] > j]
            out[now, j] = self._signed(pos[now], bits[now])
            pos[now] += bits[now]
        for j in range(int(order.max())):
            now = np.flatnonzero(order > j)
            out[now, j] = self._signed(pos[now], bits[now])
            pos[now] += bits[now]
        linear = np.flatnonzero(kind >= 32)
        weights, shift = np.zeros((len(pos), max(4, int(order.max()))), np.int64), np.zeros_like(pos)
        if len(linear):
            precision = self._peek(pos[linear], 4) + 1
            shift[linear] = self._signed(pos[linear] + 4, np.full(len(linear), 5))
            pos[linear] += 9
            if (precision == 16).any() or (shift < 0).any():
                raise FlacError("a predictor's precision is invalid")
            for j in range(int(order[linear].max())):
                now = order[linear] > j
                weights[linear[now], j] = self._signed(pos[linear[now]], precision[now])
                pos[linear[now]] += precision[now]
        for o in range(1, 5):
            weights[kind == 8 + o, :o] = _FIXED[o]
        rows = np.flatnonzero(kind >= 8)
        if len(rows):
            residual, pos[rows] = self._residuals(pos[rows], n[rows], order[rows])
            out[rows, : residual.shape[1]] += residual
        for o in range(1, int(order.max()) + 1):
            rows = np.flatnonzero(order == o)
            if len(rows):
                part, w, s = out[rows].T.copy(), weights[rows, :o].T, shift[rows]
                for i in range(o, part.shape[0]):
                    p = w[0] * part[i - 1]
                    for j in range(1, o):
                        p += w[j] * part[i - 1 - j]
                    part[i] += p >> s
                out[rows] = part.T
        inside = np.arange(out.shape[1]) < n[:, None]
        return np.where(inside, out << wasted[:, None], 0) if wasted.any() or not inside.all() else out, pos

    def _residuals(self, pos, n, order):
        method, parts = self._peek(pos, 2), self._peek(pos + 2, 4)
        if (method > 1).any():
            raise FlacError("a residual's coding is reserved")
        pos = pos + 6
        width = 4 + method
        per = n >> parts
        if ((per << parts) != n).any() or (per < order).any():
            raise FlacError("a residual's partitions don't fit")
        count = n - order
        by = np.argsort(-count, kind="stable")
        pos, width, per, order, count = pos[by], width[by], per[by], order[by], count[by]
        out = np.zeros((int(count[0]) if len(count) else 0, len(by)), np.int64)
        k, raw = np.zeros_like(pos), np.full(len(pos), -1)
        begins = {0: np.flatnonzero(count > 0)}
        split = np.flatnonzero(parts[by] > 0)
        if len(split):
            pairs = [(int(r), i) for i in split for r in range(int(per[i] - order[i]), int(count[i]), int(per[i]))]
            # A first partition that is all warm-up still has its parameter.
            for r, i in pairs:
                if r == 0:
                    pos[i] = pos[i] + width[i] + (5 if self._peek(pos[i : i + 1], width[i : i + 1])[0] == (1 << width[i]) - 1 else 0)
            for r in {r for r, _ in pairs if r}:
                begins[r] = np.array([i for q, i in pairs if q == r])
        active = np.searchsorted(-count, -np.arange(1, out.shape[0] + 1), "right").tolist()
        shift_k = np.zeros(len(pos), np.uint64)
        escapes = False
        one = np.uint64(1)
        for r, m in enumerate(active):
            if r in begins:
                i = begins[r]
                k[i] = self._peek(pos[i], width[i])
                pos[i] += width[i]
                raw[i] = -1
                esc = i[k[i] == (1 << width[i]) - 1]
                if len(esc):
                    raw[esc] = self._peek(pos[esc], 5)
                    pos[esc] += 5
                    k[esc] = 0
                escapes = bool((raw >= 0).any())
                shift_k = (63 - k).astype(np.uint64)
            p = pos[:m]
            w = self._words[p >> 3] << (p & 7).astype(np.uint64)
            q = _ZEROS[w >> np.uint64(48)].astype(np.int64)
            kk = k[:m]
            low = (((w << (q + 1).astype(np.uint64)) >> one) >> shift_k[:m]).astype(np.int64)
            for i in np.flatnonzero(q == 16).tolist():
                if raw[i] < 0:
                    q[i] = self._unary(int(p[i]))
                    low[i] = self._peek(p[i : i + 1] + q[i] + 1, kk[i : i + 1])[0]
            v = (q << kk) | low
            if escapes and (e := np.flatnonzero(raw[:m] >= 0)).size:
                v = (v >> 1) ^ -(v & 1)
                v[e] = self._signed(p[e], raw[e])
                out[r, :m] = v
                step = q + 1 + kk
                step[e] = raw[e]
                pos[:m] = p + step
            else:
                out[r, :m] = (v >> 1) ^ -(v & 1)
                pos[:m] = p + (q + 1 + kk)
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        res = out.T[back]
        order, whole = order[back], np.zeros((len(by), int(n.max())), np.int64)
        for o in np.unique(order):
            rows = np.flatnonzero(order == o)
            span = min(res.shape[1], whole.shape[1] - int(o))
            whole[rows, o : o + span] = res[rows, :span]
        return whole, pos[back]

    def _unary(self, pos: int) -> int:
        """Zeros from pos to the next one."""
        at = pos
        while at < 8 * len(self._words):
            if word := int(self._words[at >> 3]) << (at & 7) & ((1 << 57) - 1 << 7):
                return at - pos + 64 - word.bit_length()
            at += 57
        raise FlacError("a residual runs over the end")


def decode_batch(media: list[bytes]) -> list[tuple[_Info, np.ndarray]]:
    """Each stream's information and samples [channel, sample]; raises FlacError if a checksum fails."""
    infos = [_Info(m) for m in media]
    bodies = [m[i.frames_at :] for m, i in zip(media, infos)]
    sizes = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(bodies) + bytes(32), np.uint8)
    found = np.flatnonzero((buf[:-33] == 0xFF) & ((buf[1:-32] & 0xFE) == 0xF8)) if len(buf) > 33 else np.zeros(0, np.int64)
    stream = np.searchsorted(ends, found, "right")
    frames = _Frames(buf, found, np.array([i.bits for i in infos])[stream] if len(found) else np.zeros(0, np.int64))
    right = frames.headers()
    out: list = [None] * len(media)
    # Of each stream, the candidates that are numbered on from 0; others mistake audio for a header.
    keep = np.flatnonzero(right & (buf[found + 1] & 1 == 0))
    keep = keep[_counted(frames.number[keep], stream[keep], len(media))]
    per = np.bincount(stream[keep], minlength=len(media))
    expected = np.array([-(-i.samples // max(1, i.block)) for i in infos])
    sane = (per == expected) & (per > 0)
    rows = keep[sane[stream[keep]]]
    if len(rows):
        s = stream[rows]
        begin = found[rows]
        end = np.where(np.append(s[1:] != s[:-1], True), ends[s], np.append(begin[1:], 0))
        sums = crc(buf, begin, end - 2, True) == (buf[end - 2].astype(np.uint16) << 8 | buf[end - 1])
        bad = np.unique(s[~sums | (begin != np.where(np.append(True, s[1:] != s[:-1]), ends[s] - sizes[s], begin))])
        good = ~np.isin(s, bad)
        rows, s, begin, end = rows[good], s[good], begin[good], end[good]
        parts: list[list] = [[] for _ in media]
        # Runs of frames of about CHUNK samples, so that a long stream takes no more memory at a time.
        run = np.cumsum(frames.n[rows]) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            lo = int(begin[a])
            f = _Frames(buf[lo : int(end[b - 1]) + 32], begin[a:b] - lo, frames.stream_bits[rows[a:b]])
            f.headers()
            samples, after = f.decode()
            if (lo + after + 2 != end[a:b]).any():
                raise FlacError("a frame's length is wrong")
            first = int(s[a])
            bounds = np.searchsorted(s[a:b], np.arange(first, int(s[b - 1]) + 2))
            for i, (c, d) in enumerate(zip(bounds, bounds[1:]), first):
                if c < d:
                    parts[i].append(_joined(samples[:, c:d], f.n[c:d], infos[i]))
        for i, p in enumerate(parts):
            if p:
                out[i] = np.concatenate(p, axis=1)
    for i, x in enumerate(out):
        if x is None:
            out[i] = _one_by_one(bodies[i], infos[i])
    for info, x in zip(infos, out):
        if info.samples and x.shape[1] != info.samples:
            raise FlacError("samples are missing")
        if info.md5 != bytes(16):
            md5 = hashlib.md5()
            for o in range(0, x.shape[1], CHUNK):
                md5.update(_bytes(x[:, o : o + CHUNK], info.bits))
            if md5.digest() != info.md5:
                raise FlacError("the stream's MD5 is wrong")
    return list(zip(infos, out))


def _counted(number: np.ndarray, stream: np.ndarray, n_streams: int) -> np.ndarray:
    """Which frame numbers count on from 0 in their stream."""
    bounds = np.searchsorted(stream, np.arange(n_streams + 1))
    fits = number == np.arange(len(number)) - bounds[stream]
    for i in np.unique(stream[~fits]).tolist():
        a, b = bounds[i], bounds[i + 1]
        due = 0
        for j, x in enumerate(number[a:b].tolist(), a):
            fits[j] = x == due
            due += x == due
    return fits


def _joined(samples, n, info):
    """The samples of frames that follow each other, in no more bytes than they need."""
    part = samples[: info.channels].astype(np.int16 if info.bits <= 16 else np.int32)
    if (n == samples.shape[2]).all():
        return part.reshape(info.channels, -1)
    inside = np.arange(samples.shape[2]) < n[:, None]
    return np.stack([c[inside] for c in part])


def _bytes(x: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples of whole bytes."""
    width = -(-bits // 8)
    flat = x.T.reshape(-1)
    if width == 1:
        return flat.astype(np.int8).tobytes()
    return flat.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _one_by_one(body: bytes, info: _Info) -> np.ndarray:
    buf, at, parts = np.frombuffer(body + bytes(32), np.uint8), 0, []
    while at < len(body):
        f = _Frames(buf[at : at + info.longest + 32] if info.longest else buf[at:], np.array([0]), np.array([info.bits]))
        if buf[at] != 0xFF or buf[at + 1] & 0xFE != 0xF8 or not f.headers().all():
            raise FlacError("a frame's header is wrong")
        try:
            samples, after = f.decode()
        except IndexError:
            raise FlacError("a frame runs over its end") from None
        end = at + int(after[0])
        if crc(buf, np.array([at]), np.array([end]), True)[0] != int(buf[end]) << 8 | int(buf[end + 1]):
            raise FlacError("a frame's CRC-16 is wrong")
        parts.append(_joined(samples, f.n, info))
        at = end + 2
    return np.concatenate(parts, axis=1) if parts else np.zeros((info.channels, 0), np.int16)


# ---------------------------------------------------------------- on DataFrames


def encode(docs: DataFrame) -> DataFrame:
    """doc_id and media, a FLAC stream of the text's bytes."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, most=CHUNK):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode_batch(texts), pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def _decoded(batches):
    for batch in batches:
        for part in chunks(batch, "media", CHUNK):
            media, ids = part.column("media").to_pylist(), part.column("doc_id").to_pylist()
            there = [i for i, m in enumerate(media) if m is not None]
            for i, (info, x) in zip(there, decode_batch([media[i] for i in there])):
                yield ids[i], media[i], info, x


def _pcm(info: _Info, x: np.ndarray, block: int):
    """sample_offset, number of samples and interleaved little-endian bytes of each block."""
    for o in range(0, x.shape[1], block):
        part = x[:, o : o + block]
        yield o, part.shape[1], _bytes(part, info.bits)


def decode(media: DataFrame, block: int = PCM_BLOCK) -> DataFrame:
    """PCM blocks: doc_id, block, sample_offset, n_samples, n_channels, pcm (interleaved, little-endian). A sample s is in block s // block."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("n_channels", pa.int32()), ("pcm", pa.binary())])

    def run(batches):
        for doc, _, info, x in _decoded(batches):
            if not x.shape[1]:
                continue
            offsets, sizes, raw = (list(c) for c in zip(*_pcm(info, x, block)))
            cols = [[doc] * len(offsets), [o // block for o in offsets], offsets, sizes, [info.channels] * len(offsets), raw]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, block long, sample_offset long, n_samples int, n_channels int, pcm binary")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Writes blocks as Parquet, sorted so that a range of samples touches few row groups."""
    blocks.sortWithinPartitions("doc_id", "sample_offset").write.parquet(path)


def read_samples(blocks: DataFrame, doc_id: int, start: int, n: int) -> DataFrame:
    """The blocks that hold samples start to start + n; the filter reaches the Parquet scan."""
    return blocks.filter((F.col("doc_id") == doc_id) & (F.col("sample_offset") < start + n) & (F.col("sample_offset") + F.col("n_samples") > start))


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest(media: DataFrame) -> DataFrame:
    """Reads media back as PCM blocks, one after another: lengths and checksums of payload and media, and features of the samples (energy, mean, sign changes)."""

    def run(batches):
        rows = []
        for doc, stored, info, x in _decoded(batches):
            hashed, n, tail, energy = hashlib.sha256(), 0, b"", 0
            for offset, size, pcm in _pcm(info, x, PCM_BLOCK):
                if offset != n:
                    raise FlacError("samples are missing")
                part = (np.frombuffer(pcm, np.uint8) ^ 0x80).tobytes()
                hashed.update(part)
                samples = x[0, n : n + size].astype(np.int64)
                energy += int((samples * samples).sum())
                n, tail = n + size, (tail + part)[-64:]
            s = x[0]
            peak = max(int(s.max(initial=0)), -int(s.min(initial=0)))
            feature = f"energy={energy};sum={int(s.sum(dtype=np.int64))};crossings={int(((s[1:] ^ s[:-1]) < 0).sum())};peak={peak};seekpoints={len(info.seek)}"
            rows.append((doc, info.length, n, hashed.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGEST)], schema=DIGEST)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGEST)], schema=DIGEST)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(encode(table(spark, sf_dir, "documents")))
