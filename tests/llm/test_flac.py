import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from llm.conftest import clashing
from tidemark.llm import flac, queries


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in range(width - 1, -1, -1)]
        return self

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (width - 1) else 0)) & (1 << width) - 1
    return c


def frame(number, subframes, n, layout, bits):
    head = Bits().put(0xFFF8, 16).put(7, 4).put(0, 4).put(layout, 4).put({8: 1, 16: 4}[bits], 3).put(0, 1).put(number, 8).put(n - 1, 16).bytes()
    head += bytes([crc(head, 7, 8)])
    body = Bits()
    for s in subframes:
        s(body)
    raw = head + body.bytes()
    return raw + struct.pack(">H", crc(raw, 0x8005, 16))


def lpc(samples, bits, coefs, shift, k, parts=0, escape=False, wide=False, fixed=None, wasted=0):
    """A scalar writer of one subframe, to check the decoder against."""

    def write(b):
        x = [s >> wasted for s in samples]
        order = len(coefs)
        b.put(0, 1).put((8 + order) if fixed else 32 + order - 1, 6).put(1 if wasted else 0, 1)
        if wasted:
            b.put(1, wasted)
        depth = bits - wasted
        for s in x[:order]:
            b.put(s & (1 << depth) - 1, depth)
        if not fixed:
            b.put(11, 4).put(shift, 5)
            for c in coefs:
                b.put(c & 0xFFF, 12)
        res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, len(x))]
        b.put(int(wide), 2).put(parts, 4)
        width, per = 5 if wide else 4, len(x) >> parts
        for p in range(1 << parts):
            own = res[max(0, p * per - order) : (p + 1) * per - order]
            if escape and p % 2:
                b.put((1 << width) - 1, width).put(14, 5)
                for r in own:
                    b.put(r & (1 << 14) - 1, 14)
            else:
                b.put(k, width)
                for r in own:
                    u = 2 * r if r >= 0 else -2 * r - 1
                    b.put(1, (u >> k) + 1).put(u & (1 << k) - 1, k)

    return write


def constant(value, bits):
    return lambda b: b.put(0, 8).put(value & (1 << bits) - 1, bits)


def verbatim(samples, bits):
    def write(b):
        b.put(2, 8)
        for s in samples:
            b.put(s & (1 << bits) - 1, bits)

    return write


def stream(frames, n, channels, bits, block, md5):
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + md5
    return b"fLaC\x80" + len(info).to_bytes(3, "big") + info + b"".join(frames)


def test_all_kinds_of_subframes():
    r = random.Random(3)
    x = [int(900 * np.sin(i / 9) + r.randint(-30, 30)) for i in range(64)]
    y = [v + r.randint(-3, 3) for v in x]
    even = [v * 4 for v in x]
    side, mid = [a - b for a, b in zip(x, y)], [(a + b) >> 1 for a, b in zip(x, y)]
    coefs = [1800, -900, 100]
    frames = [
        frame(0, [lpc(x, 16, coefs, 10, 5), lpc(y, 16, coefs, 10, 3, parts=2)], 64, 1, 16),
        frame(1, [lpc(x, 16, [4, -6, 4, -1], 0, 6, fixed=True), lpc(side, 17, [1], 0, 2, fixed=True)], 64, 8, 16),
        frame(2, [lpc(side, 17, [2, -1], 0, 4, fixed=True, wide=True), verbatim(y, 16)], 64, 9, 16),
        frame(3, [lpc(mid, 16, coefs, 10, 5, parts=1, escape=True), lpc(side, 17, coefs[:1], 11, 2)], 64, 10, 16),
        frame(4, [lpc(even, 16, [], 0, 0, fixed=True, wasted=2), constant(-7, 16)], 64, 1, 16),
    ]
    left, right = x * 4 + even, y * 4 + [-7] * 64
    inter = np.array([left, right]).T.reshape(-1).astype("<i2").tobytes()
    media = stream(frames, 320, 2, 16, 64, hashlib.md5(inter).digest())
    ((info, got),) = flac.decode_batch([media])
    assert got.tolist() == [left, right] and info.rate == 8000
    # Frame after frame it is the same.
    assert flac._one_by_one(media[info.frames_at :], info).tolist() == [left, right]
    for at in (len(media) - 1, info.frames_at + 40):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_batch([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode_batch([b"RIFF"])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=700), st.sampled_from([b"", b"\xff\xf8" * 300, bytes(range(256)) * 9, b"a" * 5000])), max_size=5))
def test_round_trip(texts):
    media = flac.encode_batch(texts)
    for t, (info, x) in zip(texts, flac.decode_batch(media)):
        raw = (x[0] + 128).astype(np.uint8).tobytes()
        assert raw == t + bytes(len(raw) - len(t)) and len(raw) % 64 == 0 and raw and info.length == len(t)
        ref = flac._one_by_one(media[texts.index(t)][info.frames_at :], info)
        assert (ref == x).all()


def test_equal_texts_are_stored_alike_beside_any_neighbour():
    r = random.Random(2)
    for _ in range(500):
        v, step, out = r.randint(60, 180), 0, []
        for _ in range(64):
            step += r.choice([-1, 0, 1])
            v = max(1, min(254, v + step))
            out.append(v)
        alone, after = flac.encode_batch([bytes(out)])[0], [flac.encode_batch([n * 64, bytes(out)])[1] for n in (b"\0", b"\xff")]
        assert after == [alone, alone]


def test_weights_of_linear_predictors_are_stored():
    wave = bytes(int(128 + 90 * np.sin(i / 5) * np.cos(i / 31)) for i in range(700))
    media = flac.encode_batch([b"\xff" * 64, wave, b"The quick brown fox. " * 60])
    assert media[1] == flac.encode_batch([wave])[0]
    kinds = []
    for m in media:
        info = flac._Info(m)
        body = m[info.frames_at :]
        for at, n in ((p[1], p[2]) for p in info.seek):
            kinds.append(body[at + (6 if n == flac.BLOCK else 7)] >> 1)
    assert kinds[1] == 32 + flac.ORDER - 1, "a wave needs weights"
    ((info, x),) = flac.decode_batch([media[1]])
    assert (x[0] + 128).astype(np.uint8).tobytes()[:700] == wave
    assert (flac._one_by_one(media[1][info.frames_at :], info) == x).all()
    # Weights by a plain solution of the normal equations of the first frame.
    first = np.frombuffer(wave[: flac.BLOCK], np.uint8).astype(np.int64) - 128
    r = [int((first[j:] * first[: len(first) - j]).sum()) for j in range(flac.ORDER + 1)]
    solved = np.linalg.solve([[r[abs(i - j)] for j in range(flac.ORDER)] for i in range(flac.ORDER)], r[1:])
    got = flac._weights(first.astype(np.int16), np.arange(flac.BLOCK), np.array([0]))[0]
    assert np.abs(got - np.clip(solved * (1 << flac.SHIFT), -128, 127)).max() <= 1


def test_long_texts_take_several_runs(monkeypatch):
    r = random.Random(5)
    texts = [r.randbytes(1_500_000) + b"\xff\xf8\x80\x02" * 9000, b"a" * 3000, b"", b"The quick brown fox. " * 60_000]
    media = flac.encode_batch(texts)
    for t, (_, x) in zip(texts, flac.decode_batch(media)):
        assert (x[0] + 128).astype(np.uint8).tobytes()[: len(t)] == t
    monkeypatch.setattr(flac, "CHUNK", 1 << 14)
    assert flac.encode_batch(texts) == media
    for t, (_, x) in zip(texts, flac.decode_batch(media)):
        assert (x[0] + 128).astype(np.uint8).tobytes()[: len(t)] == t


def test_frames_that_only_look_like_headers_are_left_out():
    number, stream = np.array([0, 7, 1, 2, 0, 1, 5]), np.array([0, 0, 0, 0, 2, 2, 2])
    assert flac._counted(number, stream, 3).tolist() == [True, False, True, True, True, True, False]


def test_frames_by_a_scalar_check():
    (m,) = flac.encode_batch([b"The quick brown fox. " * 100])
    info = flac._Info(m)
    body = m[info.frames_at :]
    starts = [p[1] for p in info.seek]
    assert starts[0] == 0 and body[:2] == b"\xff\xf8"
    size = 6 if body[2] == 0x80 else 7
    assert crc(body[: size - 1], 7, 8) == body[size - 1]


def test_query_against_hashes(spark):
    got = {r.doc_id: r for r in queries.queries()["op2_flac"](spark, f"{DATA}/sf0.001").collect()}
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        raw = r.text.encode()
        padded = raw + bytes(-len(raw) % 64)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_odd_documents_and_blocks(spark, odd, empty, tmp_path):
    media = flac.encode(clashing(odd))
    got = flac.digest(media).collect()
    assert len(got) == 10 and all(r.payload_bytes % 64 == 0 and r.payload_bytes >= 64 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_bytes == by[2].n_bytes == 0 and by[4].media_sha256 == by[5].media_sha256
    assert flac.digest(flac.encode(empty)).count() == 0
    path = str(tmp_path / "pcm")
    flac.write_blocks(flac.decode(media), path)
    parts = flac.read_samples(spark.read.parquet(path), 4, 5000, 9000).orderBy("sample_offset").collect()
    assert [p.sample_offset for p in parts] == [4096, 8192, 12288]
    larger = str(tmp_path / "larger")
    flac.write_blocks(flac.decode(media, 10_000), larger)
    assert [p.sample_offset for p in flac.read_samples(spark.read.parquet(larger), 4, 15_000, 10_000).orderBy("sample_offset").collect()] == [10_000, 20_000]
    from llm.conftest import LONG

    assert bytes(b ^ 0x80 for b in parts[0].pcm) == LONG.encode()[4096:8192]
