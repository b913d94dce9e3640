import hashlib
import random
import struct
import zlib

import numpy as np

from boxloom.llm import jpeg, media


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def code(self, symbol):
        self.put(symbol, 8)

    def done(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def signed(value):
    n = int(abs(value)).bit_length()
    return n, value if value > 0 else value + (1 << n) - 1


def toward_zero(v, low):
    return (abs(v) >> low) * (1 if v >= 0 else -1)


def sample_stream(y, cb, cr, down, across):
    """A 4:2:0 stream of given coefficients: interleaved DC, then AC bands with one bit refined."""
    mark = jpeg._marker
    symbols = bytes(range(255))
    table = lambda which: mark(0xC4, bytes([which, *[0] * 7, 255, *[0] * 8]) + symbols)
    quant = bytes([0, *range(1, 65)])
    parts = [b"\xff\xd8", mark(0xDB, quant), mark(0xC2, struct.pack(">BHHB", 8, down * 16 - 3, across * 16 - 5, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), table(0), table(0x10)]
    out, last = Out(), [0, 0, 0]
    blocks = [(c, (m * v + r) * across * h + k * h + x) for m in range(down) for k in range(across) for c, (h, v) in enumerate([(2, 2), (1, 1), (1, 1)]) for r in range(v) for x in range(h)]
    for c, at in blocks:
        value = int((y, cb, cr)[c][at, 0]) >> 1
        n, bits = signed(value - last[c]) if value != last[c] else (0, 0)
        last[c] = value
        out.code(n)
        out.put(bits, n)
    parts += [mark(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1])), out.done()]
    out = Out()
    for c, at in blocks:
        out.put(int((y, cb, cr)[c][at, 0]) & 1, 1)
    parts += [mark(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10])), out.done()]
    for ident, coef in ((1, y), (2, cb), (3, cr)):
        for lo, hi in ((1, 9), (10, 63)):
            out = Out()
            own = range(len(coef))
            for at in own:
                run, k_last = 0, max([k for k in range(lo, hi + 1) if toward_zero(int(coef[at, k]), 1)], default=lo - 1)
                for k in range(lo, k_last + 1):
                    v = toward_zero(int(coef[at, k]), 1)
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        out.code(0xF0)
                        run -= 16
                    n, bits = signed(v)
                    out.code(run << 4 | n)
                    out.put(bits, n)
                    run = 0
                if k_last < hi:
                    out.code(0)
            parts += [mark(0xDA, bytes([1, ident, 0, lo, hi, 1])), out.done()]
        out = Out()
        for at in range(len(coef)):
            values = [int(v) for v in coef[at]]
            fresh = [k for k in range(1, 64) if abs(values[k]) == 1]
            run, held = 0, []
            for k in range(1, (fresh[-1] if fresh else 0) + 1):
                if abs(values[k]) > 1:
                    held.append(abs(values[k]) & 1)
                elif not values[k]:
                    run += 1
                    if run == 16:
                        out.code(0xF0)
                        out.bits += held
                        run, held = 0, []
                else:
                    out.code(run << 4 | 1)
                    out.put(int(values[k] > 0), 1)
                    out.bits += held
                    run, held = 0, []
            if not fresh or fresh[-1] < 63:
                out.code(0)
                out.bits += held + [abs(values[k]) & 1 for k in range((fresh[-1] if fresh else 0) + 1, 64) if abs(values[k]) > 1]
        parts += [mark(0xDA, bytes([1, ident, 0, 1, 63, 0x10])), out.done()]
    return b"".join([*parts, b"\xff\xd9"])


def test_general_streams():
    rng = np.random.default_rng(3)
    down, across = 2, 3
    sets = []
    for n in (4 * down * across, down * across, down * across):
        c = rng.integers(-9, 10, (n, 64)) * (rng.random((n, 64)) < 0.2)
        c[:, 0] = rng.integers(-40, 60, n)
        sets.append(c)
    image = jpeg.read(sample_stream(*sets, down, across))
    for c, want in zip(image.components, sets):
        rows = want
        assert (c.coefficients == rows).all()
    out = jpeg.rgb(image)
    assert out.shape == (down * 16 - 3, across * 16 - 5, 3)
    c = image.components[0]
    quant = np.arange(1, 65)
    exact = np.zeros((8, 8))
    for k in range(64):
        u, v = divmod(int(jpeg.ZIGZAG[k]), 8)
        wave = lambda i: np.cos((2 * np.arange(8) + 1) * i * np.pi / 16) * (np.sqrt(0.125) if i == 0 else 0.5)
        exact += c.coefficients[0, k] * quant[k] * np.outer(wave(u), wave(v))
    got = jpeg.plane(c, quant)[:8, :8]
    assert np.abs(np.clip(exact + 128, 0, 255) - got).max() < 2


def test_payloads_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 7, 65):
        data = rng.randbytes(64 * n)
        stream = jpeg.write_payload(data)
        fast, slow = jpeg.read(stream), jpeg.read(stream, bulk=False)
        assert jpeg.payload_of(fast) == jpeg.payload_of(slow) == data
        for a, b in zip(fast.components, slow.components):
            assert (a.coefficients == b.coefficients).all()
    data = rng.randbytes(64 * 8200)
    assert jpeg.payload_of(jpeg.read(jpeg.write_payload(data))) == data


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_query(spark):
    texts = ["", None, "é" * 32, "x" * 65, "hello", "hello"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.id: r for r in media.describe(media.store(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        want = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    assert got[0][2:] == got[1][2:] and got[4][1:] == got[5][1:] and got[4].feature != got[3].feature
    assert media.describe(media.store(docs.limit(0))).count() == 0


def test_tensors_are_columns(spark):
    stored = media.store(spark.createDataFrame([(1, "ab" * 100), (2, None)], "doc_id long, text string"))
    for r in media.tensors(stored).collect():
        data = stored.where(f"id = {r.id}").first().media
        assert bytes(r.rgb) == jpeg.rgb(jpeg.read(bytes(data))).tobytes() and len(r.rgb) == r.height * r.width * 3
