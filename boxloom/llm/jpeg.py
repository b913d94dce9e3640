"""Progressive JPEG: a decoder of spectral-selection and successive-approximation scans.

Every scan adds to coefficient arrays, one of 64 columns in zigzag order per component; at
the end they are dequantised, inverse-transformed in numpy, chroma is upsampled and the
full-resolution RGB tensor built. The transform multiplies integer matrices held as
float64, whose sums are exact, so equal streams give equal tensors on any machine.

Any scan is read symbol by symbol. Scans whose codes all have one length (one symbol in
the table, as the payload writer makes them) are read in bulk from the unpacked bits.
"""

from __future__ import annotations

import struct

import numpy as np

_grid = [(r, c) for r in range(8) for c in range(8)]
#: ZIGZAG[k] is the row-major place of the k-th coefficient.
ZIGZAG = np.array([8 * r + c for r, c in sorted(_grid, key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))])
_BITS = 11
_k = np.arange(8)
_basis = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) / 2
_basis[:, 0] /= np.sqrt(2)
#: Rows are samples, columns frequencies, scaled by 2 ** _BITS.
INVERSE = np.rint(_basis * (1 << _BITS))
CHUNK = 4096


class Bits:
    """Bits of one entropy-coded segment, most significant first; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 255
        out = byte >> (7 - (self.at & 7)) & 1
        self.at += 1
        return out

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out


class Table:
    """A Huffman table: canonical codes of each length."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for s in symbols[at : at + n]:
                self.codes[length, code] = s
                code += 1
            at += n
            code <<= 1
        self.only = next(iter(self.codes.items())) if len(self.codes) == 1 else None

    def read(self, bits: Bits) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.bit()
            if (length, code) in self.codes:
                return self.codes[length, code]
        raise ValueError("no such code")


def _extend(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


class Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant


class Image:
    """What a stream holds: components with .coefficients, comments, width and height."""

    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], Table] = {}
        self.comments: list[bytes] = []
        self.components: list[Component] = []
        self.restart = 0


def _frame(image: Image, body: bytes) -> None:
    _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    for i in range(n):
        ident, hv, q = body[6 + 3 * i : 9 + 3 * i]
        image.components.append(Component(ident, hv >> 4, hv & 15, q))
    image.h, image.v = max(c.h for c in image.components), max(c.v for c in image.components)
    image.across, image.down = -(-image.width // (8 * image.h)), -(-image.height // (8 * image.v))
    for c in image.components:
        c.cols, c.rows = image.across * c.h, image.down * c.v
        c.own_cols = -(-(-(-image.width * c.h // image.h)) // 8)
        c.own_rows = -(-(-(-image.height * c.v // image.v)) // 8)
        c.coefficients = np.zeros((c.rows * c.cols, 64), np.int16)


def _units(image: Image, parts: list[Component]) -> list[list[tuple[Component, int]]]:
    """Blocks of each coded unit, in order."""
    if len(parts) == 1:
        c = parts[0]
        return [[(c, r * c.cols + x)] for r in range(c.own_rows) for x in range(c.own_cols)]
    return [
        [(c, (m * c.v + y) * c.cols + k * c.h + x) for c in parts for y in range(c.v) for x in range(c.h)]
        for m in range(image.down)
        for k in range(image.across)
    ]


def _segments(raw: np.ndarray, begin: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments from begin on, without stuffing, and where the next marker stands."""
    ff = np.flatnonzero(raw[begin:-1] == 255) + begin
    after = raw[ff + 1]
    stop = np.flatnonzero((after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255))
    end = int(ff[stop[0]]) if len(stop) else len(raw)
    inside = ff < end
    ff, after = ff[inside], after[inside]
    cuts = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(end - begin, bool)
    drop[ff[after == 0] + 1 - begin] = True
    data, keep = raw[begin:end], ~drop
    keep[cuts - begin] = False
    keep[cuts + 1 - begin] = False
    if not len(cuts):
        return [data[keep].tobytes()], end
    ends = np.cumsum(keep)[np.r_[cuts - begin, len(data) - 1]]
    flat = data[keep].tobytes()
    marks = [0, *ends.tolist()]
    return [flat[a:b] for a, b in zip(marks, marks[1:])], end


def _bulk(image: Image, parts, segments, lo, hi, high, low, tables) -> bool:
    """Reads a scan of one component whose blocks all have the same number of bits."""
    if len(parts) != 1:
        return False
    c = parts[0]
    blocks = (np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)).ravel()
    n, width = len(blocks), hi - lo + 1
    table = tables[0][0 if lo == 0 else 1]
    if lo == 0 and high:
        kind, lead, size = "dc bits", 0, 1
    elif table is None or table.only is None:
        return False
    else:
        (lead, code), symbol = table.only
        if code:
            return False
        if lo == 0:
            kind, size = "dc", symbol
        elif not high:
            kind, size = "ac", symbol & 15
            if symbol >> 4 or not size:
                return False
        else:
            kind, size = "ac bits", width
            if symbol or not (c.coefficients[blocks, lo : hi + 1] != 0).all():
                return False
    per = (lead + size) * (width if kind == "ac" else 1)
    every = image.restart or n
    if every == 1:
        step = -(-per // 8)
        if any(len(s) != step for s in segments) or len(segments) != n:
            return False
        rows = lambda a, b: np.unpackbits(np.frombuffer(b"".join(segments[a:b]), np.uint8)).reshape(b - a, -1)[:, :per]
    else:
        if len(segments) != 1 or len(segments[0]) != -(-n * per // 8):
            return False
        data = np.frombuffer(segments[0], np.uint8)
        rows = lambda a, b: np.unpackbits(data[a * per // 8 : -(-b * per // 8)])[: (b - a) * per].reshape(b - a, per)
    last = 0
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK)
        bits = rows(a, b).reshape(b - a, -1, lead + size)
        if bits[:, :, :lead].any():
            return False
        bits, at = bits[:, :, lead:], blocks[a:b]
        if kind == "ac bits":
            old = c.coefficients[at, lo : hi + 1]
            c.coefficients[at, lo : hi + 1] = old + np.sign(old) * (bits[:, 0].astype(np.int16) << low)
            continue
        value = np.zeros(bits.shape[:2], np.int32)
        for i in range(size):
            value = value << 1 | bits[:, :, i]
        if kind == "dc bits":
            c.coefficients[at, 0] |= (value[:, 0] << low).astype(np.int16)
            continue
        if size:
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        if kind == "dc":
            value = value[:, 0] if every == 1 else np.cumsum(value[:, 0]) + last
            last = int(value[-1])
            c.coefficients[at, 0] = value << low
        else:
            c.coefficients[at, lo : hi + 1] = value << low
    return True


def _ac_refine(bits: Bits, block: np.ndarray, lo: int, hi: int, low: int, table: Table, run: int) -> int:
    one, k = 1 << low, lo
    if not run:
        while k <= hi:
            symbol = table.read(bits)
            zeros, size, value = symbol >> 4, symbol & 15, 0
            if size:
                value = one if bits.bit() else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= hi:
                if block[k]:
                    if bits.bit() and not block[k] & one:
                        block[k] += one if block[k] > 0 else -one
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if value and k <= hi:
                block[k] = value
            k += 1
    if run:
        for k in range(k, hi + 1):
            if block[k] and bits.bit() and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one
        run -= 1
    return run


def _ac_first(bits: Bits, block: np.ndarray, lo: int, hi: int, low: int, table: Table, run: int) -> int:
    if run:
        return run - 1
    k = lo
    while k <= hi:
        symbol = table.read(bits)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = _extend(bits.take(size), size) << low
        elif zeros < 15:
            return (1 << zeros) + bits.take(zeros) - 1
        else:
            k += 15
        k += 1
    return 0


def _scan(image: Image, body: bytes, segments: list[bytes], bulk: bool) -> None:
    by = {c.ident: c for c in image.components}
    parts, tables = [], []
    for i in range(body[0]):
        ident, which = body[1 + 2 * i : 3 + 2 * i]
        parts.append(by[ident])
        tables.append((image.huffman.get((0, which >> 4)), image.huffman.get((1, which & 15))))
    lo, hi, shift = body[-3:]
    high, low = shift >> 4, shift & 15
    if bulk and _bulk(image, parts, segments, lo, hi, high, low, tables):
        return
    units = _units(image, parts)
    every = image.restart or len(units)
    for s, data in enumerate(segments):
        bits, last, run = Bits(data), dict.fromkeys(by, 0), 0
        for unit in units[s * every : (s + 1) * every]:
            for c, at in unit:
                dc, ac = tables[parts.index(c)]
                block = c.coefficients[at]
                if lo == 0 and high:
                    block[0] |= bits.bit() << low
                elif lo == 0:
                    size = dc.read(bits)
                    last[c.ident] += _extend(bits.take(size), size)
                    block[0] = last[c.ident] << low
                else:
                    run = (_ac_refine if high else _ac_first)(bits, block, lo, hi, low, ac, run)


def read(stream: bytes, bulk: bool = True) -> Image:
    """The coefficients of a progressive stream."""
    raw, image, at = np.frombuffer(stream, np.uint8), Image(), 2
    if stream[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    while at < len(stream):
        if stream[at] != 255:
            raise ValueError("marker expected")
        kind = stream[at + 1]
        if kind == 255:
            at += 1
            continue
        if kind == 0xD9:
            break
        length = struct.unpack(">H", stream[at + 2 : at + 4])[0]
        body, at = stream[at + 4 : at + 2 + length], at + 2 + length
        if kind == 0xC2:
            _frame(image, body)
        elif kind in (0xC0, 0xC1, 0xC3, 0xC9, 0xCA):
            raise ValueError("not a progressive Huffman stream")
        elif kind == 0xFE:
            image.comments.append(body)
        elif kind == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0] >> 4, body[0] & 15] = Table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDA:
            segments, at = _segments(raw, at)
            _scan(image, body, segments, bulk)
    return image


def plane(c: Component, quant: np.ndarray) -> np.ndarray:
    """Samples of a component, all its blocks, as uint8."""
    out = np.empty((c.rows * c.cols, 8, 8), np.uint8)
    for a in range(0, len(out), CHUNK):
        part = c.coefficients[a : a + CHUNK]
        n = len(part)
        f = np.zeros((n, 64))
        f[:, ZIGZAG] = part * quant
        rows = (f.reshape(n * 8, 8) @ INVERSE.T).reshape(n, 8, 8)
        both = rows.transpose(0, 2, 1).reshape(n * 8, 8) @ INVERSE.T
        level = np.floor(both / (1 << 2 * _BITS) + 0.5) + 128
        out[a : a + CHUNK] = np.clip(level, 0, 255).astype(np.uint8).reshape(n, 8, 8).transpose(0, 2, 1)
    return out.reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.cols * 8)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor, height x width x 3, chroma repeated to the size of luma."""
    full = []
    for c in image.components:
        p = plane(c, image.quant[c.quant])
        p = p.repeat(image.v // c.v, axis=0).repeat(image.h // c.h, axis=1)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    y, b, r = (p.astype(np.int32) for p in full)
    b, r, half = b - 128, r - 128, 1 << 15
    parts = (y + ((91881 * r + half) >> 16), y - ((22554 * b + 46802 * r + half) >> 16), y + ((116130 * b + half) >> 16))
    return np.stack([np.clip(p, 0, 255).astype(np.uint8) for p in parts], axis=2)


# ---------------------------------------------------------------- payloads


def _marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def _table(which: int, symbol: int) -> bytes:
    return _marker(0xC4, bytes([which, 1, *[0] * 15, symbol]))


def _coded(rows, n: int, stuffed: bool = True) -> bytes:
    """Bits of all blocks, filled up with ones and stuffed."""
    out = []
    for a in range(0, n, CHUNK):
        bits = rows(a, min(n, a + CHUNK)).ravel()
        if len(bits) % 8:
            bits = np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]
        out.append(np.packbits(bits))
    return np.concatenate(out).tobytes().replace(b"\xff", b"\xff\x00")


def _scan_head(component: int, lo: int, hi: int, high: int, low: int) -> bytes:
    return _marker(0xDA, bytes([1, component, 0, lo, hi, high << 4 | low]))


def write_payload(payload: bytes) -> bytes:
    """A progressive colour stream that holds the payload: a byte b is the luma coefficient 256 + b.

    All coefficients have the same size category, so that codes are one bit long and every
    block takes as many bits. Luma is coded in five scans (DC, two bands of AC, then the last
    bit of both), chroma at half resolution is neutral. The payload's length is in a comment.
    """
    n = len(payload) // 64
    down = -(-n // 8191)
    across = -(-n // down)
    values = np.zeros(across * down * 64, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    values = values.reshape(-1, 64)
    n = len(values)
    high = 128 + (values >> 1)

    def band(lo, hi):
        def rows(a, b):
            out = np.zeros((b - a, hi - lo + 1, 9), np.uint8)
            out[:, :, 1:] = np.unpackbits(high[a:b, lo : hi + 1, None], axis=2)
            return out

        return rows

    def last(a, b):
        out = np.zeros((b - a, 64), np.uint8)
        out[:, 1:] = values[a:b, 1:] & 1
        return out

    first = np.packbits(np.concatenate([np.zeros((n, 1), np.uint8), np.unpackbits(high[:, :1], axis=1), np.ones((n, 7), np.uint8)], axis=1), axis=1)
    marks = np.stack([np.full(n, 255, np.uint8), 0xD0 + np.arange(n, dtype=np.uint8) % 8], axis=1)
    restarts = np.concatenate([first, marks], axis=1)
    # the first byte of a block holds a zero bit, the second is 255 or 127: only it needs stuffing
    full = first[:, 1] == 255
    wide = np.concatenate([restarts[:, :2], np.zeros((n, 1), np.uint8), restarts[:, 2:]], axis=1)
    use = np.ones(wide.shape, bool)
    use[:, 2] = full
    use[-1, 3:] = False
    chroma = -(-across // 2) * -(-down // 2)
    blank = _coded(lambda a, b: np.zeros(b - a, np.uint8), chroma)
    parts = [
        b"\xff\xd8",
        _marker(0xFE, b"payload" + struct.pack(">Q", len(payload))),
        _marker(0xDB, bytes([0]) + bytes([1] * 64)),
        _marker(0xC2, struct.pack(">BHHB", 8, down * 8, across * 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _marker(0xDD, struct.pack(">H", 1)),
        _table(0x00, 8),
        _scan_head(1, 0, 0, 0, 1),
        wide[use].tobytes(),
        _marker(0xDD, struct.pack(">H", 0)),
        _table(0x00, 0),
        _scan_head(2, 0, 0, 0, 1),
        blank,
        _scan_head(3, 0, 0, 0, 1),
        blank,
        _table(0x10, 8),
        _scan_head(1, 1, 5, 0, 1),
        _coded(band(1, 5), n),
        _scan_head(1, 6, 63, 0, 1),
        _coded(band(6, 63), n),
        _table(0x10, 0),
        _scan_head(1, 1, 63, 1, 0),
        _coded(last, n),
        _scan_head(1, 0, 0, 1, 0),
        _coded(lambda a, b: values[a:b, :1] & 1, n),
        b"\xff\xd9",
    ]
    return b"".join(parts)


def payload_of(image: Image) -> bytes:
    """The payload of a stream that write_payload made, from its decoded coefficients."""
    size = next(struct.unpack(">Q", c[7:])[0] for c in image.comments if c.startswith(b"payload"))
    c = image.components[0]
    own = (np.arange(c.own_rows)[:, None] * c.cols + np.arange(c.own_cols)).ravel()
    return (c.coefficients[own] - 256).astype(np.uint8).tobytes()[:size]
