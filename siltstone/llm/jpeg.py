"""Progressive JPEG media columns: payload bytes as coefficients, and a decoder to full-resolution RGB tensors.

decode() takes baseline and progressive files: scans add to coefficient arrays by spectral selection and successive
approximation (first scans, refinements, end-of-band runs, restarts), then blocks are inverse-transformed in numpy,
chroma is repeated up to full resolution, and colours are converted. All arithmetic after the scans is on integers (in
float64, below 2^53, so sums are exact in any order): equal files give equal tensors.

encode_payload() stores bytes losslessly in the format's own unit: byte b is the quantised coefficient b if b >= 128,
else b - 255, so every coefficient has 8 significant bits. Chroma has half the resolution (4:2:0): a square of 16 x 16
pixels holds 6 x 64 bytes, four blocks of luma and one of each chroma. The coefficients go out in eleven scans: DC and AC bands without their lowest bit, then the lowest bits.
As the magnitudes have equally many bits, the AC scans need codes of one symbol, and their bits lie at fixed places: a
decoder that sees such a table reads them with array operations. A comment holds the payload's length.

store() writes the media to the shared folder, and read() takes them from there; the tensor column has every pixel.

Defined cases: null text is empty and is one tile of spaces; repeated rows give repeated rows; a text of any length
that fits 65,500 pixels square is stored; bytes that are no JPEG, or end early, raise Broken; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm.common import fresh

UNIT = 192
#: Blocks of 64 bytes in a square of 16 x 16 pixels.
SQUARE = 6
ROWS_AT_ONCE = 64
OUT = 4 << 20


class Broken(ValueError):
    """Bytes that are no readable JPEG."""


def zigzag() -> np.ndarray:
    """Natural index (8 * row + column) of each place along the zigzag."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag()


@functools.lru_cache(maxsize=256)
def code_table(counts: bytes, symbols: bytes) -> tuple:
    """Lengths and symbols of all windows as bytes, the symbol of a table of one one-bit code, and both as arrays."""
    length, symbol = huffman(counts, symbols)
    return length.tobytes(), symbol.tobytes(), symbols[0] if len(symbols) == 1 and counts[0] == 1 else None, length, symbol


def huffman(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window the length of the code that it starts with (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, k = 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            a = code << (16 - bits)
            if a >= 1 << 16:
                raise Broken("codes overflow")
            length[a : a + (1 << (16 - bits))], symbol[a : a + (1 << (16 - bits))] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit place on; ones follow the end."""
    b = np.frombuffer(data + b"\xff\xff\xff", np.uint8).astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return ((three[:, None] >> (8 - np.arange(8, dtype=np.uint32))) & 0xFFFF).ravel()


def extend(bits: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Signed values of magnitude bits."""
    half = np.where(np.asarray(size) > 0, 1 << (np.maximum(size, 1) - 1), 0)
    return np.where(bits < half, bits - (1 << np.asarray(size)) + 1, bits)


class Bits:
    """One by one, for scans whose bits do not lie at fixed places."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.end + 7:
            raise Broken("scan ends early")
        i = self.at >> 3
        value = int.from_bytes(self.data[i : i + 5], "big") >> (40 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, table: tuple[bytes, bytes]) -> int:
        i = self.at >> 3
        w = int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF
        if not table[0][w] or self.at >= self.end:
            raise Broken("no such code")
        self.at += table[0][w]
        return table[1][w]

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Component:
    def __init__(self, name: int, h: int, v: int, table: int):
        self.name, self.h, self.v, self.table = name, h, v, table
        self.coefs: np.ndarray = np.zeros((0, 0, 64), np.int32)
        self.wide = self.high = 0


@functools.lru_cache(maxsize=16)
def alone(high: int, wide: int) -> np.ndarray:
    r, c = np.divmod(np.arange(high * wide), wide)
    return np.stack((np.zeros_like(r), r, c), axis=1)


@functools.lru_cache(maxsize=16)
def interleaved(sampling: tuple, high: int, wide: int) -> np.ndarray:
    y, x = np.divmod(np.arange(high * wide), wide)
    cells = [(i, v, h) for i, (across, down) in enumerate(sampling) for v in range(down) for h in range(across)]
    out = np.empty((len(y), len(cells), 3), np.int64)
    for k, (i, v, h) in enumerate(cells):
        out[:, k, 0], out[:, k, 1], out[:, k, 2] = i, y * sampling[i][1] + v, x * sampling[i][0] + h
    return out.reshape(-1, 3)


class Image:
    """A file's coefficients (rows x columns x 64 in zigzag order for each component) and comments."""

    def __init__(self, data: bytes):
        self.data, self.comments = data, []
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, tuple] = {}
        self.parts: list[Component] = []
        self.restart, self.progressive, self.width, self.height = 0, False, 0, 0
        self.read()

    def read(self) -> None:
        d = self.data
        if d[:2] != b"\xff\xd8":
            raise Broken("no JPEG")
        at = 2
        while True:
            while d[at : at + 2] == b"\xff\xff":
                at += 1
            if len(d) < at + 4 and d[at : at + 2] != b"\xff\xd9" or d[at : at + 1] != b"\xff":
                raise Broken("no marker")
            kind = d[at + 1]
            if kind == 0xD9:
                return
            size = int.from_bytes(d[at + 2 : at + 4], "big")
            body = d[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise Broken("segment ends early")
            at += 2 + size
            if kind == 0xDB:
                self.read_quant(body)
            elif kind == 0xC4:
                self.read_codes(body)
            elif kind in (0xC0, 0xC1, 0xC2):
                self.read_frame(body, kind == 0xC2)
            elif 0xC3 <= kind <= 0xCF:
                raise Broken("kind of frame")
            elif kind == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                at = self.read_scan(body, at)

    def read_quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[name] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
            at += 1 + n

    def read_codes(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            symbols = body[at + 17 : at + 17 + sum(counts)]
            self.tables[body[at]] = code_table(bytes(counts), bytes(symbols))
            at += 17 + sum(counts)

    def read_frame(self, body: bytes, progressive: bool) -> None:
        self.progressive = progressive
        self.height, self.width = (int.from_bytes(body[i : i + 2], "big") for i in (1, 3))
        if body[0] != 8 or not self.height or not self.width or len(body) != 6 + 3 * body[5]:
            raise Broken("frame")
        self.parts = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
        self.hmax, self.vmax = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.mcus = (-(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax)))
        for p in self.parts:
            p.wide, p.high = (-(-(-(-n * f // m)) // 8) for n, f, m in ((self.width, p.h, self.hmax), (self.height, p.v, self.vmax)))
            p.coefs = np.zeros((self.mcus[0] * p.v, self.mcus[1] * p.h, 64), np.int32)

    def read_scan(self, body: bytes, at: int) -> int:
        n = body[0]
        try:
            own = [(next(p for p in self.parts if p.name == body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        except StopIteration:
            raise Broken("scan of an unknown component") from None
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        end, pieces, start = at, [], at
        while True:  # to the next marker that is no restart
            end = self.data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(self.data):
                raise Broken("scan ends early")
            mark = self.data[end + 1]
            if mark and not 0xD0 <= mark <= 0xD7:
                break
            if mark:
                pieces.append(self.data[start:end])
                start = end + 2
            end += 2
        pieces = [p.replace(b"\xff\x00", b"\xff") for p in [*pieces, self.data[start:end]]]
        order = self.order(own)
        per = (sum(p.h * p.v for p, *_ in own) if n > 1 else 1) * self.restart or len(order)
        for i, piece in enumerate(pieces):
            some = order[i * per : (i + 1) * per]
            if len(some):
                self.fill(piece, own, some, first, last, high, low)
        return end

    def order(self, own: list) -> np.ndarray:
        """Rows (component in the scan, block row, block column) in the order of the scan."""
        if len(own) == 1:
            return alone(own[0][0].high, own[0][0].wide)
        return interleaved(tuple((p.h, p.v) for p, *_ in own), *self.mcus)

    def fill(self, data: bytes, own: list, order: np.ndarray, first: int, last: int, high: int, low: int) -> None:
        if not self.progressive:
            return self.baseline(data, own, order)
        if first == 0:
            return self.dc_more(data, own, order, low) if high else self.dc_first(data, own, order, low)
        p, _, name = own[0]
        if 16 + name not in self.tables:
            raise Broken("no code table")
        lone = self.tables[16 + name][2]
        band = slice(first, last + 1)
        r, c = order[:, 1], order[:, 2]
        n = last - first + 1
        if not high and lone is not None and 0 < lone < 16:
            p.coefs[r, c, band] = extend(self.fixed(data, len(order) * n, 1 + lone) & ((1 << lone) - 1), lone).reshape(-1, n) << low
        elif high and lone == 0 and (old := p.coefs[r, c, band]).all():
            bits = self.plain(data, len(order) * (n + 1)).reshape(-1, n + 1)[:, 1:]
            p.coefs[r, c, band] = old + np.sign(old) * (bits.astype(np.int32) << low)
        elif high:
            self.ac_more(data, p, self.tables[16 + name], order, first, last, low)
        else:
            self.ac_first(data, p, self.tables[16 + name], order, first, last, low)

    @staticmethod
    def plain(data: bytes, n: int) -> np.ndarray:
        if 8 * len(data) < n:
            raise Broken("scan ends early")
        return np.unpackbits(np.frombuffer(data, np.uint8), count=n)

    def fixed(self, data: bytes, n: int, bits: int) -> np.ndarray:
        """Numbers of so many bits each."""
        if bits == 8 and len(data) >= n:
            return np.frombuffer(data, np.uint8, n).astype(np.int32)
        return self.plain(data, n * bits).reshape(n, bits).astype(np.int32) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32))

    def dc_first(self, data: bytes, own: list, order: np.ndarray, low: int) -> None:
        win = windows(data)
        tables = []
        for _, name, _ in own:
            if name not in self.tables:
                raise Broken("no code table")
            length, symbol = self.tables[name][3:]
            tables.append((length[win].astype(np.int64), symbol[win].astype(np.int64)))
        steps = [np.where(a > 0, a + b, 0).astype(np.uint8).tobytes() for a, b in tables]
        which, at, places, end = order[:, 0].tolist(), 0, [], len(win)
        for i in which:  # only the places follow one from the other
            if at >= end or not steps[i][at]:
                raise Broken("scan ends early")
            places.append(at)
            at += steps[i][at]
        places, comp = np.array(places), order[:, 0]
        length, size = (np.choose(comp, [t[k][places] for t in tables]) for k in (0, 1))
        start = places + length
        b = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int64)
        i = start >> 3
        five = b[i] << 32 | b[i + 1] << 24 | b[i + 2] << 16 | b[i + 3] << 8 | b[i + 4]
        diff = extend(five >> (40 - (start & 7) - size) & ((1 << size) - 1), size)
        for k, (p, *_) in enumerate(own):
            on = comp == k
            p.coefs[order[on, 1], order[on, 2], 0] = np.cumsum(diff[on]) << low

    def dc_more(self, data: bytes, own: list, order: np.ndarray, low: int) -> None:
        bits = self.plain(data, len(order)).astype(np.int32)
        for k, (p, *_) in enumerate(own):
            on = order[:, 0] == k
            p.coefs[order[on, 1], order[on, 2], 0] |= bits[on] << low

    def ac_first(self, data: bytes, p: Component, table: tuple, order: np.ndarray, first: int, last: int, low: int) -> None:
        bits, run = Bits(data), 0
        for _, r, c in order.tolist():
            if run:
                run -= 1
                continue
            k, block = first, p.coefs[r, c]
            while k <= last:
                rs = bits.symbol(table)
                zeros, size = rs >> 4, rs & 15
                if size:
                    k += zeros
                    if k > last:
                        raise Broken("too many coefficients")
                    block[k] = bits.signed(size) * (1 << low)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) - 1 + bits.take(zeros)
                    break

    def ac_more(self, data: bytes, p: Component, table: tuple, order: np.ndarray, first: int, last: int, low: int) -> None:
        bits, run, one = Bits(data), 0, 1 << low

        def correct(block: np.ndarray, k: int) -> None:
            if bits.take(1):
                block[k] += one if block[k] > 0 else -one

        for _, r, c in order.tolist():
            k, block = first, p.coefs[r, c]
            while k <= last and not run:
                rs = bits.symbol(table)
                zeros, new = rs >> 4, 0
                if rs & 15:
                    new = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= last:
                    if block[k]:
                        correct(block, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        block[k] = new  # zero after a run of sixteen
                        k += 1
                        break
                    k += 1
            if run:
                for j in range(k, last + 1):
                    if block[j]:
                        correct(block, j)
                run -= 1

    def baseline(self, data: bytes, own: list, order: np.ndarray) -> None:
        bits, before = Bits(data), [0] * len(own)
        for i, r, c in order.tolist():
            p, dc, ac = own[i]
            block = p.coefs[r, c]
            before[i] += bits.signed(bits.symbol(self.tables[dc]))
            block[0], k = before[i], 1
            while k < 64:
                rs = bits.symbol(self.tables[16 + ac])
                if not rs:
                    break
                k += rs >> 4
                if rs & 15:
                    if k > 63:
                        raise Broken("too many coefficients")
                    block[k] = bits.signed(rs & 15)
                k += 1

    def rgb(self) -> np.ndarray:
        """height x width x 3 bytes; grey is repeated."""
        out = np.empty((self.height, self.width, 3), np.uint8)
        for top in range(0, self.mcus[0], ROWS_AT_ONCE):
            planes = []
            for p in self.parts:
                blocks = p.coefs[top * p.v : (top + ROWS_AT_ONCE) * p.v]
                plane = samples(blocks, self.quant[p.table])
                planes.append(plane.repeat(self.vmax // p.v, axis=0).repeat(self.hmax // p.h, axis=1))
            a = top * 8 * self.vmax
            b = min(self.height, a + len(planes[0]))
            planes = [x[: b - a, : self.width].astype(np.int32) for x in planes]
            out[a:b] = colours(*planes) if len(planes) == 3 else planes[0][:, :, None]
        return out


def basis() -> np.ndarray:
    """The inverse transform's matrix (sample, frequency) in units of 2^-12."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    return np.round(np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(0.5), 1) / 2 * 4096)


BASIS = basis()


def samples(blocks: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Blocks (rows x columns x 64, zigzag) as a plane of bytes."""
    rows, cols, _ = blocks.shape
    f = np.empty((rows, cols, 64))
    f[:, :, ZIGZAG] = blocks * quant
    f = f.reshape(-1, 8) @ BASIS.T  # along each row of a block
    f = f.reshape(rows * cols, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS.T
    f = np.floor((f + (1 << 23)) * (1.0 / (1 << 24))) + 128
    plane = f.reshape(rows, cols, 8, 8).transpose(0, 3, 1, 2).reshape(rows * 8, cols * 8)
    return np.clip(plane, 0, 255).astype(np.uint8)


def colours(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    r = y + ((91881 * cr + 32768) >> 16)
    g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    b = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack((r, g, b), axis=2), 0, 255).astype(np.uint8)


def segment(kind: int, body: bytes) -> bytes:
    return bytes((0xFF, kind)) + (len(body) + 2).to_bytes(2, "big") + body


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of up to 16 bits one after the other, then ones to the end of a byte."""
    shift = np.arange(15, -1, -1)
    bits = (values[:, None] >> shift & 1).astype(np.uint8)[shift < sizes[:, None]]
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()


CODES = segment(0xC4, b"\x00" + bytes((0, 0, 0, 9)) + bytes(12) + bytes(range(9))) + segment(0xC4, b"\x10\x01" + bytes(15) + b"\x07") + segment(0xC4, b"\x11\x01" + bytes(15) + b"\x00")


def encode_payload(payload: bytes) -> bytes:
    """A progressive file that holds a payload, whose length is a positive multiple of 192."""
    blocks = len(payload) // 64
    if len(payload) % UNIT or not blocks:
        raise ValueError("the length must be a positive multiple of 192")
    squares = -(-blocks // SQUARE)
    wide = math.isqrt(squares - 1) + 1
    high = -(-squares // wide)
    if 16 * wide > 65500:
        raise ValueError("the payload is too long")
    units = np.full((high * wide * SQUARE, 64), 32, np.uint8)
    units[:blocks] = np.frombuffer(payload, np.uint8).reshape(blocks, 64)
    units = units.reshape(high * wide, SQUARE, 64)
    value = np.where(units < 128, units.astype(np.int16) - 255, units)
    scans = []

    def scan(parts: tuple[int, ...], ac: int, first: int, last: int, approx: int, data: bytes) -> None:
        scans.append(segment(0xDA, bytes((len(parts),)) + b"".join(bytes((1 + p, ac)) for p in parts) + bytes((first, last, approx))))
        scans.append(data.replace(b"\xff", b"\xff\x00"))

    dc = value[:, :, 0].astype(np.int64)
    half = dc >> 1
    # differences within each component, in the order of the interleaved scan
    diff = np.concatenate((np.diff(half[:, :4].ravel(), prepend=0).reshape(-1, 4), np.diff(half[:, 4:], axis=0, prepend=0)), axis=1).ravel()
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    scan((0, 1, 2), 0, 0, 0, 0x01, pack_bits(size << size | np.where(diff < 0, diff + (1 << size) - 1, diff), 4 + size))
    scan((0, 1, 2), 0, 0, 0, 0x10, pack_bits(dc.ravel() & 1, np.ones(dc.size, np.int64)))
    luma = value[:, :4].reshape(high, wide, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)  # rows of blocks
    for p, part in enumerate((luma, value[:, 4], value[:, 5])):
        magnitude = np.abs(part)
        # code 0 and the seven bits of half the magnitude: a byte below 128
        coarse = np.where(part > 0, magnitude >> 1, 127 - (magnitude >> 1)).astype(np.uint8)
        fine = (magnitude & 1).astype(np.uint8)
        fine[:, 0] = 0  # the code for the end of the block
        scan((p,), 0, 1, 5, 0x01, np.ascontiguousarray(coarse[:, 1:6]).tobytes())
        scan((p,), 0, 6, 63, 0x01, np.ascontiguousarray(coarse[:, 6:]).tobytes())
        scan((p,), 1, 1, 63, 0x10, np.packbits(fine, axis=1).tobytes())
    frame = bytes((8,)) + (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03" + b"".join(bytes((1 + p, 0x11 if p else 0x22, 0)) for p in range(3))
    head = b"\xff\xd8" + segment(0xFE, b"payload %d" % len(payload)) + segment(0xDB, b"\x00" + b"\x01" * 64) + segment(0xC2, frame) + CODES
    return head + b"".join(scans) + b"\xff\xd9"


def payload_of(image: Image) -> bytes:
    """The payload that encode_payload stored."""
    length = next((int(c[8:]) for c in image.comments if c.startswith(b"payload ")), None)
    if length is None or [(p.h, p.v) for p in image.parts] != [(2, 2), (1, 1), (1, 1)]:
        raise Broken("no payload")
    high, wide = image.mcus
    luma = image.parts[0].coefs.reshape(high, 2, wide, 2, 64).transpose(0, 2, 1, 3, 4).reshape(high * wide, 4, 64)
    value = np.concatenate((luma, *(p.coefs.reshape(high * wide, 1, 64) for p in image.parts[1:])), axis=1)
    return np.where(value < 0, value + 255, value).astype(np.uint8).tobytes()[:length]


def feature(rgb: np.ndarray) -> str:
    """Width, height, sums of the three channels and of the steps between neighbours, and a checksum."""
    sums = [int(x) for x in rgb.sum(axis=(0, 1), dtype=np.int64)]
    step = int(np.abs(np.diff(rgb.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return ":".join(map(str, (rgb.shape[1], rgb.shape[0], *sums, step, zlib.crc32(rgb))))


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, media binary, payload binary, width int, height int, rgb binary, feature string"


def limited(rows: Iterator[tuple[list, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (values, bytes) as batches of about OUT bytes."""
    held, size = [], 0
    for values, n in rows:
        held.append(values)
        size += n + 64
        if size >= OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def store_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows() -> Iterator[tuple[list, int]]:
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                data = text.as_py() or b""
                media = encode_payload(data + b" " * (-len(data) % UNIT if data else UNIT))
                yield [doc_id, len(data), media], len(media)

    yield from limited(rows(), schema)


def store(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Writes doc_id, n_bytes and media (each whole text, padded with spaces, as a progressive JPEG) and reads them back."""
    spark = documents.sparkSession
    path = path or fresh(spark, "jpeg-media")
    media = documents.select("doc_id", "text").mapInArrow(store_batches, STORED)
    media.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(STORED).parquet(path)


def read_batches(tensors: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("rgb", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[list, int]]:
            for b in batches:
                for doc_id, n_bytes, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    data = media.as_py()
                    image = Image(data)
                    rgb, payload = image.rgb(), payload_of(image)
                    yield [doc_id, n_bytes, data, payload, image.width, image.height, rgb.tobytes() if tensors else None, feature(rgb)], len(data) + len(payload) + (rgb.nbytes if tensors else 0)

        yield from limited(rows(), schema)

    return run


def read(stored: DataFrame, tensors: bool = True) -> DataFrame:
    """Decodes media: the payload, the RGB tensor (rows of pixels, three bytes each; null without tensors) and a feature of it."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read_batches(tensors), READ)
