import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import jpeg, queries


class Writer:
    """A bit by bit encoder with one code of eight bits for each symbol, for tests of the reader."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << n) - 1, n)

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        self.bits = []
        return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


TABLES = b"".join(jpeg.segment(0xC4, bytes((t,)) + bytes(8) + b"\xff" + bytes(7) + bytes(range(255))) for t in (0, 16))


def scan_bytes(parts, cells, coefs, first, last, high, low, restart, runs):
    """parts: component numbers; cells: (component, row, column) in order."""
    out, w, before, run, held = [], Writer(), {}, 0, []

    def flush():
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            w.bits += held
        run, held = 0, []

    for n, (p, r, c) in enumerate(cells):
        if restart and n and n % restart == 0:
            flush()
            out.append(w.bytes() + bytes((0xFF, 0xD0 + (n // restart - 1) % 8)))
            before = {}
        block = coefs[p][r, c]
        if first == 0:
            if high:
                w.put(int(block[0]) >> low & 1, 1)
            else:
                v = int(block[0]) >> low
                d = v - before.get(p, 0)
                w.symbol(abs(d).bit_length())
                w.signed(d)
                before[p] = v
            continue
        value = [int(math.copysign(abs(int(x)) >> low, x)) for x in block]
        old = [abs(int(x)) >> high if high else 0 for x in block]
        news = [k for k in range(first, last + 1) if value[k] and not old[k]]
        k, zeros, fix = first, 0, []
        for k in range(first, (news[-1] if news else first - 1) + 1):
            if old[k]:
                fix.append(abs(value[k]) & 1)
            elif not value[k]:
                zeros += 1
                if zeros == 16:
                    flush()
                    w.symbol(0xF0)
                    w.bits += fix
                    zeros, fix = 0, []
            else:
                flush()
                size = abs(value[k]).bit_length()
                w.symbol(zeros << 4 | size)
                w.signed(value[k]) if not high else w.put(value[k] > 0, 1)
                w.bits += fix
                zeros, fix = 0, []
        k = (news[-1] if news else first - 1) + 1
        if k <= last:
            held += [abs(value[j]) & 1 for j in range(k, last + 1) if old[j]]
            run += 1
            if not runs or run == 0x7FFF:
                flush()
    flush()
    return b"".join(out) + w.bytes()


def write(coefs, sampling, size, scans, restart=0, runs=True):
    quant = bytes(1 + k % 7 for k in range(64))
    frame = bytes((8,)) + size[1].to_bytes(2, "big") + size[0].to_bytes(2, "big") + bytes((len(sampling),)) + b"".join(bytes((i + 1, h << 4 | v, 0)) for i, (h, v) in enumerate(sampling))
    out = b"\xff\xd8" + jpeg.segment(0xE0, b"any") + jpeg.segment(0xDB, b"\x00" + quant) + jpeg.segment(0xC2, frame) + TABLES + jpeg.segment(0xDD, restart.to_bytes(2, "big"))
    shape = jpeg.Image(out + b"\xff\xd9")
    for parts, first, last, high, low in scans:
        own = [(shape.parts[p], 0, 0) for p in parts]
        cells = [(parts[i], r, c) for i, r, c in shape.order(own).tolist()]
        per = restart * (sum(sampling[p][0] * sampling[p][1] for p in parts) if len(parts) > 1 else 1)
        out += jpeg.segment(0xDA, bytes((len(parts),)) + b"".join(bytes((p + 1, 0)) for p in parts) + bytes((first, last, high << 4 | low)))
        out += scan_bytes(parts, cells, coefs, first, last, high, low, per, runs)
    return out + b"\xff\xd9", quant


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)], [(1, 1)] * 3])
@pytest.mark.parametrize("restart", [0, 2])
def test_progressive_scans(sampling, restart):
    rng = np.random.default_rng(restart + len(sampling))
    size, hmax, vmax = (37, 21), max(h for h, _ in sampling), max(v for _, v in sampling)
    rows, cols = -(-size[1] // (8 * vmax)), -(-size[0] // (8 * hmax))
    coefs = []
    for h, v in sampling:
        x = rng.integers(-90, 91, (rows * v, cols * h, 64)) * (rng.random((rows * v, cols * h, 64)) < rng.random((rows * v, cols * h, 1)) * 0.5)
        coefs.append(x.astype(int))
    every = tuple(range(len(sampling)))
    scans = [(every, 0, 0, 0, 1)] + [s for p in every for s in (((p,), 1, 5, 0, 2), ((p,), 6, 63, 0, 2), ((p,), 1, 63, 2, 1))] + [(every, 0, 0, 1, 0)] + [((p,), 1, 63, 1, 0) for p in every]
    data, quant = write(coefs, sampling, size, scans, restart, runs=True)
    image = jpeg.Image(data)
    for p, want, (h, v) in zip(image.parts, coefs, sampling, strict=True):
        assert (p.coefs[: p.high, : p.wide] == want[: p.high, : p.wide])[:, :, 1:].all()
        assert (p.coefs[:, :, 0] == want[:, :, 0]).all()
    # samples against the transform's definition, chroma repeated
    x = np.arange(8)
    planes = []
    for p in image.parts:
        plane = np.zeros((p.coefs.shape[0] * 8, p.coefs.shape[1] * 8))
        for r in range(p.coefs.shape[0]):
            for c in range(p.coefs.shape[1]):
                f = np.zeros(64)
                f[jpeg.ZIGZAG] = p.coefs[r, c] * np.frombuffer(quant, np.uint8)
                a = np.array([[math.cos((2 * i + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for i in range(8)])
                plane[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] = a @ f.reshape(8, 8) @ a.T + 128
        planes.append(np.clip(np.round(plane), 0, 255).repeat(vmax // p.v, 0).repeat(hmax // p.h, 1)[: size[1], : size[0]])
    if len(planes) == 3:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    else:
        planes *= 3
    assert np.abs(image.rgb().astype(float) - np.clip(np.stack(planes, 2), 0, 255)).max() <= 3
    assert len(x) == 8 and image.rgb().shape == (size[1], size[0], 3)


def test_payload_in_any_bytes():
    rng = random.Random(1)
    for n in (1, 2, 3, 4, 7, 50):
        for payload in (rng.randbytes(192 * n), bytes(192 * n), b"\xff" * 192 * n, b"\x80\x7f" * 96 * n):
            image = jpeg.Image(jpeg.encode_payload(payload))
            assert jpeg.payload_of(image) == payload
    with pytest.raises(ValueError):
        jpeg.encode_payload(b"x")


def test_fixed_places_agree_with_bit_by_bit(monkeypatch):
    data = jpeg.encode_payload(random.Random(2).randbytes(192 * 9))
    fast = jpeg.Image(data)
    table = jpeg.code_table
    monkeypatch.setattr(jpeg, "code_table", lambda *a: (*table(*a)[:2], None, *table(*a)[3:]))
    slow = jpeg.Image(data)
    assert all((a.coefs == b.coefs).all() for a, b in zip(fast.parts, slow.parts, strict=True))


def test_damage_raises():
    data = jpeg.encode_payload(random.Random(3).randbytes(192 * 4))
    for cut in (0, 1, 30, 200, 600, len(data) - 2):
        with pytest.raises(jpeg.Broken):
            jpeg.Image(data[:cut])


def plain_tensor(payload):
    """The tensor straight from the payload's bytes, without the file: blocks to squares, the transform by its definition in
    units of 2^-12, chroma pixel by pixel, colours by fixed-point factors."""
    coefs = [b if b >= 128 else b - 255 for b in payload]
    squares = -(-len(coefs) // 384)
    wide = math.isqrt(squares - 1) + 1
    high = -(-squares // wide)
    coefs += [32 - 255] * (high * wide * 384 - len(coefs))
    table = [[round(4096 * math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2) for u in range(8)] for x in range(8)]
    place = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))

    def block(n):
        grid = [0] * 64
        for k, c in enumerate(coefs[64 * n : 64 * n + 64]):
            grid[place[k]] = c
        half = [[sum(grid[8 * v + u] * table[x][u] for u in range(8)) for x in range(8)] for v in range(8)]
        return [[min(255, max(0, (sum(half[v][x] * table[y][v] for v in range(8)) + (1 << 23) >> 24) + 128)) for x in range(8)] for y in range(8)]

    out = np.zeros((16 * high, 16 * wide, 3), np.uint8)
    for s in range(high * wide):
        six = [block(6 * s + i) for i in range(6)]
        for y in range(16):
            for x in range(16):
                luma = six[2 * (y // 8) + x // 8][y % 8][x % 8]
                cb, cr = (six[4 + i][y // 2][x // 2] - 128 for i in (0, 1))
                rgb = (luma + (91881 * cr + 32768 >> 16), luma - (22554 * cb + 46802 * cr + 32768 >> 16), luma + (116130 * cb + 32768 >> 16))
                out[16 * (s // wide) + y, 16 * (s % wide) + x] = [min(255, max(0, v)) for v in rgb]
    return out


def agree(rows, texts):
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = jpeg.encode_payload(payload)
        if len(payload) < 4000:
            tensor = plain_tensor(payload)
            assert (r["rgb_shape"], r["rgb_bytes"], r["rgb_crc32"]) == (list(tensor.shape), tensor.size, zlib.crc32(tensor.tobytes()))
            sums = [int(x) for x in tensor.reshape(-1, 3).sum(0, dtype=np.int64)]
            assert r["feature"] == ":".join(map(str, (tensor.shape[1], tensor.shape[0], *sums, int(np.abs(np.diff(tensor.astype(int), axis=1)).sum()), zlib.crc32(tensor.tobytes()))))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), jpeg.feature(jpeg.Image(media).rgb()))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op6_progressive_jpeg(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    agree(rows, texts)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "é" * 100), (5, "long " * 100_000), (6, "y" * 192)]
    df = spark.createDataFrame([(t, d, b"z", 1) for d, t in rows], "text string, doc_id long, media binary, n_bytes int")
    out = jpeg.read(jpeg.store(df)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], len(r["payload"])) for r in out) == sorted((str(d), len((t or "").encode()), max(192, -(-len((t or "").encode()) // 192) * 192)) for d, t in rows)
    assert all(len(r["rgb"]) == 3 * r["width"] * r["height"] for r in out)
    assert len({r["feature"] for r in out if r["doc_id"] == 3}) == 1
    assert jpeg.read(jpeg.store(df.limit(0))).count() == 0
