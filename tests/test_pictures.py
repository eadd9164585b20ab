"""PNGs against plain loops, resampling against a direct two-dimensional sum."""

import math
import random
import struct
import zlib

import numpy as np
import pytest

from webloom.functions import pictures


def png(width, height, depth, colour, rows, palette=b"", interlaced=0):
    """rows: the filtered lines with their filter bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return pictures.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)[:5]) + chunk(b"IDAT", zlib.compress(rows)[5:]) + chunk(b"IEND", b"")


def plain_rows(raw, rows, row_bytes, step):
    """Filters inverted byte by byte."""
    done = [[0] * row_bytes]
    for y in range(rows):
        kind, line, now = raw[y * (row_bytes + 1)], raw[y * (row_bytes + 1) + 1 : (y + 1) * (row_bytes + 1)], []
        for x in range(row_bytes):
            a, b, c = now[x - step] if x >= step else 0, done[-1][x], done[-1][x - step] if x >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            now.append((line[x] + [0, a, b, (a + b) // 2, near][kind]) % 256)
        done.append(now)
    return done[1:]


@pytest.mark.parametrize("colour, depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_pixels_are_those_of_plain_loops(colour, depth):
    draw = random.Random(colour * 100 + depth)
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    for width, height in ((1, 1), (7, 5), (16, 9)):
        row_bytes = -(-width * samples * depth // 8)
        raw = b"".join(bytes([draw.randrange(5)]) + bytes(draw.randrange(256) for _ in range(row_bytes)) for _ in range(height))
        palette = bytes(draw.randrange(256) for _ in range(3 * 2**depth)) if colour == 3 else b""
        lines = plain_rows(raw, height, row_bytes, max(1, samples * depth // 8))
        got = pictures.decode_png(png(width, height, depth, colour, raw, palette))
        for y in range(height):
            bits = "".join(f"{b:08b}" for b in lines[y])
            values = [int(bits[k * depth : (k + 1) * depth], 2) for k in range(width * samples)]
            for x in range(width):
                v = values[x * samples : (x + 1) * samples]
                if colour == 3:
                    want = list(palette[3 * v[0] : 3 * v[0] + 3])
                else:
                    v = [s >> 8 if depth == 16 else s * (255 // (2**depth - 1)) for s in v]
                    want = v[:3] if samples >= 3 else [v[0]] * 3
                assert got[y, x].tolist() == want


def test_interlaced_pictures_are_put_together():
    draw = random.Random(1)
    width, height = 11, 13
    whole = np.array([[[draw.randrange(256) for _ in range(3)] for _ in range(width)] for _ in range(height)], np.uint8)
    raw = b""
    for x0, y0, dx, dy in pictures._PASSES:
        part = whole[y0::dy, x0::dx]
        raw += b"".join(b"\0" + row.tobytes() for row in part) if part.size else b""
    assert (pictures.decode_png(png(width, height, 8, 2, raw, interlaced=1)) == whole).all()


def test_encoding_round_trips_with_every_filter():
    rng = np.random.default_rng(2)
    for shape in ((1, 1, 3), (9, 4, 3), (20, 33, 3)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        for filters in ((0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)):
            assert (pictures.decode_png(pictures.encode_png(a, filters)) == a).all()


def window(x):
    sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
    return sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0


@pytest.mark.parametrize("size, target", [((8, 6), (5, 9)), ((5, 9), (8, 6)), ((12, 12), (3, 30))])
def test_resizing_is_the_two_dimensional_sum(size, target):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (*size, 3)).astype(np.uint8)
    got = pictures.resized(a, target[1], target[0]).astype(float)

    def shares(n, m, i):
        scale, stretch = n / m, max(n / m, 1)
        w = {k: window((k + 0.5 - (i + 0.5) * scale) / stretch) for k in range(n)}
        return {k: v / sum(w.values()) for k, v in w.items()}

    for y in range(target[0]):
        for x in range(target[1]):
            wy, wx = shares(size[0], target[0], y), shares(size[1], target[1], x)
            for c in range(3):
                row = {j: min(255, max(0, sum(wx[i] * a[j, i, c] for i in wx))) for j in wy}
                want = min(255, max(0, sum(wy[j] * row[j] for j in wy)))
                assert abs(got[y, x, c] - want) <= 1.5


def test_differences(spark):
    a = np.zeros((4, 4, 3), np.uint8)
    b = a.copy()
    b[0, 0, 1] = 9
    flat = np.full((8, 2, 3), 7, np.uint8)
    frame = lambda **p: spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in p.items()], "name string, png binary")
    e = pictures.encode_png
    got = pictures.png_differences(frame(same=e(a), one=e(b), new=e(a), size=e(np.full((4, 4, 3), 7, np.uint8)), broken=e(a)[:-9], none=None, empty=e(a[:0])), frame(same=e(a), one=e(a), size=e(flat), broken=e(a), none=e(a), empty=e(a)))
    assert {r["name"]: r["difference"] for r in got.collect()} == {"same": 0.0, "one": 6.25, "new": -1.0, "size": 0.0, "broken": None, "none": None, "empty": 0.0}
    for bad in (b"", b"GIF89a", e(a)[:20], e(a).replace(b"IDAT", b"IDAX")):
        with pytest.raises(ValueError):
            pictures.decode_png(bad)
