"""Pictures as arrays: PNG decoding and encoding, resampling, shares of differing pixels, in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .batches import pieces

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The seven passes of an interlaced picture: first column and row, steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Lobes of the resampling window; bits of its weights, which are whole numbers.
LOBES, WEIGHT_BITS = 3, 22
#: What a picture that can't be read raises; so many rows are inverted pixel by pixel together, fewer byte by byte.
UNREADABLE, TOGETHER = (ValueError, zlib.error, struct.error), 16


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and data of each chunk; a wrong checksum or end is an error."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at = 8
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8].ljust(8, b"\0"))
        data = png[at + 8 : at + 8 + size]
        if png[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} is broken")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("the end is missing")


def _along(kind: int, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows (rows x pixels x samples) of filter 3 or 4, inverted pixel by pixel for all rows at once."""
    now, up = lines.transpose(1, 0, 2).astype(np.int16), above.transpose(1, 0, 2).astype(np.int16)
    left = corner = np.zeros(now.shape[1:], np.int16)
    for x in range(len(now)):
        if kind == 3:
            guess = (left + up[x]) >> 1
        else:
            over, beside = up[x] - corner, left - corner
            a, b, k = abs(over), abs(beside), abs(over + beside)
            guess = np.where((a <= b) & (a <= k), left, np.where(b <= k, up[x], corner))
        left = now[x] = (now[x] + guess) & 255
        corner = up[x]
    return now.transpose(1, 0, 2).astype(np.uint8)


def _byte_by_byte(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One row of filter 3 or 4, inverted; for few rows this is the faster way."""
    now, up = bytearray(line.tobytes()), above.tobytes()
    for x in range(len(now)):
        left = now[x - step] if x >= step else 0
        if kind == 3:
            guess = (left + up[x]) >> 1
        else:
            corner = up[x - step] if x >= step else 0
            a, b, k = abs(up[x] - corner), abs(left - corner), abs(left + up[x] - 2 * corner)
            guess = left if a <= b and a <= k else up[x] if b <= k else corner
        now[x] = now[x] + guess & 255
    return np.frombuffer(bytes(now), np.uint8)


def _inverted(kinds: np.ndarray, lines: np.ndarray, starts: np.ndarray, step: int) -> np.ndarray:
    """The bytes of the rows of one or many pictures, filters inverted; starts marks the first row of each picture.

    A row waits for the one above it only if its filter looks there, so the rows at one
    distance from the last that didn't are inverted together.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError(f"filter {kinds.max()} is unknown")
    rows, row_bytes = lines.shape
    out = np.zeros((rows, -(-row_bytes // step), step), np.uint8)
    flat = out.reshape(rows, -1)
    flat[:, :row_bytes] = lines
    at = np.arange(rows)
    distance = at - np.maximum.accumulate(np.where(starts | (kinds < 2), at, 0))
    order = np.lexsort((kinds, distance))
    for same in np.split(order, np.flatnonzero(np.diff(distance[order]) | np.diff(kinds[order])) + 1):
        kind = kinds[same[0]] if len(same) else 0
        if kind == 1:
            out[same] = np.cumsum(out[same], axis=1, dtype=np.uint8)
        elif kind > 1:
            above = np.where(starts[same][:, None, None], np.uint8(0), out[same - 1])
            if kind == 2:
                out[same] += above
            elif len(same) >= TOGETHER:
                out[same] = _along(kind, out[same], above)
            else:
                for y, up in zip(same, above, strict=True):
                    flat[y] = _byte_by_byte(kind, flat[y], up, step)
    return flat[:, :row_bytes]


def unfiltered(raw: bytes, rows: int, row_bytes: int, step: int) -> tuple[np.ndarray, bytes]:
    """The bytes of rows, filters inverted, and what is left of raw; step is the bytes of a whole pixel."""
    packed = _packed_rows(raw, rows, row_bytes)
    return _inverted(packed[:, 0], packed[:, 1:], np.arange(rows) == 0, step), raw[rows * (row_bytes + 1) :]


def _packed_rows(raw: bytes, rows: int, row_bytes: int) -> np.ndarray:
    if len(raw) < rows * (row_bytes + 1):
        raise ValueError("rows are missing")
    return np.frombuffer(raw, np.uint8, rows * (row_bytes + 1)).reshape(rows, row_bytes + 1)


def _read(png: bytes) -> tuple[tuple, np.ndarray | None, bytes]:
    """Header, palette and filtered rows."""
    head = palette = None
    packed = []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
    if head is None or head[3] not in _SAMPLES or head[2] not in (1, 2, 4, 8, 16):
        raise ValueError("the header is missing or unknown")
    return head, palette, zlib.decompress(b"".join(packed))


def _values(lines: np.ndarray, columns: int, head: tuple) -> np.ndarray:
    """rows x columns x samples of rows without filters."""
    depth, colour, rows = head[2], head[3], len(lines)
    samples = _SAMPLES[colour]
    if depth == 16:
        values = lines[:, ::2]
    elif depth == 8:
        values = lines
    else:
        values = np.unpackbits(lines, axis=1).reshape(rows, -1, depth)
        values = (values << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : columns * samples]
        if colour == 0:
            values = values * np.uint8(255 // ((1 << depth) - 1))
    return values.reshape(rows, columns, samples)


def _coloured(out: np.ndarray, head: tuple, palette: np.ndarray | None) -> np.ndarray:
    if head[3] == 3:
        if palette is None or (out.size and out.max() >= len(palette)):
            raise ValueError("the palette is missing or too short")
        return palette[out[:, :, 0]]
    return out[:, :, :3] if out.shape[2] >= 3 else np.repeat(out[:, :, :1], 3, axis=2)


def decode_png(png: bytes) -> np.ndarray:
    """The picture as rows x columns x 3 bytes; transparency is left out, 16-bit samples keep their high byte."""
    head, palette, raw = _read(png)
    width, height, depth, colour, _, _, interlaced = head
    samples = _SAMPLES[colour]
    out = np.zeros((height, width, samples), np.uint8)
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        columns, rows = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if columns <= 0 or rows <= 0:
            continue
        lines, raw = unfiltered(raw, rows, -(-columns * samples * depth // 8), max(1, samples * depth // 8))
        out[y0::dy, x0::dx] = _values(lines, columns, head)
    return _coloured(out, head, palette)


def decode_pngs(pngs: list[bytes | None]) -> list[np.ndarray | None]:
    """``decode_png`` of many pictures, null for none and for those that can't be read; rows of one form are inverted together."""
    out: list[np.ndarray | None] = [None] * len(pngs)
    forms: dict[tuple[int, int], list[tuple]] = {}
    for k, png in enumerate(pngs):
        if png is None:
            continue
        try:
            head, palette, raw = _read(png)
            width, height, depth, colour, _, _, interlaced = head
            if interlaced or not width or not height:
                out[k] = decode_png(png)
                continue
            row_bytes = -(-width * _SAMPLES[colour] * depth // 8)
            rows = _packed_rows(raw, height, row_bytes)
            if rows[:, 0].max() <= 4:
                forms.setdefault((row_bytes, max(1, _SAMPLES[colour] * depth // 8)), []).append((k, head, palette, rows))
        except UNREADABLE:
            continue
    for (_, step), pictures in forms.items():
        joined, ends = np.concatenate([rows for *_, rows in pictures]), np.cumsum([len(rows) for *_, rows in pictures])
        starts = np.zeros(len(joined), bool)
        starts[[0, *ends[:-1]]] = True
        lines = _inverted(joined[:, 0], joined[:, 1:], starts, step)
        for (k, head, palette, _), own in zip(pictures, np.split(lines, ends[:-1]), strict=True):
            try:
                out[k] = _coloured(_values(own, head[0], head), head, palette)
            except UNREADABLE:
                continue
    return out


def _guess(kind: int, lines: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What a filter takes from rows of three samples a pixel."""
    shifted = lambda rows: np.hstack([np.zeros_like(rows[:, :3]), rows[:, :-3]])
    if kind == 0:
        return np.zeros_like(lines)
    if kind == 1:
        return shifted(lines)
    if kind == 2:
        return above
    left, up = shifted(lines).astype(np.int16), above.astype(np.int16)
    if kind == 3:
        return ((left + up) >> 1).astype(np.uint8)
    corner = shifted(up)
    over, beside = up - corner, left - corner
    a, b, k = abs(over), abs(beside), abs(over + beside)
    return np.where((a <= b) & (a <= k), left, np.where(b <= k, up, corner)).astype(np.uint8)


def encode_png(pixels: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """rows x columns x 3 bytes as a PNG; the rows take the filters in turn."""
    height, width, _ = pixels.shape
    lines = pixels.reshape(height, width * 3)
    above = np.vstack([np.zeros_like(lines[:1]), lines[:-1]])
    rows = np.zeros((height, width * 3 + 1), np.uint8)
    for place, kind in enumerate(filters):
        mine = slice(place, None, len(filters))
        rows[mine, 0] = kind
        rows[mine, 1:] = lines[mine] - _guess(kind, lines[mine], above[mine])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def weights(size: int, target: int) -> np.ndarray:
    """target x size whole weights of a windowed sinc, each row adding up to about 2**WEIGHT_BITS."""
    scale = size / target
    stretch = max(scale, 1.0)
    reach = LOBES * stretch
    out = np.zeros((target, size))
    for i in range(target):
        centre = (i + 0.5) * scale
        first, last = max(0, int(centre - reach + 0.5)), min(size, int(centre + reach + 0.5))
        x = (np.arange(first, last) - centre + 0.5) / stretch
        w = np.where(abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
        out[i, first:last] = w / w.sum()
    return np.trunc(out * (1 << WEIGHT_BITS) + np.copysign(0.5, out))


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The picture at another size: columns first, then rows, each rounded to bytes."""
    half = 1 << (WEIGHT_BITS - 1)
    rounded = lambda sums: np.clip((sums.astype(np.int64) + half) >> WEIGHT_BITS, 0, 255).astype(np.uint8)
    now = pixels
    if width != now.shape[1]:
        now = rounded(np.einsum("ox,yxc->yoc", weights(now.shape[1], width), now.astype(np.float64), optimize=True))
    if height != now.shape[0]:
        now = rounded(np.einsum("oy,yxc->oxc", weights(now.shape[0], height), now.astype(np.float64), optimize=True))
    return now


def _differing(a: np.ndarray, b: np.ndarray) -> float:
    if a.size == 0:
        return 0.0
    if b.size == 0:
        return 100.0
    return float((a != resized(b, a.shape[1], a.shape[0])).any(axis=2).mean() * 100)


def differences(now: list[bytes | None], before: list[bytes | None]) -> list[float | None]:
    """Percent of the pixels of each PNG that differ from another, which is resized to its size; -1 without another, null if one can't be read."""
    pairs = zip(now, before, decode_pngs(now), decode_pngs(before), strict=True)
    return [None if n is None else -1.0 if p is None else None if a is None or b is None else _differing(a, b) for n, p, a, b in pairs]


def difference(now: bytes | None, before: bytes | None) -> float | None:
    """``differences`` of one pair."""
    return differences([now], [before])[0]


def png_differences(now: DataFrame, before: DataFrame, key: str = "name", png: str = "png") -> DataFrame:
    """key, difference of each current picture (key, png) with the one of its name before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            yield pd.DataFrame({key: batch[key], "difference": pd.array(differences(list(batch["now"]), list(batch["before"])), dtype="Float64")})

    both = now.select(key, now[png].alias("now")).join(before.select(key, before[png].alias("before")), key, "left")
    return both.mapInPandas(run, f"{key} {now.schema[key].dataType.simpleString()}, difference double")
