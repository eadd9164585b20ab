"""Lossless WebP (VP8L): a complete decoder and an encoder.

The decoder reads every feature of the format: simple and normal prefix codes,
meta prefix groups, back-references, the colour cache, and the predictor,
cross-colour, subtract-green and palette (colour-indexing) transforms.  Images
with one group of codes and one coded channel, as ``encode_samples`` writes them,
are decoded along a chain of code places that is worked out for all bits at once;
back-references are copied as slices.  All others go pixel by pixel.

``encode_samples`` writes a palette's indices in codes of one length, which unpack
fastest, unless prefix codes of fitting lengths with back-references save a good
part of that: then it takes a palette for up to 16 values and subtract-green for
more, and by entropy the values or their residuals under a predictor (left or top).
``encode`` takes any transforms, the colour cache included, pixel by pixel.

Pixels are numpy uint32 ARGB.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
LARGEST_SIDE = 1 << 14

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
MOST_COPIED, MOST_BACK = 4096, (1 << 20) - 120

#: Images are written in fitting codes where these are expected to take at most this share of codes of one length.
SHARE = 0.6
#: Least length of a back-reference that encode_samples looks for; bytes of image data that are decoded at a time.
LEAST_COPIED = 16
WINDOW = 1 << 15
#: Whether images of one coded channel are decoded by whole arrays; tests compare both ways.
BY_ARRAYS = True


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if self.at + n > 8 * len(self.data):
            raise ValueError("the image data end early")
        value = int.from_bytes(self.data[first:last], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek15(self) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7)) & 0x7FFF


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def reverse_bits(values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(values)
    for k in range(n):
        out |= ((values >> k) & 1) << (n - 1 - k)
    return out


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as written, bits); a lone symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, s in sorted(used):
        code <<= n - last
        out[s] = (_REVERSED[code & 255] << 8 | _REVERSED[code >> 8 & 255]) >> 16 - n, n
        code, last = code + 1, n
    return out


_REVERSED = [int(f"{k:08b}"[::-1], 2) for k in range(256)]


class Prefix:
    """Decodes symbols; whole codes are looked up by as many bits as the longest has."""

    def __init__(self, lengths: list[int], lone: int | None = None):
        self.lengths, self.lone = lengths, lone
        if lone is not None:
            return
        codes = canonical(lengths)
        if not codes:
            raise ValueError("a prefix code without symbols")
        self.lone = next(iter(codes)) if len(codes) == 1 else None
        if self.lone is None and sum(2.0**-n for _, n in codes.values()) != 1:
            raise ValueError("an incomplete prefix code")
        self.table = None
        self.codes = codes

    def read(self, r: BitReader) -> int:
        if self.lone is not None:
            return self.lone
        if self.table is None:
            most = max(n for _, n in self.codes.values())
            self.table, self.mask = [(0, 0)] * (1 << most), (1 << most) - 1
            for s, (code, n) in self.codes.items():
                self.table[code :: 1 << n] = [(s, n)] * (1 << (most - n))
        s, n = self.table[r.peek15() & self.mask]
        r.at += n
        return s

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and code length by the next bits, as many as the longest code has."""
        if self.lone is not None:
            return np.full(1, self.lone, np.int32), np.zeros(1, np.int32)
        most = max(n for _, n in self.codes.values())
        symbols, lengths = np.zeros(1 << most, np.int32), np.zeros(1 << most, np.int32)
        for s, (code, n) in self.codes.items():
            symbols[code :: 1 << n] = s
            lengths[code :: 1 << n] = n
        return symbols, lengths

    def flat_bits(self) -> int | None:
        """The length of all codes if they have one and are symbols 0, 1, ... in order; 0 for symbol 0 alone."""
        if self.lone is not None:
            return 0 if self.lone == 0 else None
        n = self.lengths[0]
        return n if n and len(self.codes) == 1 << n and all(self.lengths[s] == n for s in range(1 << n)) else None


def _read_prefix(r: BitReader, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if r.bits(1):
        two, wide = r.bits(1), r.bits(1)
        first = r.bits(8 if wide else 1)
        if not two:
            return Prefix(lengths, first)
        lengths[first] = 1
        lengths[r.bits(8)] = 1
        return Prefix(lengths)
    of_lengths = [0] * 19
    for k in range(4 + r.bits(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = r.bits(3)
    code = Prefix(of_lengths)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value, n = (before, 3 + r.bits(2)) if s == 16 else (0, 3 + r.bits(3)) if s == 17 else (0, 11 + r.bits(7))
            if at + n > alphabet:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    return Prefix(lengths)


def _prefixed(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.bits(extra) + 1


def _copy_place(r: BitReader, symbol: int, distance: Prefix, width: int) -> tuple[int, int]:
    """Length and distance of a back-reference whose length symbol was read."""
    length = _prefixed(r, symbol - 256)
    code = _prefixed(r, distance.read(r))
    if code > 120:
        return length, code - 120
    dx, dy = NEAR_DISTANCES[code - 1]
    return length, max(1, dx + dy * width)


def _read_channel(r: BitReader, green: Prefix, distance: Prefix, total: int, width: int) -> np.ndarray:
    """The green values of an image whose other channels take no bits.

    For every bit of a window of the data: which symbol a code that begins there
    gives, and where the next begins.  The literals of a window are the places on
    the chain from the first; a back-reference or the window's end interrupts it.
    """
    symbols, lengths = green.arrays()
    out, at = np.zeros(total, np.uint8), 0
    while at < total:
        first = r.at >> 3
        part = np.frombuffer(r.data, np.uint8, offset=first, count=min(WINDOW, len(r.data) - first))
        bits, last = 8 * len(part), first + len(part) == len(r.data)
        padded = np.concatenate([part, np.zeros(2, np.uint8)]).astype(np.int32)
        words = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
        ahead = ((words[:, None] >> np.arange(8, dtype=np.int32)) & (len(symbols) - 1)).ravel()
        found = symbols[ahead]
        following = np.arange(bits, dtype=np.int32) + lengths[ahead]
        following[following > bits] = -2
        following[found >= 256] = -1
        if not last:
            following[max(0, bits - 15) :] = -2
        chain = [*following.tolist(), -2]
        p = r.at - 8 * first
        while at < total:
            places: list[int] = []
            add, now, left = places.append, chain[p], total - at
            while now >= 0 and left:
                add(p)
                p, left = now, left - 1
                now = chain[p]
            if places:
                out[at : at + len(places)] = found[places]
                at += len(places)
            r.at = 8 * first + p
            if at == total or now == -2:
                break
            r.at += int(lengths[ahead[p]])
            length, back = _copy_place(r, int(found[p]), distance, width)
            if back > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            out[at : at + length] = out[at - back : at - back + length] if back >= length else np.resize(out[at - back : at], length)
            at += length
            p = r.at - 8 * first
            if p >= len(chain):
                break
        if at < total and last and (r.at - 8 * first >= bits or chain[r.at - 8 * first] == -2):
            raise ValueError("the image data end early")
    return out


def _read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.bits(4) if r.bits(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups_at, block, block_width = None, 0, 0
    if main and r.bits(1):
        block = r.bits(3) + 2
        block_width = -(-width >> block)
        entropy = _read_image(r, block_width, -(-height >> block), False)
        groups_at = ((entropy >> 8) & 0xFFFF).tolist()
    count = max(groups_at) + 1 if groups_at else 1
    groups = [[_read_prefix(r, n) for n in (280 + len(cache), 256, 256, 256, 40)] for _ in range(count)]
    total = width * height
    green, red, blue, alpha, _ = groups[0]
    flat = green.flat_bits() if BY_ARRAYS else None
    if count == 1 and not cache and flat is not None and flat <= 8 and None not in (red.lone, blue.lone, alpha.lone):
        rest = alpha.lone << 24 | red.lone << 16 | blue.lone
        if flat == 0:
            return np.full(total, rest, np.uint32)
        if r.at + flat * total > 8 * len(r.data):
            raise ValueError("the image data end early")
        first = r.at >> 3
        bits = np.unpackbits(np.frombuffer(r.data, np.uint8, offset=first, count=((r.at + flat * total + 7) >> 3) - first), bitorder="little")[r.at & 7 :][: flat * total]
        r.at += flat * total
        value = np.zeros(total, np.uint32)
        for k in range(flat):  # a code stands with its highest bit first
            value |= bits[k::flat].astype(np.uint32) << np.uint32(flat - 1 - k)
        return value << np.uint32(8) | np.uint32(rest)
    if BY_ARRAYS and count == 1 and not cache and green.lone is None and None not in (red.lone, blue.lone, alpha.lone):
        rest = alpha.lone << 24 | red.lone << 16 | blue.lone
        return _read_channel(r, green, groups[0][4], total, width).astype(np.uint32) << np.uint32(8) | np.uint32(rest)
    out = [0] * total
    at, cached = 0, 0
    while at < total:
        group = groups[groups_at[(at // width >> block) * block_width + (at % width >> block)]] if groups_at else groups[0]
        s = group[0].read(r)
        if s < 256:
            red = group[1].read(r)
            blue = group[2].read(r)
            out[at] = group[3].read(r) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length, back = _copy_place(r, s, group[4], width)
            if back > at or at + length > total:
                raise ValueError("a back-reference outside the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            for p in out[cached:at]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _bytes_of(p: np.ndarray) -> np.ndarray:
    return p.astype("<u4").view(np.uint8).reshape(*p.shape, 4)  # blue, green, red, alpha


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF) + (b & 0xFF00FF) & 0xFF00FF) | ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00)


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamped(f, *pixels: int) -> int:
    out = 0
    for shift in (0, 8, 16, 24):
        out |= min(255, max(0, f(*((p >> shift) & 255 for p in pixels)))) << shift
    return out


def _select(left: int, top: int, corner: int) -> int:
    to_left = to_top = 0
    for shift in (0, 8, 16, 24):
        a, b, c = (left >> shift) & 255, (top >> shift) & 255, (corner >> shift) & 255
        to_left, to_top = to_left + abs(b - c), to_top + abs(a - c)
    return left if to_left < to_top else top


def predicted(mode: int, x: int, y: int, width: int, out: list[int]) -> int:
    """The predictor's value for pixel (x, y) from the pixels before it."""
    at = y * width + x
    if y == 0:
        return 0xFF000000 if x == 0 else out[at - 1]
    t = out[at - width]
    if x == 0:
        return t
    left, tl, tr = out[at - 1], out[at - width - 1], out[at - width + 1]
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode == 11:
        return _select(left, t, tl)
    if mode == 12:
        return _clamped(lambda a, b, c: a + b - c, left, t, tl)
    if mode == 13:
        return _clamped(lambda a, b: a + int((a - b) / 2), _mean(left, t), tl)
    simple = {1: left, 2: t, 3: tr, 4: tl}
    if mode in simple:
        return simple[mode]
    return {5: lambda: _mean(_mean(left, tr), t), 6: lambda: _mean(left, tl), 7: lambda: _mean(left, t), 8: lambda: _mean(tl, t), 9: lambda: _mean(t, tr), 10: lambda: _mean(_mean(left, tl), _mean(t, tr))}[mode]()


def _undo_one_side(p: np.ndarray, width: int, height: int, mode: int) -> np.ndarray:
    """The predictor by the left pixel (1) or the top one (2) undone by running sums; the first row goes by left, the first column by top, in both."""
    diff = _bytes_of(p).reshape(height, width, 4).copy()
    diff[0, 0, 3] = (int(diff[0, 0, 3]) + 255) & 255  # the first pixel is told from opaque black
    if mode == 1:
        diff[:, 0] = np.cumsum(diff[:, 0], axis=0, dtype=np.uint8)
        out = np.cumsum(diff, axis=1, dtype=np.uint8)
    else:
        diff[0] = np.cumsum(diff[0], axis=0, dtype=np.uint8)
        out = np.cumsum(diff, axis=0, dtype=np.uint8)
    return np.ascontiguousarray(out).view("<u4").reshape(-1).astype(np.uint32)


def _undo_predictor(p: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    diff, out, per_row = p.tolist(), [0] * len(p), -(-width >> block)
    kinds = ((modes >> 8) & 15).tolist()
    if BY_ARRAYS and {*kinds} <= {1} or {*kinds} == {2}:
        return _undo_one_side(p, width, height, kinds[0])
    for y in range(height):
        for x in range(width):
            at = y * width + x
            out[at] = _add(diff[at], predicted(kinds[(y >> block) * per_row + (x >> block)], x, y, width, out))
    return np.array(out, np.uint32)


def _cross_colour(p: np.ndarray, width: int, height: int, block: int, factors: np.ndarray, sign: int) -> np.ndarray:
    """sign 1 undoes the transform, -1 applies it."""
    per_row = -(-width >> block)
    rows, cols = np.divmod(np.arange(width * height), width)
    f = _bytes_of(factors)[(rows >> block) * per_row + (cols >> block)].view(np.int8).astype(np.int32)
    px = _bytes_of(p).astype(np.int32)
    as_signed = lambda v: ((v & 255) ^ 128) - 128
    green, red = as_signed(px[:, 1]), px[:, 2]
    new_red = red + sign * ((f[:, 0] * green) >> 5)
    true_red = new_red if sign == 1 else red
    blue = px[:, 0] + sign * (((f[:, 1] * green) >> 5) + ((f[:, 2] * as_signed(true_red)) >> 5))
    out = px.copy()
    out[:, 2], out[:, 0] = new_red & 255, blue & 255
    return np.ascontiguousarray(out.astype(np.uint8)).view("<u4").reshape(-1).astype(np.uint32)


def _green(p: np.ndarray, sign: int) -> np.ndarray:
    px = _bytes_of(p).copy()
    for channel in (0, 2):
        px[:, channel] = px[:, channel] + px[:, 1] if sign == 1 else px[:, channel] - px[:, 1]
    return px.view("<u4").reshape(-1).astype(np.uint32)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(p: np.ndarray, width: int, height: int, colours: np.ndarray) -> np.ndarray:
    bundle = _bundle_bits(len(colours))
    index = ((p >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    if bundle:
        per, bits = 1 << bundle, 8 >> bundle
        packed = index.reshape(height, -1)
        index = np.stack([(packed >> (bits * k)) & ((1 << bits) - 1) for k in range(per)], axis=2).reshape(height, -1)[:, :width].reshape(-1)
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """A WebP file with one VP8L image -> height x width ARGB pixels."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (size,) = struct.unpack_from("<I", data, 16)
    r = BitReader(data[20 : 20 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("not a VP8L image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    transforms, coded = [], width
    while r.bits(1):
        kind = r.bits(2)
        if any(kind == t[0] for t in transforms):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = r.bits(3) + 2
            transforms.append((kind, coded, block, _read_image(r, -(-coded >> block), -(-height >> block), False)))
        elif kind == PALETTE:
            steps = _bytes_of(_read_image(r, r.bits(8) + 1, 1, False))
            colours = np.cumsum(steps, axis=0, dtype=np.uint8).view("<u4").reshape(-1).astype(np.uint32)
            transforms.append((kind, coded, 0, colours))
            coded = -(-coded >> _bundle_bits(len(colours)))
        else:
            transforms.append((kind, coded, 0, None))
    p = _read_image(r, coded, height, True)
    for kind, across, block, data_of in reversed(transforms):
        if kind == PREDICTOR:
            p = _undo_predictor(p, across, height, block, data_of)
        elif kind == CROSS_COLOUR:
            p = _cross_colour(p, across, height, block, data_of, 1)
        elif kind == SUBTRACT_GREEN:
            p = _green(p, 1)
        else:
            p = _undo_palette(p, across, height, data_of)
    return p.reshape(height, width)


def _container(image: bytes) -> bytes:
    pad = b"\0" * (len(image) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(image) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(image)) + image + pad


def _put_lengths(w: BitWriter, lengths: list[int]) -> None:
    w.put(*_described(tuple(lengths)))


@lru_cache(1024)
def _described(lengths: tuple[int, ...]) -> tuple[int, int]:
    """A prefix code's description (bits, their number): simple for one symbol, else its code lengths, runs of zeros shortened."""
    w, used = BitWriter(), [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        _put_lone(w, used[0])
        return w.value, w.n
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    at = 0
    while at < len(lengths):
        run = 1
        if lengths[at] == 0:
            while at + run < len(lengths) and lengths[at + run] == 0 and run < 138:
                run += 1
        if run >= 11:
            tokens.append((18, run - 11, 7))
        elif run >= 3:
            tokens.append((17, run - 3, 3))
        else:
            run = 1
            tokens.append((lengths[at], 0, 0))
        at += run
    kinds = sorted({t[0] for t in tokens})
    own = [0] * 19
    if len(kinds) == 1:
        own[kinds[0]] = 1
    else:
        flat = (len(kinds) - 1).bit_length()
        short = (1 << flat) - len(kinds)  # so many codes may be a bit shorter
        for k, n in enumerate(kinds):
            own[n] = flat - (k < short)
    codes = canonical(own)
    w.put(0, 1)
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    w.put(n - 4, 4)
    for k in range(n):
        w.put(own[CODE_LENGTH_ORDER[k]], 3)
    w.put(0, 1)
    for symbol, extra, bits in tokens:
        w.put(*codes[symbol])
        if bits:
            w.put(extra, bits)
    return w.value, w.n


def _put_lone(w: BitWriter, symbol: int) -> None:
    w.put(0b101, 3)  # simple, one symbol, given by eight bits
    w.put(symbol, 8)


def _header(w: BitWriter, width: int, height: int) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)


def _copies(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Starts, lengths and distances of back-references, greedily from the front: to the last place of LEAST_COPIED equal values."""
    n = len(values) - LEAST_COPIED + 1
    if n <= 1:
        return [], [], []
    x = values.astype(np.uint64)
    eight = x[: len(x) - 7].copy()
    for k in range(1, 8):
        eight |= x[k : len(x) - 7 + k] << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        key = eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ eight[8 : 8 + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    candidates = np.flatnonzero(before >= 0)
    starts, lengths, distances, cursor, at = [], [], [], 0, 0
    while True:
        at = int(np.searchsorted(candidates, cursor))
        if at == len(candidates):
            return starts, lengths, distances
        i = int(candidates[at])
        j = int(before[i])
        most = min(MOST_COPIED, len(values) - i)
        unlike = np.flatnonzero(values[i : i + most] != values[j : j + most])
        length = int(unlike[0]) if len(unlike) else most
        if length < LEAST_COPIED or i - j > MOST_BACK:  # another text of the same key
            cursor = i + 1
            continue
        starts.append(i)
        lengths.append(length)
        distances.append(i - j)
        cursor = i + length


def _coded(values: np.ndarray, copies: tuple[list[int], list[int], list[int]]) -> tuple[BitWriter, np.ndarray, np.ndarray]:
    """Prefix codes and back-references for one channel: the codes' description, and the pieces of the data (value, bits), least bit first."""
    starts, lengths, distances = copies
    literal = _literals(len(values), copies)
    by_length, by_distance = [_as_prefix(n) for n in lengths], [_as_prefix(d + 120) for d in distances]
    counts = dict(enumerate(np.bincount(values[literal], minlength=256).tolist()))
    for s, _, _ in by_length:
        counts[256 + s] = counts.get(256 + s, 0) + 1
    of_distance: dict[int, int] = {}
    for s, _, _ in by_distance:
        of_distance[s] = of_distance.get(s, 0) + 1
    green, distance = _lengths_for(counts, 280), _lengths_for(of_distance, 40)
    w = BitWriter()
    _put_lengths(w, green)
    for lone in (0, 0):
        _put_lone(w, lone)
    codes, far = canonical(green), canonical(distance)
    table = np.zeros((2, 256), np.int64)
    for s, (code, n) in codes.items():
        if s < 256:
            table[:, s] = code, n
    # One piece for each literal, four for each back-reference, in the order of their places.
    place = np.flatnonzero(literal)
    pieces = [(4 * place, table[0][values[place]], table[1][values[place]])]
    if starts:
        first = 4 * np.array(starts, np.int64)
        parts = ([codes[256 + s] for s, _, _ in by_length], [(e, n) for _, e, n in by_length], [far[s] for s, _, _ in by_distance], [(e, n) for _, e, n in by_distance])
        pieces += [(first + k, *np.array(part, np.int64).T) for k, part in enumerate(parts)]
    order = np.argsort(np.concatenate([x[0] for x in pieces]), kind="stable")
    return (w, distance), np.concatenate([x[1] for x in pieces])[order], np.concatenate([x[2] for x in pieces])[order]


def _literals(n: int, copies: tuple[list[int], list[int], list[int]]) -> np.ndarray:
    """Which of n places no back-reference covers."""
    out = np.ones(n, bool)
    for i, length in zip(copies[0], copies[1]):
        out[i : i + length] = False
    return out


def _expected(values: np.ndarray, copies: tuple[list[int], list[int], list[int]]) -> float:
    """About how many bits the values take in fitting codes with these back-references (30 bits each) and a table of codes."""
    left = values[_literals(len(values), copies)]
    return 300 + 30 * len(copies[0]) + (_entropy(left) if len(left) else 0.0)


def _put_flat(w: BitWriter, bits: int) -> None:
    """The prefix code of symbols 0 .. 2**bits - 1, all of this length."""
    w.put(0, 1)
    n = max(4, 1 + CODE_LENGTH_ORDER.index(bits))
    w.put(n - 4, 4)
    for k in range(n):
        w.put(int(CODE_LENGTH_ORDER[k] == bits), 3)
    w.put(1, 1)  # how many lengths follow, each of no bits
    w.put(3, 3)
    w.put((1 << bits) - 2, 8)


def _bits_of_pieces(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The pieces' bits in a row."""
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    return ((np.repeat(values, bits) >> (np.arange(total) - np.repeat(ends - bits, bits))) & 1).astype(np.uint8)


def _entropy(values: np.ndarray) -> float:
    """Bits that the values take in a code of their own, about."""
    counts = np.bincount(values, minlength=256)
    counts = counts[counts > 0]
    return float(-(counts * np.log2(counts / len(values))).sum())


def _residual(index: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What a predictor by the left (1) or the top (2) leaves of one channel."""
    rows = index.reshape(-1, width)
    out = rows.copy()
    if mode == 1:
        out[:, 1:] -= rows[:, :-1]
        out[1:, 0] -= rows[:-1, 0]
    else:
        out[1:] -= rows[:-1]
        out[0, 1:] -= rows[0, :-1]
    return out.reshape(-1)


def _put_palette(w: BitWriter, present: np.ndarray) -> None:
    """The palette transform for these grey values."""
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(present) - 1, 8)
    steps = np.diff(present, prepend=0).tolist()  # grey: the same step in each colour, alpha 255 once
    w.put(0, 1)
    lengths = _lengths_for(Counter(steps), 280)
    for alphabet in (280, 256, 256):
        _put_lengths(w, lengths[:alphabet])
    codes = canonical(lengths)
    alpha = _lengths_for({255: 1, 0: len(steps) - 1}, 256)
    _put_lengths(w, alpha)
    of_alpha = canonical(alpha)
    _put_lone(w, 0)
    for k, s in enumerate(steps):
        for _ in range(3):
            w.put(*codes[s])
        w.put(*of_alpha[255 if k == 0 else 0])


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """Grey 8-bit samples without loss, in codes of one length or, where that saves enough, in fitting ones with back-references."""
    height, coded = len(samples) // width, width
    present = _used(samples)
    lookup = np.zeros(256, np.uint8)
    lookup[present] = np.arange(len(present))
    index, flat = lookup[samples], max(1, int(len(present) - 1).bit_length())
    if bundle := _bundle_bits(len(present)):
        per, each = 1 << bundle, 8 >> bundle
        coded, flat = -(-width // per), 8
        padded = np.zeros((height, coded * per), np.uint8)
        padded[:, :width] = index.reshape(height, width)
        index = sum((padded[:, k::per] << (each * k)).astype(np.uint8) for k in range(per)).astype(np.uint8).reshape(-1)
    w = BitWriter()
    _header(w, width, height)
    # The indices themselves, or what a predictor leaves of them; its copies are looked for only where it is better without any.
    plain = _entropy(index)
    mode, left = min(((m, _residual(index, coded, m)) for m in (1, 2)), key=lambda x: _entropy(x[1]))
    values, mode = (left, mode) if _entropy(left) < plain - 200 else (index, 0)
    copies = _copies(values)
    if _expected(values, copies) < SHARE * flat * len(index):
        body = _put_fitting(w, samples if not bundle and not mode else values, present, bundle, mode, coded, height, copies)
    else:
        _put_palette(w, present)
        w.put(0, 3)  # no further transform, no colour cache, one group of codes
        _put_flat(w, flat)
        for lone in (0, 0, 255, 0):
            _put_lone(w, lone)
        body = np.unpackbits(index[:, None], axis=1, bitorder="big")[:, 8 - flat :].reshape(-1)
    head = np.unpackbits(np.frombuffer(w.bytes(), np.uint8), bitorder="little")[: w.n]
    return _container(np.packbits(np.concatenate([head, body]), bitorder="little").tobytes())


def _put_fitting(w: BitWriter, values: np.ndarray, present: np.ndarray, bundle: int, mode: int, coded: int, height: int, copies: tuple[list[int], list[int], list[int]]) -> np.ndarray:
    """Transforms, codes and (returned) data bits: grey samples by subtract-green, which leaves the green channel alone, or palette indices, under a predictor if there is a mode."""
    if bundle or mode:
        _put_palette(w, present)
    else:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
    if mode:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(7, 3)  # blocks of 512 pixels
        _put_image(w, np.full((-(-coded >> 9)) * (-(-height >> 9)), mode << 8, np.uint32), False)
    w.put(0, 3)  # no further transform, no colour cache, one group of codes
    (codes, distance), data, bits = _coded(values, copies)
    w.value |= codes.value << w.n
    w.n += codes.n
    _put_lone(w, 0 if mode else 255)
    _put_lengths(w, distance)
    return _bits_of_pieces(data, bits)


def _used(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(values, minlength=256))


def _lengths_for(counts: dict[int, int], alphabet: int) -> list[int]:
    """Huffman code lengths of at most 15; counts are halved until they fit."""
    lengths = [0] * alphabet
    counts = {s: c for s, c in counts.items() if c} or {0: 1}
    if len(counts) == 1:
        lengths[next(iter(counts))] = 1
        return lengths
    while True:
        heap = [(c, s, [s]) for s, c in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= 15:
            break
        counts = {s: (c + 1) // 2 for s, c in counts.items()}
    for s, n in depth.items():
        lengths[s] = n
    return lengths


def _as_prefix(value: int) -> tuple[int, int, int]:
    """value from 1 -> (symbol, extra bits, their number)."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _put_image(w: BitWriter, p: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False) -> None:
    """Pixels with Huffman codes, back-references to the last place of four equal pixels, and a colour cache."""
    px, tokens, at = p.tolist(), [], 0
    cache: dict[int, int] = {}
    last: dict[tuple, int] = {}

    def note(k: int) -> None:
        if references and k + 4 <= len(px):
            last[tuple(px[k : k + 4])] = k
        if cache_bits:
            cache[(CACHE_MULTIPLIER * px[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[k]

    while at < len(px):
        from_ = last.get(tuple(px[at : at + 4])) if references else None
        slot = (CACHE_MULTIPLIER * px[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        n = 1
        if from_ is not None:
            n = 4
            while at + n < len(px) and n < 4096 and px[from_ + n] == px[at + n]:
                n += 1
            tokens.append(("copy", _as_prefix(n), _as_prefix(at - from_ + 120)))
        elif cache_bits and cache.get(slot) == px[at]:
            tokens.append(("cache", 280 + slot))
        else:
            tokens.append(("pixel", px[at]))
        for k in range(at, at + n):
            note(k)
        at += n
    counts: list[dict[int, int]] = [{}, {}, {}, {}, {}]

    def tally(k: int, s: int) -> None:
        counts[k][s] = counts[k].get(s, 0) + 1

    for t in tokens:
        if t[0] == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                tally(k, (t[1] >> shift) & 255)
        elif t[0] == "copy":
            tally(0, 256 + t[1][0])
            tally(4, t[2][0])
        else:
            tally(0, t[1])
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    codes = []
    for c, alphabet in zip(counts, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)):
        lengths = _lengths_for(c, alphabet)
        _put_lengths(w, lengths)
        codes.append(canonical(lengths))
    for t in tokens:
        if t[0] == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                w.put(*codes[k][(t[1] >> shift) & 255])
        elif t[0] == "copy":
            w.put(*codes[0][256 + t[1][0]])
            w.put(t[1][1], t[1][2])
            w.put(*codes[4][t[2][0]])
            w.put(t[2][1], t[2][2])
        else:
            w.put(*codes[0][t[1]])


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, references: bool = False, mode: int = 11, factors: int = 0xFF203018, block: int = 3) -> bytes:
    """height x width ARGB pixels with the given transforms (palette alone or first); small images, pixel by pixel."""
    height, width = pixels.shape
    p, across = pixels.reshape(-1).astype(np.uint32), width
    w = BitWriter()
    _header(w, width, height)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.put(block - 2, 3)
            cells = np.full((-(-across >> block)) * (-(-height >> block)), mode << 8 if kind == PREDICTOR else factors, np.uint32)
            _put_image(w, cells, False)
            if kind == PREDICTOR:
                known = p.tolist()
                guess = np.array([predicted(mode, k % across, k // across, across, known) for k in range(len(p))], np.uint32)
                p = (_bytes_of(p) - _bytes_of(guess)).view("<u4").reshape(-1).astype(np.uint32)
            else:
                p = _cross_colour(p, across, height, block, cells, -1)
        elif kind == SUBTRACT_GREEN:
            p = _green(p, -1)
        else:
            colours, index = np.unique(p, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("over 256 colours")
            w.put(len(colours) - 1, 8)
            steps = np.diff(_bytes_of(colours), axis=0, prepend=np.zeros((1, 4), np.uint8))
            _put_image(w, np.ascontiguousarray(steps).view("<u4").reshape(-1).astype(np.uint32), False)
            bundle = _bundle_bits(len(colours))
            per, each = 1 << bundle, 8 >> bundle
            across = -(-width >> bundle)
            padded = np.zeros((height, across * per), np.uint32)
            padded[:, :width] = index.reshape(height, width)
            p = (np.uint32(0xFF000000) | sum(padded[:, k::per] << np.uint32(each * k) for k in range(per)).astype(np.uint32) << np.uint32(8)).reshape(-1)
    w.put(0, 1)
    _put_image(w, p, True, cache_bits, references)
    return _container(w.bytes())
