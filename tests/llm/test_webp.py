import itertools

import numpy as np
import pytest

from webloom.llm import webp
from webloom.llm.op03_media import from_media, to_media


def picture(height, width, colours, seed=0):
    rng = np.random.default_rng(seed)
    some = rng.integers(0, 1 << 32, colours, dtype=np.uint32)
    p = some[rng.integers(0, colours, height * width)].reshape(height, width)
    p[height // 2 :, : width // 2] = p[0, 0]
    return p


def test_near_distances_are_the_format_s():
    assert len(webp.NEAR_DISTANCES) == len(set(webp.NEAR_DISTANCES)) == 120


@pytest.mark.parametrize("transforms", [(), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOUR,), (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN)])
@pytest.mark.parametrize(("cache", "references"), [*itertools.product((0, 4), (False, True))])
def test_round_trip_of_each_feature(transforms, cache, references):
    p = picture(13, 21, 60)
    assert (webp.decode(webp.encode(p, transforms, cache, references)) == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    p = picture(9, 10, 300, mode)
    assert (webp.decode(webp.encode(p, (webp.PREDICTOR,), mode=mode)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette_and_pixel_bundling(colours):
    p = picture(7, 19, colours)
    assert (webp.decode(webp.encode(p, (webp.PALETTE,), references=True)) == p).all()


@pytest.mark.parametrize("data", [b" " * 192, b"ab" * 96, bytes(range(256)) * 3, b"\0\xff" * 96, b"abcdefghij klmnopqrstu" * 960, "é日本".encode() * 192])
def test_samples_round_trip(data):
    data += b" " * (-len(data) % 192)
    media = to_media(data)
    assert b"".join((i.reshape(-1) & 255).astype(np.uint8).tobytes() for i in from_media(media)) == data
    assert {int(x) >> 24 for i in from_media(media) for x in i.reshape(-1)[:9]} == {255}


def test_damaged_files_raise():
    good = webp.encode(picture(5, 5, 9))
    for bad in (b"", good[:30], b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:]):
        with pytest.raises((ValueError, IndexError, __import__("struct").error)):
            webp.decode(bad)


def both_ways(data):
    """The pixels by whole arrays, after checking that they are those pixel by pixel."""
    fast = webp.decode(data)
    webp.BY_ARRAYS = False
    try:
        assert (webp.decode(data) == fast).all()
    finally:
        webp.BY_ARRAYS = True
    return fast


SAMPLES = {
    "one value": b"a" * 576, "two values": b"ab" * 480, "repeated lines": (b"one line again\n" * 320)[:4608], "every byte": bytes(range(256)) * 9, "noise": bytes(np.random.default_rng(1).integers(0, 256, 3840, dtype=np.uint8)),
    "a slope": bytes((i * 7) & 255 for i in range(5760)), "columns": bytes((r * 3 + c) % 251 for r in range(60) for c in range(192)), "packed": bytes(np.random.default_rng(2).integers(65, 75, 1920, dtype=np.uint8)),
}


@pytest.mark.parametrize("name", SAMPLES)
def test_samples_come_back_by_both_decoders(name):
    raw = SAMPLES[name]
    pixels = both_ways(webp.encode_samples(np.frombuffer(raw, np.uint8), 192))
    assert (pixels >> 24 == 255).all() and all(((pixels >> k) & 255).astype(np.uint8).tobytes() == raw for k in (0, 8, 16))


def test_windows_and_long_copies(monkeypatch):
    rng = np.random.default_rng(3)
    block = rng.integers(32, 127, 7000, dtype=np.uint8)
    raw = np.concatenate([block, block[100:6000], np.full(9000, 32, np.uint8), rng.integers(32, 127, 5000, dtype=np.uint8), block])
    raw = np.concatenate([raw, np.full(-len(raw) % 192, 32, np.uint8)])
    data = webp.encode_samples(raw, 192)
    assert len(data) < 0.5 * len(raw)
    whole = both_ways(data)
    monkeypatch.setattr(webp, "WINDOW", 64)
    assert (webp.decode(data) == whole).all() and (whole & 255).astype(np.uint8).tobytes() == raw.tobytes()


def test_codings_are_chosen_where_they_help():
    def transforms(raw):
        """The transforms, and whether the codes are of one length."""
        r, found = webp.BitReader(webp.encode_samples(np.frombuffer(raw, np.uint8), 192)[20:]), []
        r.at = 8 + 28 + 4
        while r.bits(1):
            found.append(r.bits(2))
            if found[-1] == webp.PALETTE:
                webp._read_image(r, r.bits(8) + 1, 1, False)
            elif found[-1] == webp.PREDICTOR:
                webp._read_image(r, 1, -(-(len(raw) // 192) >> (r.bits(3) + 2)), False)
        r.bits(2)
        return found, webp._read_prefix(r, 280).flat_bits() is not None

    assert transforms(SAMPLES["noise"]) == ([webp.PALETTE], True) and transforms(SAMPLES["two values"])[0] == [webp.PALETTE] and transforms(SAMPLES["repeated lines"] * 2)[1] is False
    assert transforms(SAMPLES["a slope"]) == ([webp.PALETTE, webp.PREDICTOR], False)


@pytest.mark.parametrize("mode", [1, 2])
def test_one_sided_predictors_undone_by_sums(mode):
    rng = np.random.default_rng(mode)
    pixels = rng.integers(0, 1 << 32, (7, 9), dtype=np.uint32)
    assert (both_ways(webp.encode(pixels, (webp.PREDICTOR,), mode=mode)) == pixels).all()


def test_truncated_data_are_an_error():
    data = bytearray(webp.encode_samples(np.frombuffer(SAMPLES["noise"], np.uint8), 192))
    cut = bytes(data[: len(data) // 2])
    with pytest.raises(ValueError):
        webp.decode(cut)
