"""Texts kept as lossless WebP images and read back.

A document's payload (its UTF-8 bytes, with bytes 32 up to a positive multiple of
192) becomes the grey samples of one image, 192 x k wide; a payload beyond the
format's largest image becomes several files one after another.  The images are
written as a binary column, read again, decoded to pixel arrays and described.

Edge cases: null or empty text is 192 spaces; equal texts give equal values in
every column; texts of any length keep all bytes; repeated rows each get a row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .shared import id_text, stored, table

UNIT, PAD = 192, b" "


def to_media(payload: bytes) -> bytes:
    """One WebP file, or several in a row where the payload exceeds the largest image."""
    samples = np.frombuffer(payload, np.uint8)
    most = (webp.LARGEST_SIDE // UNIT * UNIT) * webp.LARGEST_SIDE
    out = []
    for first in range(0, len(samples), most):
        part = samples[first : first + most]
        width = UNIT * -(-len(part) // (UNIT * webp.LARGEST_SIDE))
        whole = len(part) // width * width
        out.append(webp.encode_samples(part[:whole], width))
        if whole < len(part):
            out.append(webp.encode_samples(part[whole:], UNIT))
    return b"".join(out)


def from_media(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of the files in a media value."""
    images, at = [], 0
    while at < len(media):
        (size,) = struct.unpack_from("<I", media, at + 4)
        images.append(webp.decode(media[at : at + 8 + size]))
        at += 8 + size
    return images


def feature(images: list[np.ndarray], samples: np.ndarray) -> str:
    """Width x height of each image, mean and standard deviation of the samples in thousandths, and a 16-bin histogram."""
    bins = np.bincount(samples >> 4, minlength=16)
    total = int(bins.sum())
    mean = int(samples.sum(dtype=np.int64)) * 1000 // total
    square = int(np.bincount(samples, minlength=256) @ (np.arange(256, dtype=np.int64) ** 2)) * 1_000_000 // total
    deviation = int(max(0, square - mean * mean) ** 0.5)
    return f"{'+'.join(f'{i.shape[1]}x{i.shape[0]}' for i in images)};{mean};{deviation};{','.join(map(str, bins.tolist()))}"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WebP bytes), written to the shared folder and read again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode() for t in batch["text"]]
            media = [to_media(b + PAD * (-len(b) % UNIT if b else UNIT)) for b in raw]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": pd.Series(map(len, raw), dtype="int64"), "media": pd.Series(media, dtype="object")})

    return stored(id_text(docs).mapInPandas(run, "doc_id long, n_bytes long, media binary"), "media")


def describe_media(media: DataFrame, with_pixels: bool = False) -> DataFrame:
    """Decodes the media column; with_pixels also gives the samples as binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, n, data in zip(batch["doc_id"].tolist(), batch["n_bytes"].tolist(), batch["media"]):
                images = from_media(data)
                samples = np.concatenate([(i.reshape(-1) & np.uint32(255)).astype(np.uint8) for i in images])
                payload = samples.tobytes()
                row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(images, samples))
                rows.append((*row, payload) if with_pixels else row)
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pixels"] * with_pixels)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", pixels binary" * with_pixels
    return media.mapInPandas(run, schema)


def op3_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(store_media(table(spark, sf_dir, "documents")))
