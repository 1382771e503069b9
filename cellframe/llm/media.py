"""Media columns: bytes kept as lossless WebP images in a binary column, and features of them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellframe.llm import webp
from cellframe.llm.shared import append_columns

WIDTH = 64


def payload_of(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH - len(raw), -len(raw) % WIDTH))


def to_media(payload: bytes) -> bytes:
    """Images of 64 samples (green) a row, one after another if there are too many rows, with back-references
    where they take less."""
    pixels = np.frombuffer(payload, np.uint8).astype(np.uint32).reshape(-1, WIDTH) << 8 | np.uint32(webp.BLACK)
    palette = np.count_nonzero(np.bincount(np.frombuffer(payload, np.uint8))) <= 16  # then several share a pixel
    return b"".join(webp.encode(pixels[i : i + webp.SIDE], palette=palette, copies=True) for i in range(0, len(pixels), webp.SIDE))


def images(media: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(webp.decode(media[at : at + n]))
        at += n
    return out


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with each whole text as media. Null and empty texts are one row of zeros; rows
    map one to one, repeated or not, and a column of the same name is replaced."""

    def compute():
        return lambda b: [[to_media(payload_of(x)) for x in b.column(b.schema.get_field_index(text)).to_pylist()]]

    return append_columns(docs, [T.StructField(media, T.BinaryType(), False)], compute)


def features_of(grey: np.ndarray) -> str:
    """Width, height, number of values, mean and mean step to the right, of grey pixels."""
    wide = grey.astype(np.int64)
    return f"{grey.shape[1]}x{grey.shape[0]};values={np.count_nonzero(np.bincount(grey.ravel()))};mean={wide.mean():.4f};step={np.abs(np.diff(wide, axis=1)).mean():.4f}"


def read(docs: DataFrame, media: str = "media", payload: str = "payload", feature: str = "feature") -> DataFrame:
    """``docs`` with the bytes and features that decoding of the media column gives; null media
    give null."""

    def compute():
        def of(batch: pa.RecordBatch) -> list:
            bytes_out, text_out = [], []
            for m in batch.column(batch.schema.get_field_index(media)).to_pylist():
                if m is None:
                    bytes_out.append(None)
                    text_out.append(None)
                    continue
                grey = np.concatenate([(x >> 8 & 255).astype(np.uint8) for x in images(m)])
                bytes_out.append(grey.tobytes())
                text_out.append(features_of(grey))
            return [bytes_out, text_out]

        return of

    return append_columns(docs, [T.StructField(payload, T.BinaryType()), T.StructField(feature, T.StringType())], compute)
