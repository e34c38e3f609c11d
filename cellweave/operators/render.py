"""Frames as pictures: grey by range, labels laid over in colour, as PNG files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweave.operators.pixels import FRAME


def grey(plane: np.ndarray) -> np.ndarray:
    """Values from the least (0) to the greatest (255); a constant plane is black."""
    low, high = float(plane.min()), float(plane.max())
    return np.zeros(plane.shape, np.uint8) if high <= low else np.round((plane - low) / (high - low) * 255).astype(np.uint8)


def colours(labels: np.ndarray) -> np.ndarray:
    """A colour for each label, the same wherever it occurs."""
    h = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([((h >> np.uint64(s)) & np.uint64(0xFF)).astype(np.uint8) | np.uint8(64) for s in (16, 32, 48)], axis=-1)


def overlay(plane: np.ndarray, labels: np.ndarray, alpha: float = 0.35) -> np.ndarray:
    """Grey with each object blended in by its colour."""
    base = np.repeat(grey(plane)[..., None], 3, axis=2).astype(float)
    return np.where((labels > 0)[..., None], base * (1 - alpha) + colours(labels) * alpha, base).round().astype(np.uint8)


def scale_bar(image: np.ndarray, length: int, thickness: int = 2, margin: int = 3) -> np.ndarray:
    """A white bar of ``length`` pixels at the lower right."""
    out = image.copy()
    h, w = out.shape[:2]
    out[max(0, h - margin - thickness) : h - margin, max(0, w - margin - length) : w - margin] = 255
    return out


def png(image: np.ndarray) -> bytes:
    """Grey (h, w) or colour (h, w, 3) bytes as a PNG file."""
    h, w = image.shape[:2]
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    rows = np.pad(image.reshape(h, -1), ((0, 0), (1, 0))).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def render(pixels: DataFrame, alpha: float = 0.35, bar: int = 0, keys: Sequence[str] = FRAME) -> DataFrame:
    """``(…, height, width, content)``: a PNG of each frame from its ``value`` and ``label``; a task holds one plane."""
    source = pixels.select(*keys, "y", "x", pixels["value"].cast("double").alias("value"), pixels["label"].cast("long").alias("label"))
    out = T.StructType([*(source.schema[k] for k in keys), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("content", T.BinaryType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
        plane, labels = np.zeros((y.max() + 1, x.max() + 1)), np.zeros((y.max() + 1, x.max() + 1), np.int64)
        plane[y, x], labels[y, x] = rows["value"], rows["label"]
        image = overlay(plane, labels, alpha)
        image = scale_bar(image, bar) if bar else image
        return pd.DataFrame({k: [rows[k].iloc[0]] for k in keys} | {"height": [image.shape[0]], "width": [image.shape[1]], "content": [png(image)]})

    return source.groupBy(*keys).applyInPandas(run, out)
