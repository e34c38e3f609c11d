"""Segmentation as a hook: any function from a plane of values to a plane of labels, run on every frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.pixels import FRAME, drop_outside, project
from cellweave.operators.planes import keep_shapes, preprocess

Segmenter = Callable[[np.ndarray], np.ndarray]


def threshold_segmenter(level: float) -> Segmenter:
    """Parts of a plane above a level that hang together by edges, numbered in reading order."""

    def run(plane: np.ndarray) -> np.ndarray:
        label = np.where(plane > level, np.arange(1, plane.size + 1).reshape(plane.shape), 0)
        while True:
            padded = np.pad(label, 1)
            around = [padded[1:-1, :-2], padded[1:-1, 2:], padded[:-2, 1:-1], padded[2:, 1:-1]]
            big = np.iinfo(np.int64).max
            least = np.minimum.reduce([np.where(a > 0, a, big) for a in (label, *around)])
            new = np.where(label > 0, least, 0)
            if (new == label).all():
                return np.searchsorted(np.unique(label[label > 0]), label) * (label > 0) + (label > 0)
            label = new

    return run


def segment(pixels: DataFrame, segmenter: Segmenter, keys: Sequence[str] = FRAME) -> DataFrame:
    """``(…, y, x, label)`` of each plane; a task holds one."""
    source = pixels.select(*keys, "y", "x", pixels["value"].cast("float").alias("value"))
    shape = source.select(*keys, "y", "x", F.lit(0).cast("long").alias("label")).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
        plane = np.zeros((y.max() + 1, x.max() + 1), np.float32)
        plane[y, x] = rows["value"]
        found = np.asarray(segmenter(plane), np.int64)
        return rows[[*keys, "y", "x"]].assign(label=found[y, x])

    return source.groupBy(*keys).applyInPandas(run, shape).where("label <> 0")


def run_position(pixels: DataFrame, segmenter: Segmenter, steps: Sequence[tuple[str, dict]] = (), projection: str | None = None, z: int | None = None, roi: DataFrame | Column | None = None, min_area: int = 0, min_solidity: float = 0.0, max_elongation: float = float("inf"), stop_frame: int | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Frames up to a stop, flattened, preprocessed, segmented, and without objects outside the region or of the wrong shape."""
    rows = pixels if stop_frame is None else pixels.where(F.col("frame_i") < stop_frame)
    rows = project(rows, projection, z, keys) if projection else rows
    rows = preprocess(rows, steps, keys) if steps else rows
    labels = segment(rows, segmenter, keys)
    labels = labels if roi is None else drop_outside(labels, roi, keys)
    return keep_shapes(labels, min_area, min_solidity, max_elongation, keys)
