"""How far frames have drifted: the shift at which each agrees best with its position's first frame."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores this near the best, as a part of the largest, are worked out again without transforms.
CLOSE = 1e-9


def correlations(reference: np.ndarray, there: np.ndarray, plane: np.ndarray, here: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of products, pixels in common) at every shift of ``plane`` by ``-most .. most`` in y and x.

    ``there`` and ``here`` mark the pixels that the two images have; values elsewhere are 0. One transform each way of an image as large as both.
    """
    shape = tuple(a + b for a, b in zip(reference.shape, plane.shape))
    turn = lambda a, b: np.fft.irfft2(np.fft.rfft2(a, shape) * np.conj(np.fft.rfft2(b, shape)), shape)
    sums, common = turn(reference, plane), np.rint(turn(there.astype(float), here.astype(float)))
    steps = np.arange(-most, most + 1)
    out = [np.zeros((len(steps), len(steps))) for _ in range(2)]
    y, x = (np.flatnonzero((steps > -plane.shape[k]) & (steps < reference.shape[k])) for k in (0, 1))
    for target, source in zip(out, (sums, common)):
        target[np.ix_(y, x)] = source[np.ix_(steps[y] % shape[0], steps[x] % shape[1])]
    return out[0], out[1]


def best_shift(reference: np.ndarray, there: np.ndarray, plane: np.ndarray, here: np.ndarray, most: int) -> tuple[int, int] | None:
    """(dy, dx) with the largest mean product over the pixels in common; of equal ones the smallest, None without common pixels.

    Transforms find the few shifts that can be best; these are compared by their exact sums.
    """
    sums, common = correlations(reference, there, plane, here, most)
    if not (common > 0).any():
        return None
    scores = np.where(common > 0, sums / np.maximum(common, 1), -np.inf)
    reach = CLOSE * max(1.0, float(np.abs(sums).max()))
    found = []
    for i, k in np.argwhere(scores >= scores.max() - reach):
        dy, dx = int(i) - most, int(k) - most
        cut = lambda n, m, d: (slice(max(0, d), min(n, m + d)), slice(max(0, -d), min(m, n - d)))
        (ry, py), (rx, px) = cut(reference.shape[0], plane.shape[0], dy), cut(reference.shape[1], plane.shape[1], dx)
        both = there[ry, rx] & here[py, px]
        found.append((float((reference[ry, rx] * plane[py, px])[both].sum() / both.sum()), -(abs(dy) + abs(dx)), -dy, -dx))
    best = max(found)
    return -best[2], -best[3]


def _plane(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.zeros((int(y.max(initial=0)) + 1, int(x.max(initial=0)) + 1))
    have = np.zeros(values.shape, bool)
    values[y, x], have[y, x] = v, True
    return values, have


def best_shifts(pixels: DataFrame, max_shift: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(…, frame_i, dy, dx)``: the shift of each frame that agrees best with its position's first, by mean product of what overlaps.

    Values are taken about their frame's mean; ties go to the smaller shift, and a frame that shares no pixel with the first at any has no
    row. A task holds two planes, a frame's and the first's, whatever the reach: all shifts come from one transform.
    """
    by = list(keys)
    rows = pixels.select(*by, "frame_i", F.col("y").cast("long"), F.col("x").cast("long"), F.col("value").cast("double"))
    frames = rows.groupBy(*by, "frame_i").agg(F.avg("value").alias("__mean"))
    first = frames.groupBy(*by).agg(F.min("frame_i").alias("__first")) if by else frames.agg(F.min("frame_i").alias("__first"))
    on = lambda df: df.join(first, by) if by else df.crossJoin(F.broadcast(first))
    other = on(frames).where("frame_i <> __first").select(*by, F.col("frame_i").alias("__frame"))
    centred = on(rows.join(frames, [*by, "frame_i"]).withColumn("value", F.col("value") - F.col("__mean")))
    base = centred.where("frame_i = __first").select(*by, "y", "x", "value")
    base = base.join(other, by) if by else base.crossJoin(F.broadcast(other))
    names = [f"__b{i}" for i in range(len(by))] + ["__f"]
    base = base.select(*(F.col(c).alias(n) for c, n in zip([*by, "__frame"], names)), *(F.col(c).alias(f"r{c}") for c in ("y", "x", "value")))
    moving = centred.where("frame_i <> __first").select(*by, "frame_i", "y", "x", "value")
    shape = T.StructType([*(f for f in moving.schema if f.name in (*by, "frame_i")), T.StructField("dy", T.LongType()), T.StructField("dx", T.LongType())])

    def run(key: tuple, own: pa.Table, reference: pa.Table) -> pa.Table:
        planes = [_plane(*(t[f"{r}{c}"].to_numpy() for c in ("y", "x", "value"))) for t, r in ((reference, "r"), (own, ""))]
        found = best_shift(*planes[0], *planes[1], max_shift) if own.num_rows and reference.num_rows else None
        columns = [pa.array([k.as_py()] if found else [], k.type) for k in key]
        return pa.table([*columns, *(pa.array([found[i]] if found else [], pa.int64()) for i in (0, 1))], [f.name for f in shape])

    return moving.groupBy(*by, "frame_i").cogroup(base.groupBy(*names)).applyInArrow(run, shape)
