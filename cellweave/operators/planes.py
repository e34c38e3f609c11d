"""Operators that need a pixel's neighbourhood: filters of channels, hulls and holes of objects.

A group is one plane (a frame's channel or label image), so a task's memory is bounded by an image. Kernels are numpy on
whole planes; nothing runs per pixel in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cellweave.operators.pixels import FRAME


def _shifted(plane: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The plane as seen from (dy, dx) away; edges repeat."""
    h, w = plane.shape
    return plane[np.clip(np.arange(h) + dy, 0, h - 1)][:, np.clip(np.arange(w) + dx, 0, w - 1)]


def _kernel(sigma: float) -> np.ndarray:
    radius = int(np.ceil(np.float32(sigma) * np.float32(3)))
    d = np.arange(-radius, radius + 1, dtype=np.float32)
    k = np.exp(-(d * d) / np.float32(2 * np.float32(sigma) * np.float32(sigma))).astype(np.float32)
    return k / k.sum(dtype=np.float32)


def gaussian(plane: np.ndarray, sigma_y: float, sigma_x: float) -> np.ndarray:
    """Blurred out to three sigmas, edges repeated; no blur along an axis whose sigma is 0 or less."""
    out = plane.astype(np.float32)
    for sigma, axis in ((sigma_x, 1), (sigma_y, 0)):
        if sigma > 0:
            k = _kernel(sigma)
            r = len(k) // 2
            out = sum(w * (_shifted(out, i - r, 0) if axis == 0 else _shifted(out, 0, i - r)) for i, w in enumerate(k)).astype(np.float32)
    return out


def square(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(y, x) for y, x in square(radius) if y * y + x * x <= radius * radius]


def opening(plane: np.ndarray, shape: Sequence[tuple[int, int]]) -> np.ndarray:
    """The least value around each pixel, then the greatest of those."""
    eroded = np.minimum.reduce([_shifted(plane, y, x) for y, x in shape])
    return np.maximum.reduce([_shifted(eroded, y, x) for y, x in shape])


def to_range_of(values: np.ndarray, source: np.ndarray) -> np.ndarray:
    low, high = values.min(), values.max()
    if abs(high - low) <= np.finfo(np.float32).eps:
        return np.full_like(values, source.min())
    return source.min() + (values - low) * ((source.max() - source.min()) / (high - low))


def spots(plane: np.ndarray, radius_y: float, radius_x: float) -> np.ndarray:
    """Blobs of a radius, as a difference of two blurs in the range of the plane."""
    if radius_y <= 0 or radius_x <= 0:
        raise ValueError("radii must be above 0")
    root = np.float32(np.sqrt(2))
    sy, sx = radius_y / (1 + root), radius_x / (1 + root)
    return to_range_of(gaussian(plane, sy, sx) - gaussian(plane, root * sy, root * sx), plane)


def ridges(plane: np.ndarray, sigmas: Sequence[float]) -> np.ndarray:
    """The strongest response over all sigmas: how far the smaller curvature is below 0."""
    if any(s <= 0 for s in sigmas):
        raise ValueError("sigmas must be above 0")
    best = np.zeros(plane.shape, np.float32) if len(sigmas) else plane
    for s in sigmas:
        b, scale = gaussian(plane, s, s), np.float32(s * s)
        xx = (_shifted(b, 0, -1) - 2 * b + _shifted(b, 0, 1)) * scale
        yy = (_shifted(b, -1, 0) - 2 * b + _shifted(b, 1, 0)) * scale
        xy = (_shifted(b, 1, 1) - _shifted(b, 1, -1) - _shifted(b, -1, 1) + _shifted(b, -1, -1)) * np.float32(0.25) * scale
        lowest = (xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2
        best = np.maximum(best, np.maximum(-lowest, 0))
    return best


def speckles(plane: np.ndarray, radius: int) -> np.ndarray:
    """What stands out of an opening by a disk."""
    return plane - opening(plane, disk(radius))


def even_light(plane: np.ndarray, block: int, diameter: float, blur: bool = True) -> np.ndarray:
    """The plane above its background, an opening by a disk of the (blurred) plane."""
    return plane - opening(gaussian(plane, diameter / 2, diameter / 2) if blur else plane, disk(block))


#: The steps that a workflow may name.
STEPS: dict[str, Callable[..., np.ndarray]] = {
    "gaussian_filter": lambda p, sigma_y, sigma_x: gaussian(p, sigma_y, sigma_x), "remove_hot_pixels": lambda p: opening(p, square(1)),
    "spot_detector_filter": spots, "ridge_filter": ridges, "enhance_speckles": speckles, "correct_illumination": even_light,
}


def _dense(rows: pd.DataFrame, column: str, fill: float = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
    plane = np.full((y.max() + 1, x.max() + 1), fill, np.float32 if column == "value" else np.int64)
    plane[y, x] = rows[column]
    return plane, y, x


def preprocess(pixels: DataFrame, steps: Sequence[tuple[str, dict]], keys: Sequence[str] = FRAME) -> DataFrame:
    """``(…, y, x, value)`` of every plane after the steps, in order."""
    unknown = [n for n, _ in steps if n not in STEPS]
    if unknown:
        raise ValueError(f"no such step: {unknown[0]}")
    source = pixels.select(*keys, "y", "x", pixels["value"].cast("float").alias("value"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        plane, y, x = _dense(rows, "value")
        for name, options in steps:
            plane = STEPS[name](plane, **options).astype(np.float32)
        return rows.assign(value=plane[y, x])

    return source.groupBy(*keys).applyInPandas(run, source.schema)


def exterior(mask: np.ndarray) -> np.ndarray:
    """The free pixels from which the border can be reached over free pixels, by edges."""
    free = np.pad(~mask, 1, constant_values=True)
    out = np.zeros(free.shape, bool)
    out[0] = out[-1] = out[:, 0] = out[:, -1] = True
    while True:
        grown = out.copy()
        for axis in (0, 1):
            for way in (1, -1):
                grown |= _swept(grown, free, axis, way)
        if (grown == out).all():
            return out[1:-1, 1:-1]
        out = grown


def _swept(seed: np.ndarray, free: np.ndarray, axis: int, way: int) -> np.ndarray:
    """Free pixels that a seed reaches in one direction along an axis, at any distance."""
    s, f = (a if axis == 1 else a.T for a in (seed, free))
    s, f = s[:, ::way], f[:, ::way]
    at = np.arange(s.shape[1])
    seen = np.maximum.accumulate(np.where(s & f, at, -1), axis=1)
    wall = np.maximum.accumulate(np.where(f, -1, at), axis=1)
    out = (seen > wall)[:, ::way]
    return out if axis == 1 else out.T


def _plane_filled(plane: np.ndarray) -> np.ndarray:
    out = plane.copy()
    for label in np.unique(plane[plane != 0]):
        y, x = np.nonzero(out == label)
        if len(y):
            box = np.s_[y.min() : y.max() + 1, x.min() : x.max() + 1]
            own = out[box] == label
            out[box][~own & ~exterior(own)] = label
    return out


def fill_holes(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """``(…, y, x, label)``: what a label encloses becomes that label, other labels included, lower labels first."""
    source = labels.where("label <> 0").select(*keys, "y", "x", "label")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        plane, _, _ = _dense(rows, "label")
        y, x = np.nonzero(filled := _plane_filled(plane))
        return pd.DataFrame({k: rows[k].iloc[0] for k in keys} | {"y": y, "x": x, "label": filled[y, x]})

    return source.groupBy(*keys).applyInPandas(run, source.schema)


def parts_of(mask: np.ndarray) -> np.ndarray:
    """A number from 1 for each part that hangs together by edges, 0 elsewhere: union of horizontal runs."""
    starts = mask & ~np.pad(mask, ((0, 0), (1, 0)))[:, :-1]
    run = np.where(mask, np.cumsum(starts).reshape(mask.shape), 0)
    parent = list(range(int(starts.sum()) + 1))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    above, below = run[:-1], run[1:]
    both = (above > 0) & (below > 0)
    for a, b in {tuple(p) for p in np.stack([above[both], below[both]], axis=1).tolist()}:
        parent[find(a)] = find(b)
    return np.unique([find(a) for a in range(len(parent))], return_inverse=True)[1][run]


def component_count(mask: np.ndarray) -> int:
    """Parts that hang together by edges."""
    return int(parts_of(mask).max(initial=0))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, anticlockwise."""
    points = sorted(map(tuple, np.unique(points, axis=0).tolist()))

    def half(path: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in path:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]), float)


def form(mask: np.ndarray) -> dict[str, float]:
    """Hull area, solidity, largest diameter, parts, holes and Euler number of one object."""
    y, x = np.nonzero(mask)
    corners = hull(np.concatenate([np.stack([y + a, x + b], axis=1) for a in (0, 1) for b in (0, 1)]))
    nxt = np.roll(corners, -1, axis=0)
    area = abs(float((corners[:, 0] * nxt[:, 1] - corners[:, 1] * nxt[:, 0]).sum())) / 2
    gaps = corners[:, None] - corners[None]
    parts, holes = component_count(mask), component_count(~mask & ~exterior(mask))
    filled = int((~exterior(mask)).sum())
    return {
        "convex_area": area, "solidity": len(y) / area if area else float("nan"), "feret_diameter_max": float(np.sqrt((gaps**2).sum(axis=2)).max()),
        "n_components": parts, "n_holes": holes, "euler_number": parts - holes, "filled_area": filled,
    }


def hulls(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """``form`` of every object, an object's pixels per group."""
    source = labels.where("label <> 0").select(*keys, "label", "y", "x")
    kinds = {"convex_area": T.DoubleType(), "solidity": T.DoubleType(), "feret_diameter_max": T.DoubleType(), "n_components": T.LongType(), "n_holes": T.LongType(), "euler_number": T.LongType(), "filled_area": T.LongType()}
    shape = T.StructType([*(f for f in source.schema if f.name not in ("y", "x")), *(T.StructField(k, v) for k, v in kinds.items())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for label, own in rows.groupby("label"):
            y, x = own["y"].to_numpy(np.int64), own["x"].to_numpy(np.int64)
            mask = np.zeros((y.max() - y.min() + 1, x.max() - x.min() + 1), bool)
            mask[y - y.min(), x - x.min()] = True
            out.append({k: rows[k].iloc[0] for k in keys} | {"label": label} | form(mask))
        return pd.DataFrame(out)

    return source.groupBy(*keys).applyInPandas(run, shape)


def keep_shapes(labels: DataFrame, min_area: int = 0, min_solidity: float = 0.0, max_elongation: float = float("inf"), keys: Sequence[str] = FRAME) -> DataFrame:
    """Without objects that are too small, too ragged or too long."""
    from cellweave.operators.objects import inertia

    h, i = hulls(labels, keys).select(*keys, "label", "solidity"), inertia(labels, keys)
    good = h.join(i, [*keys, "label"]).where(f"area >= {int(min_area)} and solidity >= {float(min_solidity)}")
    if max_elongation < float("inf"):
        good = good.where(f"minor_axis_length > 0 and major_axis_length <= {float(max_elongation)} * minor_axis_length")
    return labels.join(good.select(*keys, "label"), [*keys, "label"], "left_semi")
