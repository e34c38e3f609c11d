"""Operators on label images and channels in long form: one row per pixel.

Labels are sparse where an operator only needs objects (label 0, the background, may be absent); key columns such as
``position`` and ``frame_i`` are parameters, so any number of positions is one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import col
from cellweave.functions.formula import FormulaError, parse

FRAME = ("frame_i",)


def object_counts(labels: DataFrame, keys: Sequence[str] = (), by_frame: bool = True) -> DataFrame:
    """Objects in all, each frame counting its own, and distinct labels over the video."""
    rows = labels.where("label <> 0")
    total = F.count_distinct(F.col("frame_i"), F.col("label")) if by_frame else F.count_distinct(F.col("label"))
    counts = [total.alias("total_objects"), F.count_distinct("label").alias("unique_objects")]
    return rows.groupBy(*keys).agg(*counts) if keys else rows.agg(*counts)


def coordinates(labels: DataFrame, keys: Sequence[str] = FRAME, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """One row per pixel of an object."""
    return labels.where("label <> 0").select(*keys, F.col("label").alias("Cell_ID"), *axes)


def voxel_counts(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    return labels.where("label <> 0").groupBy(*keys, "label").agg(F.count("*").alias("n_voxels"))


def slice_sizes(labels: DataFrame, size_z: int, pixel_area: float, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pixels and area of every object on each z slice; 0 where it is absent."""
    sums = [F.count_if(F.col("z") == z).alias(f"cell_area_pxl_zslice{z}") for z in range(size_z)]
    counted = labels.where("label <> 0").groupBy(*keys, "label").agg(*sums)
    return counted.withColumns({f"cell_area_um2_zslice{z}": F.col(f"cell_area_pxl_zslice{z}") * F.lit(float(pixel_area)) for z in range(size_z)})


def project(volume: DataFrame, mode: str, z: int | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """A channel without its z axis: the single slice ``z``, the maximum, mean or upper median over z."""
    at = [*keys, "y", "x"]
    if mode == "single":
        return volume.where(F.col("z") == z).select(*at, "value")
    how = {
        "max": F.max("value"), "mean": F.avg("value"),
        "median": F.element_at(F.sort_array(F.collect_list("value")), (F.floor(F.count("value") / 2) + 1).cast("int")),
    }
    if mode not in how:
        raise ValueError(f"no such projection: {mode}")
    return volume.groupBy(*at).agg(how[mode].alias("value"))


def project_labels(volume: DataFrame, mode: str = "last", keys: Sequence[str] = FRAME) -> DataFrame:
    """Labels without their z axis: the last that is not background (for measuring), or the largest (for viewing)."""
    rows = volume.where("label <> 0").groupBy(*keys, "y", "x")
    return rows.agg((F.max_by("label", "z") if mode == "last" else F.max("label")).alias("label"))


def view_plane(volume: DataFrame, plane: str, keys: Sequence[str] = FRAME) -> DataFrame:
    """The maximum over the axis that the plane (XY, XZ or YZ) does not show."""
    axes = {"XY": ("y", "x"), "XZ": ("z", "x"), "YZ": ("z", "y")}[plane.upper()]
    return volume.groupBy(*keys, *axes).agg(F.max("value").alias("value"))


def connect_3d(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Every object gets the shape of its middle occupied slice on all slices from its first to its last.

    Where objects meet, the larger label counts. Labels that are not overwritten keep their pixels only through this rule.
    """
    rows = labels.where("label <> 0")
    spans = rows.groupBy(*keys, "label").agg(F.sort_array(F.collect_set("z")).alias("slices"))
    middle = F.element_at("slices", (F.floor(F.size("slices") / 2) + 1).cast("int"))
    spans = spans.select(*keys, "label", middle.alias("z"), F.element_at("slices", 1).alias("a"), F.element_at("slices", -1).alias("b"))
    shape = rows.join(spans, [*keys, "label", "z"]).select(*keys, "label", "y", "x", F.explode(F.sequence("a", "b")).alias("z"))
    return shape.groupBy(*keys, "z", "y", "x").agg(F.max("label").alias("label"))


def stack_to_3d(labels: DataFrame, size_z: int) -> DataFrame:
    """A flat image on every one of ``size_z`` slices."""
    return labels.withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size_z - 1).cast("long"))))


def labels_at(labels: DataFrame, points: DataFrame, keys: Sequence[str] = FRAME, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """Points with the label under them, 0 outside every object."""
    own = labels.where("label <> 0").select(*keys, *axes, "label").dropDuplicates([*keys, *axes])
    return points.join(own, [*keys, *axes], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def filter_by_points(labels: DataFrame, points: DataFrame, keys: Sequence[str] = FRAME, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """The objects that a point lies in; frames without points lose all."""
    touched = labels.where("label <> 0").join(points.select(*keys, *axes).distinct(), [*keys, *axes]).select(*keys, "label").distinct()
    return labels.join(touched, [*keys, "label"], "left_semi")


def inside(top: int, left: int, bottom: int, right: int) -> Column:
    """Whether a pixel lies in a rectangle, its last row and column excluded."""
    return (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)


def drop_outside(labels: DataFrame, roi: DataFrame | Column, keys: Sequence[str] = FRAME) -> DataFrame:
    """Without the objects that have a pixel outside the region: a table of its pixels (y, x), or a condition."""
    rows = labels.where("label <> 0")
    out = rows.where(~roi) if isinstance(roi, Column) else rows.join(roi.select("y", "x").distinct(), ["y", "x"], "left_anti")
    return rows.join(out.select(*keys, "label").distinct(), [*keys, "label"], "left_anti")


def background(pixels: DataFrame, keys: Sequence[str] = FRAME, roi: Column | None = None) -> DataFrame:
    """The median and mean of each frame's pixels outside all objects (within a region, if given)."""
    rows = pixels.where("label = 0") if roi is None else pixels.where((F.col("label") == 0) & roi)
    return rows.groupBy(*keys).agg(F.expr("percentile(value, 0.5)").alias("bkgr_median"), F.avg("value").alias("bkgr_mean"), F.count("*").alias("n_bkgr"))


def manual_background(pixels: DataFrame, second: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """The mean over the pixels of a second label image, for the object with the same label."""
    rows = second.where("label <> 0").select(*keys, "y", "x", "label").join(pixels.select(*keys, "y", "x", "value"), [*keys, "y", "x"])
    return rows.groupBy(*keys, "label").agg(F.avg("value").alias("manual_bkgr_mean"))


def remap(labels: DataFrame, mapping: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Labels replaced at once by a table ``(…, label, new_label)``; a new label of 0 deletes."""
    joined = labels.join(mapping.select(*keys, "label", "new_label"), [*keys, "label"], "left")
    return joined.withColumn("label", F.coalesce("new_label", "label")).drop("new_label").where("label <> 0")


def relabel(labels: DataFrame, source: int, target: int, where: Column | None = None) -> DataFrame:
    """One label as another, or gone if the other is 0."""
    at = (F.col("label") == source) if where is None else ((F.col("label") == source) & where)
    return labels.withColumn("label", F.when(at, F.lit(target)).otherwise(F.col("label"))).where("label <> 0")


def paint(labels: DataFrame, y: int, x: int, radius: float, label: int, keys: dict[str, int]) -> DataFrame:
    """A disk of one label (0 erases) on one frame, over whatever is there."""
    at = F.lit(True)
    for k, v in keys.items():
        at &= F.col(k) == v
    disk = (F.col("y") - y) * (F.col("y") - y) + (F.col("x") - x) * (F.col("x") - x) <= radius * radius
    rest = labels.where(~(at & disk))
    if not label:
        return rest
    r = int(radius)
    square = labels.sparkSession.range(-r, r + 1).select(F.col("id").alias("dy"), F.explode(F.sequence(F.lit(-r).cast("long"), F.lit(r).cast("long"))).alias("dx"))
    new = square.where(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= radius * radius).select((F.col("dy") + y).alias("y"), (F.col("dx") + x).alias("x"))
    new = new.where("y >= 0 and x >= 0").withColumns({k: F.lit(v).cast("long") for k, v in keys.items()} | {"label": F.lit(label).cast("long")})
    return rest.unionByName(new.select(*labels.columns))


def perimeters(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """The pixel edges of each object that border on anything else."""
    rows = labels.where("label <> 0").select(*keys, "label", "y", "x")
    right = rows.select(*keys, "label", "y", (F.col("x") - 1).alias("x"), F.lit(1).alias("n"))
    below = rows.select(*keys, "label", (F.col("y") - 1).alias("y"), "x", F.lit(1).alias("n"))
    joins = rows.join(right.unionByName(below), [*keys, "label", "y", "x"], "left")
    per_pixel = joins.groupBy(*keys, "label", "y", "x").agg(F.count("n").alias("n"))
    return per_pixel.groupBy(*keys, "label").agg((4 * F.count("*") - 2 * F.sum("n")).cast("double").alias("perimeter"))


def rescale(pixels: DataFrame, low: float = 0.0, high: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Values stretched so that the least becomes ``low`` and the greatest ``high``; a constant image becomes ``low``."""
    ends = pixels.groupBy(*keys).agg(F.min("value").alias("__a"), F.max("value").alias("__b"))
    joined = pixels.join(ends, list(keys)) if keys else pixels.crossJoin(F.broadcast(ends))
    span = F.col("__b") - F.col("__a")
    value = F.when(span == 0, F.lit(low)).otherwise(F.lit(low) + (F.col("value") - F.col("__a")) / F.nullif(span, F.lit(0.0)) * (high - low))
    return joined.withColumn("value", value).drop("__a", "__b")


def binarize(pixels: DataFrame, mode: str) -> DataFrame:
    """1 where a value is above 0 and 0 elsewhere ("binarize"), the other way round ("inverse binarize"), or as it is ("no")."""
    m = mode.strip().lower()
    if m not in ("no", "binarize", "inverse binarize"):
        raise ValueError(f"no such mode: {mode}")
    on = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    return pixels if m == "no" else pixels.withColumn("value", on if m == "binarize" else 1.0 - on)


def to_unit(value: Column, bits: int) -> Column:
    """An unsigned integer's value as a fraction of its type's largest."""
    return value / F.lit(float(2**bits - 1))


def from_unit(value: Column, bits: int) -> Column:
    """A fraction as an unsigned integer, rounded and kept within its type."""
    top = float(2**bits - 1)
    return F.least(F.greatest(F.round(value * top), F.lit(0.0)), F.lit(top)).cast("long")


def channel_formula(channels: dict[str, DataFrame], formula: str, keys: Sequence[str] = FRAME, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """The formula's value at every pixel that all channels have; arithmetic is that of 32-bit floats."""
    names = list(channels)
    at = [*keys, *axes]
    own = {n: f"__v{i}" for i, n in enumerate(names)}
    rows = [c.select(*at, F.col("value").cast("float").alias(own[n])) for n, c in channels.items()]
    joined = rows[0]
    for r in rows[1:]:
        joined = joined.join(r, [a for a in at if a in r.columns])

    def value(name: str) -> Column:
        if name not in own:
            raise FormulaError(f"no channel is called {name!r}")
        return col(own[name])

    return joined.select(*at, parse(formula, value, cast="float").cast("float").alias("value"))


def broadcast_depth(pixels: DataFrame, size_z: int) -> DataFrame:
    """A flat channel on every slice, so that it meets one that has depth."""
    return stack_to_3d(pixels, size_z)


def combine_channels(channels: dict[str, tuple[DataFrame, str]], formula: str, segmentation: bool = False, keys: Sequence[str] = FRAME) -> DataFrame:
    """A recipe: each channel binarized or stretched to 0 … 1, the formula, and the result stretched unless it is a segmentation."""
    ready = {n: (binarize(c, m) if m.lower() != "no" else rescale(c)) for n, (c, m) in channels.items()}
    out = channel_formula(ready, formula, keys).withColumn("value", F.col("value").cast("double"))
    return out if segmentation else rescale(out)


def shift(pixels: DataFrame, shifts: DataFrame, height: int, width: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pixels moved by each frame's ``(dy, dx)``; what leaves the image goes, what is left free has no row (0)."""
    moved = pixels.join(shifts.select(*keys, "dy", "dx"), list(keys), "left")
    moved = moved.withColumns({"y": F.col("y") + F.coalesce("dy", F.lit(0)), "x": F.col("x") + F.coalesce("dx", F.lit(0))}).drop("dy", "dx")
    return moved.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width))


def crop(pixels: DataFrame, frames: tuple[int, int] | None = None, depth: tuple[int, int] | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Ranges of frames and slices and a rectangle (top, left, bottom, right), all without their end, moved to the origin."""
    out = pixels
    for name, span in (("frame_i", frames), ("z", depth), ("y", box and (box[0], box[2])), ("x", box and (box[1], box[3]))):
        if span is not None:
            if span[0] < 0 or span[1] <= span[0]:
                raise ValueError(f"an empty range of {name}")
            out = out.where((F.col(name) >= span[0]) & (F.col(name) < span[1])).withColumn(name, F.col(name) - span[0])
    return out


def crop_rois(pixels: DataFrame, rois: Sequence[tuple[int, int, int, int, int]]) -> DataFrame:
    """Every region ``(roi_id, top, left, bottom, right)`` as an image of its own, from its corner on."""
    each = [F.when(inside(t, l, b, r), F.struct(F.lit(i).alias("roi_id"), F.lit(t).alias("t"), F.lit(l).alias("l"))) for i, t, l, b, r in rois]
    rows = pixels.withColumn("__r", F.explode(F.array_compact(F.array(*each))))
    moved = rows.withColumns({"roi_id": F.col("__r.roi_id"), "y": F.col("y") - F.col("__r.t"), "x": F.col("x") - F.col("__r.l")})
    return moved.drop("__r")
