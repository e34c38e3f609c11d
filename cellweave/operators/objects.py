"""Objects out of pixels: region, shape and intensity measurements, and how objects move between frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import NAN, col
from cellweave.functions.formula import divide
from cellweave.operators import areas, planes
from cellweave.operators.pixels import FRAME, perimeters, project, project_labels, slice_sizes, voxel_counts

PI = 3.141592653589793
#: The quantiles of an object's intensities, by the name of their column.
QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
#: What an object is taken for before it is annotated.
ANNOTATION_DEFAULTS = {
    "cell_cycle_stage": "G1", "relationship": "mother", "generation_num": 2, "relative_ID": -1, "emerg_frame_i": -1, "division_frame_i": -1,
    "is_history_known": False, "corrected_on_frame_i": -1, "will_divide": 0, "is_cell_dead": 0, "is_cell_excluded": 0,
}


#: The shapes that pixels' moments alone give, and those that edges are needed for.
FIGURES = ("area", "major_axis_length", "minor_axis_length", "orientation", "eccentricity")
SHAPES = (*FIGURES, "perimeter", "circularity", "roundness", "aspect_ratio", "extent", "equivalent_diameter")


def _figures(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything about an object's pixels that one aggregation gives."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    out = labels.where("label <> 0").groupBy(*keys, "label").agg(
        F.count("*").alias("area"), F.avg("y").alias("centroid-0"), F.avg("x").alias("centroid-1"), F.min("y").alias("bbox-0"), F.min("x").alias("bbox-1"),
        (F.max("y") + 1).alias("bbox-2"), (F.max("x") + 1).alias("bbox-3"), F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"),
    )
    half, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow("xy", 2))
    out = out.withColumns({"l0": F.greatest(half + gap, F.lit(0.0)), "l1": F.greatest(half - gap, F.lit(0.0))})
    ratio = F.try_divide(F.col("l1"), F.col("l0"))
    return out.withColumns({
        "y_centroid": F.floor(F.col("`centroid-0`")), "x_centroid": F.floor(F.col("`centroid-1`")), "major_axis_length": 4 * F.sqrt("l0"), "minor_axis_length": 4 * F.sqrt("l1"),
        "orientation": F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2, "eccentricity": F.when(ratio.isNull(), NAN).otherwise(F.sqrt(F.greatest(1 - ratio, F.lit(0.0)))),
    }).drop("yy", "xx", "xy", "l0", "l1")


def regions(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Area, centroid (y, x; and both rounded down) and bounding box (last row and column excluded) of every object."""
    return _figures(labels, keys).drop("major_axis_length", "minor_axis_length", "orientation", "eccentricity")


def inertia(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Axis lengths, orientation and eccentricity from the population covariance of an object's pixels."""
    return _figures(labels, keys).select(*keys, "label", "area", "major_axis_length", "minor_axis_length", "orientation", "eccentricity")


def shapes(labels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Measurements of form that need no neighbourhood but edges: see ``planes.hulls`` for those of hull and holes.

    Regions and inertia come from one aggregation of the pixels.
    """
    out = _figures(labels, keys).join(perimeters(labels, keys), [*keys, "label"])
    box = (F.col("`bbox-2`") - F.col("`bbox-0`")) * (F.col("`bbox-3`") - F.col("`bbox-1`"))
    guarded = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(NAN))
    return out.withColumns({
        "circularity": guarded(4 * PI * F.col("area"), F.pow("perimeter", F.lit(2.0))), "roundness": guarded(4 * F.col("area"), PI * F.pow("major_axis_length", F.lit(2.0))),
        "aspect_ratio": guarded(F.col("major_axis_length"), F.col("minor_axis_length")), "extent": guarded(F.col("area"), box), "equivalent_diameter": F.sqrt(4 * F.col("area") / PI),
    })


def rotational_volumes(labels: DataFrame, size_y: float = 1.0, size_x: float = 1.0, keys: Sequence[str] = FRAME) -> DataFrame:
    """The volume of each object turned about its long axis: bins of one pixel along it, a disk of each bin's width.

    Pixels are dealt by object once; the figures they are seen against are windows over that.
    """
    own = Window.partitionBy(*keys, "label")
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    turn = F.atan2(2 * F.covar_pop(x, y).over(own), F.var_pop(x).over(own) - F.var_pop(y).over(own)) / 2
    rows = labels.where("label <> 0").select(*keys, "label", (y - F.avg("y").over(own)).alias("dy"), (x - F.avg("x").over(own)).alias("dx"), turn.alias("turn"))
    cos, sin = F.cos("turn"), F.sin("turn")
    placed = rows.select(*keys, "label", (F.col("dx") * cos + F.col("dy") * sin).alias("u"), (F.col("dy") * cos - F.col("dx") * sin).alias("v"))
    binned = placed.select(*keys, "label", "v", F.floor(F.col("u") - F.min("u").over(own)).alias("bin"))
    bins = binned.groupBy(*keys, "label", "bin").agg((F.max("v") - F.min("v") + 1).alias("w"))
    voxels = bins.groupBy(*keys, "label").agg(F.sum(F.lit(PI) * F.pow(F.col("w") / 2, F.lit(2.0))).alias("cell_vol_vox"))
    return voxels.withColumn("cell_vol_fl", F.col("cell_vol_vox") * (size_y * size_x * size_x))


def intensities(pixels: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Statistics of the channel over each object, quantiles exact, and its coefficient of variation (population)."""
    q = F.expr(f"percentile(value, array({', '.join(str(v) for v in QUANTILES.values())}))")
    rows = pixels.where("label <> 0").groupBy(*keys, "label")
    out = rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("sd"), q.alias("q"))
    cv = F.when(F.col("n") < 2, NAN).otherwise(F.coalesce(F.try_divide(F.col("sd"), F.col("mean")), F.lit(NAN)))
    return out.select(*keys, "label", "mean", "sum", "min", "max", *(F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)), cv.alias("CV"), F.col("n").alias("area"))


#: What is known of a background, by the ending of its column.
BACKGROUND = {"median": 0.5, "mean": None, "q75": 0.75, "q25": 0.25, "q95": 0.95, "q05": 0.05}


def background_figures(values: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``<name>_bkgrVal_median`` and so on of all ``value`` of a key."""
    levels = [v for v in BACKGROUND.values() if v is not None]
    q = F.expr(f"percentile(value, array({', '.join(map(str, levels))}))").alias("__q")
    found = values.groupBy(*keys).agg(q, F.avg("value").alias("__mean"))
    column = lambda c, v: F.col("__mean") if v is None else F.col("__q")[levels.index(v)]
    return found.select(*keys, *(column(c, v).alias(f"{name}_bkgrVal_{c}") for c, v in BACKGROUND.items()))


def _with_background(out: DataFrame, figures: DataFrame | None, keys: Sequence[str], name: str, centre: str = "median") -> DataFrame:
    names = [f"{name}_bkgrVal_{c}" for c in BACKGROUND]
    out = out.withColumns({c: F.lit(NAN) for c in names}) if figures is None else out.join(figures, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(NAN)) for c in names})
    return out.withColumn(f"amount_{name}", (F.col("mean") - F.col(f"{name}_bkgrVal_{centre}")) * F.col("area"))


def corrected(pixels: DataFrame, keys: Sequence[str] = FRAME, roi: Column | DataFrame | None = None, manual: DataFrame | None = None, archive: DataFrame | None = None) -> DataFrame:
    """Intensities with amounts above background, per object: automatic (median of all pixels of no object), of regions, manual (mean).

    ``roi`` is a condition, or a table of each position's regions (see ``areas``), of which the pixels of no object count; where
    ``archive`` (``*keys, value``) has values of a frame, these count instead. ``manual`` is a second label image, whose object of the same
    label is the background. What is known of each background comes as ``<background>_bkgrVal_<figure>``; one without pixels gives NaN.
    """
    out = _with_background(intensities(pixels, keys), background_figures(pixels.where("label = 0"), keys, "autoBkgr"), keys, "autoBkgr")
    if roi is not None or archive is not None:
        regional = None
        if roi is not None:
            free = pixels.where((F.col("label") == 0) & roi) if isinstance(roi, Column) else areas.background_pixels(pixels, roi, [k for k in keys if k in roi.columns])
            regional = free.select(*keys, "value")
        if archive is not None:
            given = archive.select(*keys, "value")
            regional = given if regional is None else regional.join(given.select(*keys).distinct(), list(keys), "left_anti").unionByName(given)
        out = _with_background(out, background_figures(regional, keys, "dataPrepBkgr"), keys, "dataPrepBkgr")
    if manual is not None:
        axes = [c for c in ("z", "y", "x") if c in manual.columns and c in pixels.columns]
        under = manual.where("label <> 0").select(*keys, *axes, "label").join(pixels.select(*keys, *axes, "value"), [*keys, *axes])
        out = _with_background(out, background_figures(under, [*keys, "label"], "manualBkgr"), [*keys, "label"], "manualBkgr", "mean")
        out = out.withColumn("mean_manualBkgr", F.col("mean") - F.col("manualBkgr_bkgrVal_mean"))
    return out


def concentrations(measured: DataFrame, amounts: Sequence[str], volumes: Sequence[str] = ("vox", "fl")) -> DataFrame:
    """``concentration_<background>_from_vol_<unit>``: amounts by volume; by 0 it is infinite or NaN."""
    return measured.withColumns({f"concentration_{a.removeprefix('amount_')}_from_vol_{v}": divide(col(a), F.col(f"cell_vol_{v}").cast("double")) for a in amounts for v in volumes})


def velocities(regions_: DataFrame, size_y: float = 1.0, size_x: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """How far an object's centroid moved since the frame right before, in pixels and micrometres; NaN if it was not there."""
    w = Window.partitionBy(*keys, "label").orderBy("frame_i")
    there = F.lag("frame_i").over(w) == F.col("frame_i") - 1
    dy, dx = (F.col(f"`{c}`") - F.lag(F.col(f"`{c}`")).over(w) for c in ("centroid-0", "centroid-1"))
    length = lambda a, b: F.when(there, F.sqrt(a * a + b * b)).otherwise(NAN)
    return regions_.withColumns({"velocity_pixel": length(dy, dx), "velocity_um": length(dy * size_y, dx * size_x)})


def disappearances(labels: DataFrame, n_frames: int | DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Objects by frame, and whether each is gone in the next (never so in the last of ``n_frames``, or of its position's in a table)."""
    rows = labels.where("label <> 0").select(*keys, "frame_i", "label").distinct()
    if isinstance(n_frames, DataFrame):
        rows, last = rows.join(n_frames.select(*keys, F.col("n_frames").alias("__n")), list(keys)), F.col("__n")
    else:
        last = F.lit(n_frames)
    following = F.lead("frame_i").over(Window.partitionBy(*keys, "label").orderBy("frame_i"))
    gone = (F.col("frame_i") < last - 1) & F.coalesce(following != F.col("frame_i") + 1, F.lit(True))
    return rows.withColumn("disappears_before_end", gone.cast("int")).drop("__n")


def inspect(pixels: DataFrame, frame: int, label: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """Area, centroid, bounding box (last row and column included), mean and sum of one object."""
    one = pixels.where((F.col("frame_i") == frame) & (F.col("label") == label)).groupBy(*keys, "label")
    return one.agg(
        F.count("*").alias("area"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), F.min("y").alias("y_min"), F.min("x").alias("x_min"),
        F.max("y").alias("y_max"), F.max("x").alias("x_max"), F.avg("value").alias("mean"), F.sum("value").alias("sum"),
    )


def allowed(name: str, channel: str, variant: str = "", save: Sequence[str] | None = None, skip: Sequence[str] = ()) -> bool:
    """Whether a channel's metric is wanted: by its suffix, suffix and variant, or full header, in any case; skipping counts more."""
    full = f"{channel}_{name}{variant}"
    is_in = lambda names: any(n.strip().lower() in {name.lower(), f"{name}{variant}".lower(), full.lower()} for n in names)
    return not is_in(skip) and (save is None or is_in(save))


def variants(volume: DataFrame, labels: DataFrame, slices: DataFrame | int, keys: Sequence[str] = (), every_slice: Sequence[int] = (), labels_3d: DataFrame | None = None) -> dict[str, DataFrame]:
    """A channel with depth as what is measured of it: maximum, mean, the chosen slice, single slices that are asked for, and all voxels.

    ``volume`` is ``frame_i, z, y, x, value``; ``labels`` (``frame_i, y, x, label``) join each plane, 0 where they have
    none; ``slices`` is one slice, or a table of each frame's (``frame_i, z``). With ``labels_3d`` (``frame_i, z, y, x, label``) the
    voxels themselves are the variant ``_3D``.
    """
    at = [*keys, "frame_i"]
    if isinstance(slices, int):
        chosen = volume.where(F.col("z") == slices)
    else:
        chosen = volume.join(slices.select(*at, "z"), [*at, "z"])
    planes_of = {"_maxProj": project(volume, "max", keys=at), "_meanProj": project(volume, "mean", keys=at), "_zSlice": chosen.select(*at, "y", "x", "value")}
    planes_of |= {f"_zSlice{z}": project(volume, "single", z, keys=at) for z in every_slice}
    labelled = lambda p, own, axes: p.join(own.select(*at, *axes, "label"), [*at, *axes], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    out = {v: labelled(p, labels, ["y", "x"]) for v, p in planes_of.items()}
    return out if labels_3d is None else out | {DEEP: labelled(volume.select(*at, "z", "y", "x", "value"), labels_3d, ["z", "y", "x"])}


#: How the columns of a channel end that is measured by voxels, and the sizes and shapes that can be left out.
DEEP = "_3D"
SIZES = ("cell_area_pxl", "cell_area_um2", "cell_vol_vox", "cell_vol_fl", "cell_vol_vox_3D", "cell_vol_fl_3D", "velocity_pixel", "velocity_um")


def _wanted(names: Sequence[str], chosen: Sequence[str] | None) -> list[str]:
    keep = None if chosen is None else {c.strip().lower() for c in chosen}
    return [n for n in names if keep is None or n.lower() in keep]


def measure(
    channels: dict[str, DataFrame | dict[str, DataFrame]], n_frames: int | DataFrame, time_increment: float = 1.0, size_y: float = 1.0, size_x: float = 1.0, keys: Sequence[str] = (), stop_frame: int | None = None,
    save: Sequence[str] | None = None, skip: Sequence[str] = (), with_hulls: bool = False, size_z: float = 1.0, rois: DataFrame | None = None, archives: dict[str, DataFrame] | None = None,
    manual: DataFrame | None = None, manual_3d: DataFrame | None = None, slice_count: int = 0, sizes: Sequence[str] | None = None, regionprops: Sequence[str] | None = None,
) -> DataFrame:
    """One row per object and frame: place, shape, volume, every channel's intensities, motion and annotation defaults.

    ``channels`` hold dense pixels (``frame_i, y, x, value, label``) of one label image; a channel with depth is given as
    its ``variants``, whose names end its columns. If one of them is ``_3D``, its voxels also give ``cell_vol_vox_3D`` and
    ``cell_vol_fl_3D``, which its concentrations are by, and with ``slice_count`` the objects' sizes on each slice.
    Backgrounds are automatic, and of ``rois`` (``*keys, roi_id, top, left, bottom, right``), of a channel's ``archives`` (``*keys,
    frame_i, value``, not for voxels) or of a second label image ``manual`` (``manual_3d`` for voxels). ``with_hulls`` adds the figures of convex hulls and holes.
    ``n_frames`` may be a table of each position's. Only what is wanted is in the plan: channels' metrics by ``save`` and
    ``skip``, sizes and motion by ``sizes``, shapes by ``regionprops`` (names of columns).
    """
    if not channels:
        raise ValueError("no channel is given")
    at = [*keys, "frame_i"]
    before = lambda p: p if stop_frame is None or p is None else p.where(F.col("frame_i") < stop_frame)
    kept = {(c, v): before(p) for c, given in channels.items() for v, p in (given.items() if isinstance(given, dict) else [("", given)])}
    flat = [p for (_, v), p in kept.items() if v != DEEP]
    deep = next((p for (_, v), p in kept.items() if v == DEEP), None)
    labels = flat[0].select(*at, "y", "x", "label") if flat else project_labels(deep, keys=at)
    limit = n_frames if isinstance(n_frames, DataFrame) or stop_frame is None else min(n_frames, stop_frame)
    own = _wanted(SIZES, sizes)
    shape_names = [c for c in shapes(labels, at).columns if c in SHAPES]
    asked = _wanted(shape_names, regionprops)
    out = (shapes(labels, at) if set(asked) - set(FIGURES) else _figures(labels, at)).drop(*(set(shape_names) - set(asked) - {"area"}))
    out = velocities(out, size_y, size_x, keys) if {"velocity_pixel", "velocity_um"} & set(own) else out
    out = out.drop(*({"velocity_pixel", "velocity_um"} - set(own)))
    out = out.join(disappearances(labels, limit, keys), [*at, "label"])
    by_volume = any(allowed(f"concentration_{b}_from_vol_{u}", c, v, save, skip) for c, v in kept if v != DEEP for b in ("autoBkgr", "dataPrepBkgr") for u in ("vox", "fl"))
    if by_volume or {"cell_vol_vox", "cell_vol_fl"} & set(own):
        out = out.join(rotational_volumes(labels, size_y, size_x, at), [*at, "label"])
    if deep is not None:
        counted = voxel_counts(deep, at).select(*at, "label", F.col("n_voxels").cast("double").alias("cell_vol_vox_3D"))
        out = out.join(counted.withColumn("cell_vol_fl_3D", F.col("cell_vol_vox_3D") * (size_z * size_y * size_x)), [*at, "label"], "left")
        if slice_count:
            out = out.join(slice_sizes(deep, slice_count, size_y * size_x, at), [*at, "label"], "left")
    if with_hulls:
        out = out.join(planes.hulls(labels, at), [*at, "label"])
    for (c, variant), p in kept.items():
        second, archive = before(manual_3d if variant == DEEP else manual), None if variant == DEEP else before((archives or {}).get(c))
        m = corrected(p, at, rois, second, archive).drop("area")
        backgrounds = [b for b in ("autoBkgr", "dataPrepBkgr") if f"amount_{b}" in m.columns]
        metrics = [n for n in m.columns if n not in (*at, "label") and allowed(n, c, variant, save, skip)]
        by = {f"concentration_{b}_from_vol_{u}": (f"amount_{b}", f"cell_vol_{u}{DEEP if variant == DEEP else ''}") for b in backgrounds for u in ("vox", "fl")}
        by = {n: x for n, x in by.items() if allowed(n, c, variant, save, skip)}
        amounts = {a: f"__{c}_{a}{variant}" for a, _ in by.values()}
        out = out.join(m.select(*at, "label", *(col(n).alias(f"{c}_{n}{variant}") for n in metrics), *(col(a).alias(n) for a, n in amounts.items())), [*at, "label"], "left" if variant == DEEP else "inner")
        out = out.withColumns({f"{c}_{n}{variant}": divide(col(amounts[a]), F.col(v)) for n, (a, v) in by.items()}).drop(*amounts.values())
    more = {"Cell_ID": F.col("label"), "time_seconds": F.col("frame_i") * F.lit(float(time_increment)), "time_minutes": F.col("frame_i") * F.lit(time_increment / 60), "time_hours": F.col("frame_i") * F.lit(time_increment / 3600)}
    more |= {n: v for n, v in {"cell_area_pxl": F.col("area"), "cell_area_um2": F.col("area") * F.lit(size_y * size_x)}.items() if n in own}
    unasked = {"cell_vol_vox", "cell_vol_fl", "cell_vol_vox_3D", "cell_vol_fl_3D"} - set(own)
    return out.withColumns(more | {k: F.lit(v) for k, v in ANNOTATION_DEFAULTS.items()}).drop("label", *unasked)
