"""Rectangles of an image as a table of their own: which pixels lie in which, cutting them out, and backgrounds measured in them.

A region is a row ``(…, roi_id, top, left, bottom, right)``, its last row and column excluded. Regions and pixels meet by the
squares of a grid: a region names each square it touches, a pixel the one it is in, so the join is one of equal keys and every pair
of a pixel and a region it lies in comes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.combine import natural_key
from cellweave.operators.order import numbered

POSITION = ("position",)
#: Side of a square of the grid, in pixels.
SQUARE = 64


def in_regions(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = POSITION, square: int = SQUARE) -> DataFrame:
    """Every pixel once for each region of its position that it lies in, with ``roi_id``, ``top`` and ``left``."""
    at = lambda c: F.floor(F.col(c) / square)
    first = lambda c: F.floor(F.greatest(F.col(c), F.lit(0)) / square)
    last = lambda c: F.floor((F.col(c) - 1) / square)
    real = rois.where("bottom > top and `right` > `left` and bottom > 0 and `right` > 0")
    squares = real.select(*keys, "roi_id", "top", "left", "bottom", "right", F.explode(F.sequence(first("top"), last("bottom"))).alias("__qy")).withColumn("__qx", F.explode(F.sequence(first("left"), last("right"))))
    placed = pixels.withColumns({"__qy": at("y"), "__qx": at("x")})
    met = placed.join(squares, [*keys, "__qy", "__qx"]).where("y >= top and y < bottom and x >= `left` and x < `right`")
    return met.select(*pixels.columns, "roi_id", "top", "left")


def crop_regions(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """Every region as an image of its own (``roi_id``), from its corner on; a corner outside the image counts as 0."""
    corner = lambda c: F.greatest(F.col(c), F.lit(0))
    return in_regions(pixels, rois, keys).withColumns({"y": F.col("y") - corner("top"), "x": F.col("x") - corner("left")}).drop("top", "left")


def new_positions(rois: DataFrame, positions: DataFrame) -> DataFrame:
    """``rois`` with ``target``, the position that each is cut out to.

    A position's only region stays where it is. Several become positions of their own, ``Position_<n>``, counting on from the
    largest number there is, in the natural order of positions and then of regions.
    """
    taken = positions.agg(F.max(F.regexp_extract("position", r"^Position_(\d+)$", 1).try_cast("long"))).first()[0] or 0
    several = rois.groupBy("position").agg(F.count("*").alias("__n"))
    counted = rois.join(several, "position")
    more = numbered(counted.where("__n > 1").withColumn("__key", natural_key("position")), ["__key", "position", "roi_id"], "__at")
    more = more.select(*rois.columns, F.concat(F.lit("Position_"), (F.col("__at") + taken).cast("string")).alias("target"))
    return counted.where("__n = 1").select(*rois.columns, F.col("position").alias("target")).unionByName(more)


def clipped(inner: DataFrame, crops: DataFrame) -> DataFrame:
    """Regions ``inner`` as the images cut out by ``crops`` (with ``target``) have them: moved to the crop's corner and kept within it.

    Returns ``(position, n, top, left, bottom, right)``, of which ``position`` is the crop's target; what is empty goes.
    """
    outer = crops.select("position", "target", F.greatest("top", F.lit(0)).alias("t"), F.greatest("left", F.lit(0)).alias("l"), F.col("bottom").alias("b"), F.col("right").alias("r"))
    met = inner.withColumns({"top": F.greatest("top", F.lit(0)), "left": F.greatest("left", F.lit(0))}).join(outer, "position")
    within = lambda c, a, z: F.least(F.greatest(F.col(c) - F.col(a), F.lit(0)), F.col(z) - F.col(a))
    moved = met.select(F.col("target").alias("position"), "n", within("top", "t", "b").alias("top"), within("left", "l", "r").alias("left"), within("bottom", "t", "b").alias("bottom"), within("right", "l", "r").alias("right"))
    return moved.where("bottom > top and `right` > `left`")


def archives(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """What an archive of background regions holds: every region's pixels, objects included, as array ``roi<n>_data``."""
    return crop_regions(pixels, rois, keys).withColumn("name", F.concat(F.lit("roi"), F.col("roi_id").cast("string"), F.lit("_data"))).drop("roi_id")


def background_pixels(pixels: DataFrame, rois: DataFrame, keys: Sequence[str] = POSITION) -> DataFrame:
    """The pixels of no object (label 0) that lie in any region, each once."""
    own = rois.withColumn("roi_id", F.lit(0))
    met = in_regions(pixels.where("label = 0"), own, keys).drop("roi_id", "top", "left")
    axes = [c for c in ("frame_i", "z", "y", "x") if c in pixels.columns]
    return met.dropDuplicates([*keys, *axes])
