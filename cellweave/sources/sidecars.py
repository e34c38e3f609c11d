"""Small files beside the images: metadata, slice choices, regions, tracks, edits, annotation definitions.

All are read by Spark, any number of positions at once; ``path`` tells them apart.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import MISSING

#: The order of keys at the top of a metadata file.
METADATA_ORDER = ("basename", "SizeT", "SizeZ", "SizeY", "SizeX", "TimeIncrement", "PhysicalSizeZ", "PhysicalSizeY", "PhysicalSizeX", "channel_0_name", "channel_1_name")


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, n, line)`` of text files, whole files per row until split."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return raw.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("n", "line"))


def read_metadata(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, key, value)``: of each line what is before the first comma and what is after; a repeated header ends a file, and of
    repeated keys the last counts.
    """
    rows = _lines(spark, path).select("path", "n", F.trim(F.split("line", ",", 2)[0]).alias("key"), F.trim(F.coalesce(F.get(F.split("line", ",", 2), F.lit(1)), F.lit(""))).alias("value"))
    head = F.first("key").over(Window.partitionBy("path").orderBy("n"))
    again = F.max((F.col("n") > 0) & (F.col("key") == F.col("head"))).over(Window.partitionBy("path").orderBy("n"))
    kept = rows.withColumn("head", head).withColumn("over", again).where("n > 0 and not over and key <> ''")
    return kept.groupBy("path", "key").agg(F.max_by("value", "n").alias("value"))


def metadata_summary(metadata: DataFrame) -> DataFrame:
    """One row per file: name, sizes, time increment (1 if not given) and physical sizes; and which segmentations have depth."""
    one = lambda k: F.max(F.when(F.col("key") == k, F.nullif("value", F.lit(""))))
    is_3d = F.map_from_entries(F.collect_list(F.when(F.col("key").endswith("_isSegm3D"), F.struct(F.regexp_replace("key", "_isSegm3D$", ""), F.lower("value").isin("true", "1", "yes")))))
    kinds = {"SizeT": "long", "SizeZ": "long", "TimeIncrement": "double", "PhysicalSizeZ": "double", "PhysicalSizeY": "double", "PhysicalSizeX": "double"}
    out = metadata.groupBy("path").agg(one("basename").alias("basename"), *(one(k).try_cast(t).alias(k) for k, t in kinds.items()), is_3d.alias("segm_is_3d"))
    return out.withColumn("TimeIncrement", F.coalesce("TimeIncrement", F.lit(1.0)))


def metadata_lines(values: dict[str, object]) -> list[tuple[str, str]]:
    """Key and value of a metadata file, known keys first in their order, others by name."""
    known = [k for k in METADATA_ORDER if k in values]
    return [(k, str(values[k])) for k in [*known, *sorted(set(values) - set(known))]]


def read_slices(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Slice choices per file and frame; former header names, rows that lack a required value and later duplicates are dealt with."""
    raw = spark.read.csv(path, header=True, enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.withColumnsRenamed({"Unnamed: 0": "filename", "Unnamed: 1": "frame_i", "_c0": "filename", "_c1": "frame_i"})
    required = ("filename", "frame_i", "z_slice_used_dataPrep", "which_z_proj", "is_from_dataPrep")
    lacking = [c for c in required if c not in raw.columns]
    if lacking:
        raise ValueError(f"missing column {lacking[0]!r}")
    rows = raw.withColumn("_row_id", F.monotonically_increasing_id())
    for c in required:
        rows = rows.where(F.col(c).isNotNull() & ~F.lower(F.col(c)).isin(*MISSING))
    rows = rows.where("filename <> 'filename' or frame_i <> 'frame_i'")
    z, proj = F.col("z_slice_used_dataPrep").cast("double").cast("long"), F.col("which_z_proj")
    other = lambda c, default: F.coalesce(F.when(~F.lower(F.col(c)).isin(*MISSING), F.col(c)), default.cast("string")) if c in raw.columns else default.cast("string")
    out = rows.select(
        "filename", F.col("frame_i").cast("double").cast("long").alias("frame_i"), z.alias("z_slice_used_dataPrep"), proj.alias("which_z_proj"),
        other("z_slice_used_gui", z).cast("double").cast("long").alias("z_slice_used_gui"), other("which_z_proj_gui", proj).alias("which_z_proj_gui"),
        F.lower("is_from_dataPrep").isin("true", "1", "yes").alias("is_from_dataPrep"), "_row_id",
    )
    first = Window.partitionBy("filename", "frame_i").orderBy("_row_id")
    return out.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def read_crop_rois(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, roi_id, top, left, bottom, right, cropped)`` of regions that are not empty; a missing far edge makes one empty."""
    raw = spark.read.csv(path, header=True, enforceSchema=False).withColumn("path", F.col("_metadata.file_path"))
    value = lambda d: F.max(F.when(F.col("description") == d, F.trim("value").cast("long")))
    roi = F.coalesce(F.trim("roi_id").cast("long"), F.lit(0)) if "roi_id" in raw.columns else F.lit(0).cast("long")
    out = raw.groupBy("path", roi.alias("roi_id")).agg(*(F.coalesce(value(d), F.lit(0)).alias(n) for d, n in (("y_top", "top"), ("x_left", "left"), ("y_bottom", "bottom"), ("x_right", "right"), ("cropped", "cropped"))))
    return out.where("`right` > `left` and bottom > top").withColumn("cropped", F.col("cropped") > 0)


def crop_rois_long(rois: DataFrame) -> DataFrame:
    """Regions as a file holds them: ``(roi_id, description, value)``."""
    pairs = [("x_left", "left"), ("x_right", "right"), ("y_top", "top"), ("y_bottom", "bottom"), ("cropped", "cropped")]
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("description"), F.col(c).cast("long").alias("value")) for d, c in pairs)))
    return rois.select("roi_id", each.alias("e")).select("roi_id", "e.description", "e.value")


def read_background_rois(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(path, n, top, left, bottom, right)`` of a JSON list of regions, each with ``pos`` and ``size`` or a ``state`` that has them."""
    shape = "array<struct<pos: array<double>, size: array<double>, state: struct<pos: array<double>, size: array<double>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.from_json("value", shape)).alias("n", "r"))
    pos, size = F.coalesce("r.pos", "r.state.pos"), F.coalesce("r.size", "r.state.size")
    at = lambda v, i: F.round(v[i]).cast("long")
    return raw.select("path", "n", at(pos, 1).alias("top"), at(pos, 0).alias("left"), (at(pos, 1) + at(size, 1)).alias("bottom"), (at(pos, 0) + at(size, 0)).alias("right"))


def read_trackmate(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(frame_i, ID, x, y, z)`` of a tracks file in XML; a particle's ID is its place in the file, from 1."""
    raw = spark.read.format("xml").option("rowTag", "Tracks").load(path)
    particles = raw.select(F.col("_metadata.file_path").alias("path"), F.posexplode("particle").alias("p", "particle"))
    rows = particles.select("path", (F.col("p") + 1).cast("long").alias("ID"), F.explode("particle.detection").alias("d"))
    return rows.select(F.col("d._t").cast("long").alias("frame_i"), "ID", *(F.col(f"d._{a}").cast("double").alias(a) for a in "xyz"))


def read_lineage_edits(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A JSON list of edits as a table."""
    return spark.read.json(path, multiLine=True)


def annotation_definitions(text: str) -> dict[str, dict]:
    """Custom annotations by name, in present or former field names, with defaults for what is not given."""
    kinds = {"single time-point": "single", "multiple time-points": "multiple", "multiple values class": "class"}
    out = {}
    for name, d in json.loads(text).items():
        kind = str(d.get("kind", d.get("type", "single"))).strip().lower()
        out[name] = {
            "kind": kinds.get(kind, kind), "symbol": str(d.get("symbol", "o")).strip("'"), "colour": d.get("color", d.get("symbolColor", [255, 0, 0])),
            "shortcut": d.get("shortcut", ""), "description": d.get("description", ""), "keep_active": bool(d.get("keep_active", d.get("keepActive", True))),
            "hide": bool(d.get("hide", d.get("isHideChecked", True))),
        }
    return out
