"""Which files an experiment's positions have, from a listing that Spark makes; contents are not read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators.combine import natural_key
from cellweave.operators.order import numbered

#: Endings of channel files, the preferred first.
CHANNEL_ENDINGS = ("_aligned.h5", ".h5", "_aligned.npz", "_aligned.npy", ".tif", ".tiff", ".npy")
#: Parts of names that no channel file has.
NOT_CHANNELS = ("segm", "_output", "bkgrRoiData", "dataPrep", "metadata", "align_shift")
SOURCES = {"npy": "npy", "npz": "npz", "h5": "h5", "tif": "tiff", "tiff": "tiff"}
VENDORS = ("czi", "lif", "nd2", "oib", "oif", "ims", "lsm", "zvi", "dv", "vsi")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, position, name)`` of the files in ``Position_*/Images``; hidden and recovery files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rows = raw.select("path", F.regexp_extract("path", r"/(Position_\d+)/", 1).alias("position"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return rows.where("position <> '' and path like '%/Images/%' and not name like '.%' and not path like '%/recovery/%'")


def basenames(files: DataFrame) -> DataFrame:
    """``(position, basename)``: what the names of all image files begin with, up to an underscore."""
    images = files.where(_is_image(F.col("name")) & ~_named(F.col("name"), "segm", "_output"))
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    ends = images.groupBy("position").agg(F.min(stem).alias("a"), F.max(stem).alias("z"))
    common = F.expr("aggregate(sequence(1, least(length(a), length(z))), 0, (n, i) -> if(n = i - 1 and substr(a, i, 1) = substr(z, i, 1), i, n))")
    prefix = F.expr("substr(a, 1, n)")
    return ends.withColumn("n", common).where("n > 0").select("position", F.when(prefix.endswith("_"), prefix).otherwise(F.concat(prefix, F.lit("_"))).alias("basename"))


def _is_image(name: Column) -> Column:
    return name.rlike(r"(\.tif|\.tiff|_aligned\.npz|\.npy|\.h5)$")


def _named(name: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out |= name.contains(p)
    return out


def channels(files: DataFrame, bases: DataFrame) -> DataFrame:
    """``(position, channel, path)``: the preferred file of each channel."""
    rows = files.join(bases, "position").where("startswith(name, basename)")
    rows = rows.withColumn("rest", F.expr("substr(name, length(basename) + 1)")).where(~_named(F.col("rest"), *NOT_CHANNELS))
    ending = F.coalesce(*(F.when(F.col("rest").endswith(e), F.struct(F.lit(i).alias("rank"), F.expr(f"substr(rest, 1, length(rest) - {len(e)})").alias("channel"))) for i, e in enumerate(CHANNEL_ENDINGS)))
    rows = rows.withColumn("e", ending).where("e is not null and trim(e.channel) <> ''")
    return rows.groupBy("position", F.col("e.channel").alias("channel")).agg(F.min_by("path", F.struct("e.rank", "path")).alias("path"))


def by_end(files: DataFrame, ending: str) -> DataFrame:
    """``(position, path)``: of the files whose name (without its extension) ends so, the shortest name, then the first as people sort."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    rows = files.where(stem.endswith(ending) | F.col("name").endswith(ending)).withColumn("__key", natural_key("name"))
    first = Window.partitionBy("position").orderBy(F.length("name"), "__key")
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").select("position", "path")


def positions(files: DataFrame) -> DataFrame:
    """One row per position in order of its number: name, channels and sidecars (null where there is none)."""
    bases = basenames(files)
    own = channels(files, bases).groupBy("position").agg(F.array_sort(F.collect_list("channel")).alias("channels"), F.map_from_entries(F.collect_list(F.struct("channel", "path"))).alias("images"))
    out = bases.join(own, "position")
    for column, ending in (("metadata", "metadata.csv"), ("slices", "segmInfo.csv"), ("rois", "dataPrepROIs_coords.csv"), ("background_rois", "dataPrep_bkgrROIs.json"), ("free_roi", "dataPrepFreeRoi.npz")):
        out = out.join(by_end(files, ending).withColumnRenamed("path", column), "position", "left")
    return out.withColumn("number", F.regexp_extract("position", r"(\d+)$", 1).cast("long")).orderBy("number")


def import_sources(spark: SparkSession, root: str) -> DataFrame:
    """``(path, kind)`` of every image file below a folder, of whatever maker."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*(F.lit(x) for k, v in SOURCES.items() for x in (k, v)))[ending]
    return raw.select("path", F.coalesce(kind, F.when(ending.isin(*VENDORS), "vendor")).alias("kind")).where("kind is not null and not path like '%/.%'")


#: How an experiment's files are laid out: see ``import_plan``.
LAYOUTS = ("file per position", "file per channel", "file per frame", "custom")


def import_plan(sources: DataFrame, layout: str = "file per position", separator: str = "_", pattern: str = "") -> DataFrame:
    """``(path, position, channel, frame_i)``: which position, channel and frame each file is.

    "file per position": each file is one, in natural order of names. "file per channel": names before the last separator are
    positions, what follows channels. "file per frame": names as before, without a number at their end, which orders the frames of a position's
    channel. "custom": ``pattern`` is a regular expression with the groups ``position`` and, if there are several, ``channel`` and ``frame``;
    files that it does not match go. Positions are numbered by ranges of names, so no task sees them all; frames are null where a file has all.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"no such layout: {layout}")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    named, frame = sources.select("path", stem.alias("stem")), F.lit(None).cast("string")
    last = lambda c: (F.regexp_extract(c, f"^(.*){separator}[^{separator}]*$", 1), F.regexp_extract(c, f"([^{separator}]*)$", 1))
    if layout == "file per position":
        group, channel = F.concat("stem", F.lit("\0"), "path"), F.lit("channel_0")
    elif layout == "custom":
        names = {n: i for n, i in re.compile(pattern).groupindex.items()}
        if "position" not in names:
            raise ValueError("the pattern has no group called position")
        java = pattern.replace("(?P<", "(?<")
        named = named.where(F.col("stem").rlike(java))
        found = {n: F.regexp_extract("stem", java, i) for n, i in names.items()}
        group, channel, frame = found["position"], found.get("channel", F.lit("channel_0")), found.get("frame", frame)
    else:
        body = F.col("stem")
        if layout == "file per frame":
            frame, body = F.regexp_extract("stem", r"(\d+)$", 1), F.regexp_replace("stem", rf"{separator}?\d+$", "")
        group, channel = last(body)
    rows = named.select("path", group.alias("group"), channel.alias("channel"), frame.alias("frame"))
    places = numbered(rows.select("group").distinct().withColumn("key", natural_key("group")), ["key", "group"], "number").select("group", "number")
    rows = rows.join(places, "group")
    in_channel = Window.partitionBy("group", "channel").orderBy(natural_key("frame"), natural_key("path"), "path")
    frame_i = F.when(F.col("frame").isNotNull() & (F.col("frame") != ""), F.row_number().over(in_channel) - 1).cast("long")
    return rows.select("path", F.concat(F.lit("Position_"), F.col("number").cast("string")).alias("position"), "channel", frame_i.alias("frame_i"))
