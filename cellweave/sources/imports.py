"""An import plan carried out: every position's channels as files of one name scheme, and its metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources import sinks
from cellweave.sources.arrays import file_bytes, probe, read_planes
from cellweave.sources.named import save_files, save_lines


def channel_files(spark: SparkSession, plan: DataFrame, basename: str = "", frames: tuple[int, int] | None = None, size_z: int | None = None, fmt: str = "tif") -> DataFrame:
    """``(position, channel, name, content, SizeT, SizeZ, SizeY, SizeX)``: each channel of a plan (``layout.import_plan``) as a file of its source's type.

    Planes of the plan's files are read by their places. A file that the plan gives a frame is that frame; others have their own. ``frames``
    keeps a range, its end excluded, and counts from its start. A position's files begin with ``basename``, or ``s<nn>_`` without one. A task
    holds one channel of one position.
    """
    planes = read_planes(spark, plan, size_z=size_z).drop("name")
    placed = planes.join(plan.select("path", "position", "channel", F.col("frame_i").alias("__frame")), "path").withColumn("frame_i", F.coalesce("__frame", "frame_i"))
    if frames is not None:
        placed = placed.where((F.col("frame_i") >= frames[0]) & (F.col("frame_i") < frames[1])).withColumn("frame_i", F.col("frame_i") - frames[0])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_i", "z", "path"]).drop_duplicates(["frame_i", "z"])
        first = rows.iloc[0]
        size = [int(rows[c].max()) + 1 for c in ("frame_i", "z")] + [int(first["height"]), int(first["width"])]
        image = np.zeros(size, first["dtype"])
        for t, z, plane in zip(rows["frame_i"], rows["z"], rows["data"]):
            image[t, z] = np.asarray(plane).reshape(size[2:])
        number = int(first["position"].rsplit("_", 1)[1])
        name = f"{first['position']}/Images/{basename or f's{number:02d}_'}{first['channel']}.{fmt}"
        content = file_bytes({"arr_0": image.reshape([n for n in size[:2] if n > 1] + size[2:])}, fmt)
        return pd.DataFrame([(first["position"], first["channel"], name, content, *size)], columns=["position", "channel", "name", "content", "SizeT", "SizeZ", "SizeY", "SizeX"])

    return placed.groupBy("position", "channel").applyInPandas(run, "position string, channel string, name string, content binary, SizeT long, SizeZ long, SizeY long, SizeX long")


def carry_out(spark: SparkSession, plan: DataFrame, folder: str, basename: str = "", frames: tuple[int, int] | None = None, size_z: int | None = None, fmt: str = "tif", metadata: dict[str, object] | None = None) -> DataFrame:
    """Writes the files of ``channel_files`` and each position's metadata under ``folder``; returns ``(position, channel, name)``.

    Metadata are the sizes (largest of the channels, from the headers of what was written), the basename, the channels in their order of names, and what ``metadata`` adds.
    """
    save_files(channel_files(spark, plan, basename, frames, size_z, fmt).select("name", "content"), "name", folder)
    written = files_written(plan, folder, basename, fmt)
    pages = F.aggregate(F.slice("shape", 1, F.size("shape") - 2), F.lit(1).cast("long"), lambda a, n: a * n)
    own = probe(spark, written).withColumns({"position": F.regexp_extract("path", r"/(Position_\d+)/Images/", 1), "leaf": F.element_at(F.split("path", "/"), -1), "pages": pages})
    start = _start(basename)
    channel = F.expr(f"substr(leaf, length(start) + 1, length(leaf) - length(start) - {len(fmt) + 1})")
    known = own.withColumn("start", start).groupBy("position", "start").agg(
        F.max((F.col("pages") / (size_z or 1)).cast("long")).alias("SizeT"), F.lit(size_z or 1).alias("SizeZ"), F.max(F.element_at("shape", -2)).alias("SizeY"), F.max(F.element_at("shape", -1)).alias("SizeX"), F.array_sort(F.collect_set(channel)).alias("channels")
    )
    pairs = [F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (("basename", "start"), *((n, n) for n in ("SizeT", "SizeZ", "SizeY", "SizeX")))]
    pairs += [F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in (metadata or {}).items()]
    named = F.transform("channels", lambda c, i: F.struct(F.concat(F.lit("channel_"), i.cast("string"), F.lit("_name")).alias("key"), c.alias("value")))
    lines = known.select(F.concat("position", F.lit("/Images/"), "start", F.lit("metadata.csv")).alias("path"), F.explode(F.concat(F.array(*pairs), named)).alias("e")).select("path", "e.key", "e.value")
    save_lines(sinks.metadata_rows(lines), folder)
    return written.select("position", "channel", F.substring("path", len(folder) + 2, 1 << 20).alias("name"))


def _start(basename: str) -> Column:
    return F.lit(basename) if basename else F.concat(F.lit("s"), F.lpad(F.regexp_extract("position", r"(\d+)$", 1), 2, "0"), F.lit("_"))


def files_written(plan: DataFrame, folder: str, basename: str, fmt: str) -> DataFrame:
    """``(position, channel, path)`` of every channel's file under ``folder``."""
    return plan.select("position", "channel").distinct().select("position", "channel", F.concat(F.lit(f"{folder}/"), "position", F.lit("/Images/"), _start(basename), "channel", F.lit(f".{fmt}")).alias("path"))
