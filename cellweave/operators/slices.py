"""Which z slice of each frame counts: the table's defaults, edits and filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a volume may be flattened.
PROJECTIONS = ("single z-slice", "max z-projection", "mean z-projection", "median z-proj.")
PICKED = ("z_slice_used_dataPrep", "z_slice_used_gui", "which_z_proj", "which_z_proj_gui")


def defaults(channels: DataFrame, size_t: int, size_z: int) -> DataFrame:
    """A row per channel ``filename`` and frame, on the middle slice."""
    middle, single = F.lit(size_z // 2).cast("long"), F.lit(PROJECTIONS[0])
    rows = channels.select("filename", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size_t - 1).cast("long"))).alias("frame_i"))
    return rows.withColumns({"z_slice_used_dataPrep": middle, "which_z_proj": single, "z_slice_used_gui": middle, "which_z_proj_gui": single, "is_from_dataPrep": F.lit(False)})


def first_of_frames(df: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """The first row of each file and frame."""
    w = Window.partitionBy("filename", "frame_i").orderBy(row_id)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def clamp(df: DataFrame, size_z: int) -> DataFrame:
    """Slices beyond the volume become the middle one."""
    inside = lambda c: F.when((F.col(c) >= size_z) | (F.col(c) < 0), F.lit(size_z // 2).cast("long")).otherwise(F.col(c))
    return df.withColumns({c: inside(c) for c in PICKED[:2]})


def edit(df: DataFrame, filename: str, frame: int, z: int, projection: str = PROJECTIONS[0]) -> DataFrame:
    """One frame's choice."""
    if projection not in PROJECTIONS:
        raise ValueError(f"no such projection: {projection}")
    at = (F.col("filename") == filename) & (F.col("frame_i") == frame)
    new = {c: F.lit(z).cast("long") if "slice" in c else F.lit(projection) for c in PICKED} | {"is_from_dataPrep": F.lit(True)}
    return df.withColumns({c: F.when(at, v).otherwise(F.col(c)) for c, v in new.items()})


def spread(df: DataFrame, filename: str, anchor: int, mode: str) -> DataFrame:
    """An anchor frame's choice on all later ("forward") or earlier ("backward") frames of its file; or ("linear") slices between the
    frames before and after it, halves rounded up. With a frame on one side only, linear fills from the anchor to the other.
    """
    if mode not in ("forward", "backward", "linear"):
        raise ValueError(f"no such mode: {mode}")
    own = Window.partitionBy("filename")
    here = F.col("filename") == filename
    frame, z = F.col("frame_i"), F.col(PICKED[0])
    at = F.max(F.when(frame == anchor, F.struct(*PICKED))).over(own)
    before = F.max_by(F.when(frame < anchor, F.struct("frame_i", z.alias("z"))), F.when(frame < anchor, frame)).over(own)
    after = F.min_by(F.when(frame > anchor, F.struct("frame_i", z.alias("z"))), F.when(frame > anchor, frame)).over(own)
    marked = df.withColumns({"__at": at, "__a": before, "__b": after})
    fails = F.raise_error(F.lit(f"no row for frame {anchor} of {filename}"))
    marked = marked.withColumn("__at", F.when(here & F.col("__at").isNull(), fails.cast(marked.schema["__at"].dataType)).otherwise(F.col("__at")))
    both, lone_before, lone_after = F.col("__a").isNotNull() & F.col("__b").isNotNull(), F.col("__b").isNull() & F.col("__a").isNotNull(), F.col("__a").isNull() & F.col("__b").isNotNull()
    forward = here & (frame >= anchor) & (F.lit(mode == "forward") | (F.lit(mode == "linear") & lone_before))
    backward = here & (frame <= anchor) & (F.lit(mode == "backward") | (F.lit(mode == "linear") & lone_after))
    between = here & F.lit(mode == "linear") & both & (frame >= F.col("__a.frame_i")) & (frame <= F.col("__b.frame_i"))
    t = ((frame - F.col("__a.frame_i")).cast("float") / (F.col("__b.frame_i") - F.col("__a.frame_i")).cast("float")).cast("float")
    line = F.round((F.lit(1.0).cast("float") - t) * F.col("__a.z").cast("float") + t * F.col("__b.z").cast("float")).cast("long")
    value = lambda c: F.when(forward | backward, F.col(f"__at.{c}")).when(between, line if "slice" in c else F.lit(PROJECTIONS[0])).otherwise(F.col(c))
    touched = F.when(forward | backward | between, F.lit(True)).otherwise(F.col("is_from_dataPrep"))
    return marked.withColumns({c: value(c) for c in PICKED} | {"is_from_dataPrep": touched}).drop("__at", "__a", "__b")


def with_slices(pixels: DataFrame, info: DataFrame, filename: str) -> DataFrame:
    """A volume's pixels on each frame's own slice."""
    own = info.where(F.col("filename") == filename).select("frame_i", F.col(PICKED[0]).alias("z"))
    return pixels.join(own, ["frame_i", "z"], "left_semi").drop("z")
