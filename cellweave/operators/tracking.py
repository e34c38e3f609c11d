"""Objects followed over frames by overlap, and label images renumbered from a tracking table.

The first steps are joins and aggregates over all frames at once. Tracking itself is a fold, as each frame is compared
with the *tracked* frame before it: one position's frames, in order, per task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import checkpointed

from cellweave.functions.coerce import col


def overlaps(labels: DataFrame, keys: Sequence[str] = (), denominator: str = "area_prev") -> DataFrame:
    """``(…, frame_i, curr, prev, n, ioa)``: pixels that an object shares with one of the frame before, by area (32-bit).

    The area is the former object's, or that of both together ("union").
    """
    if denominator not in ("area_prev", "union"):
        raise ValueError(f"no such denominator: {denominator}")
    at = [*keys, "frame_i"]
    rows = labels.where("label <> 0").select(*at, "y", "x", F.col("label").alias("curr"))
    before = rows.select(*keys, (F.col("frame_i") + 1).alias("frame_i"), "y", "x", F.col("curr").alias("prev"))
    pairs = rows.join(before, [*at, "y", "x"]).groupBy(*at, "curr", "prev").agg(F.count("*").alias("n"))
    areas = rows.groupBy(*at, "curr").agg(F.count("*").alias("area"))
    former = areas.select(*keys, (F.col("frame_i") + 1).alias("frame_i"), F.col("curr").alias("prev"), F.col("area").alias("prev_area"))
    out = pairs.join(former, [*at, "prev"])
    total = F.col("prev_area")
    if denominator == "union":
        out = out.join(areas, [*at, "curr"])
        total = F.col("prev_area") + F.col("area") - F.col("n")
    return out.select(*at, "curr", "prev", "n", (F.col("n") / total).cast("float").alias("ioa"))


def assignments(labels: DataFrame, threshold: float = 0.4, keys: Sequence[str] = (), denominator: str = "area_prev") -> DataFrame:
    """``(…, frame_i, old_id, new_id, ioa)``: for each frame, which object continues which of the frame before.

    An object takes the former one it overlaps most (the lowest, if it overlaps none); where several take one, all name the
    object that overlaps it most. Ties go to the lower id; overlaps under the threshold do not count.
    """
    at = [*keys, "frame_i"]
    rows = labels.where("label <> 0").select(*at, F.col("label").alias("curr")).distinct()
    former = rows.select(*keys, (F.col("frame_i") + 1).alias("frame_i"), F.col("curr").alias("prev"))
    pairs = overlaps(labels, keys, denominator)
    lowest = former.groupBy(*at).agg(F.min("prev").alias("lowest_prev")).join(rows.groupBy(*at).agg(F.min("curr").alias("lowest_curr")), at)
    best = pairs.groupBy(*at, "curr").agg(F.max_by("prev", F.struct("ioa", -F.col("prev"))).alias("prev"), F.max("ioa").alias("ioa"))
    best = rows.join(lowest, at).join(best, [*at, "curr"], "left")
    best = best.select(*at, "curr", "lowest_curr", F.coalesce("prev", "lowest_prev").alias("prev"), F.coalesce("ioa", F.lit(0.0).cast("float")).alias("ioa"))
    takers = best.groupBy(*at, "prev").agg(F.count("*").alias("takers"))
    chosen = pairs.groupBy(*at, "prev").agg(F.max_by("curr", F.struct("ioa", -F.col("curr"))).alias("chosen"))
    out = best.join(takers, [*at, "prev"]).join(chosen, [*at, "prev"], "left").where(F.col("ioa") >= F.lit(threshold).cast("float"))
    old = F.when(F.col("takers") == 1, F.col("curr")).otherwise(F.coalesce("chosen", "lowest_curr"))
    return out.select(*at, old.alias("old_id"), F.col("prev").alias("new_id"), "ioa")


def _renumbered(labels: np.ndarray, source: int, target: int) -> None:
    if source != target:
        labels[labels == source] = target


def track_step(prev: tuple[np.ndarray, np.ndarray], pixels: np.ndarray, labels: np.ndarray, threshold: float, union: bool, unique_new: bool) -> np.ndarray:
    """The labels of a frame's pixels as those of the tracked frame before; frames are (pixel, label), pixels ascending."""
    if not len(labels):
        return labels
    curr, prev_ids = np.unique(labels), np.unique(prev[1])
    taken: list[tuple[int, int]] = []
    if len(prev_ids):
        _, a, b = np.intersect1d(pixels, prev[0], assume_unique=True, return_indices=True)
        row, column = np.searchsorted(curr, labels[a]), np.searchsorted(prev_ids, prev[1][b])
        shared = np.zeros((len(curr), len(prev_ids)))
        np.add.at(shared, (row, column), 1)
        total = np.broadcast_to(np.array([(prev[1] == p).sum() for p in prev_ids], float), shared.shape)
        if union:
            total = total + np.array([(labels == c).sum() for c in curr], float)[:, None] - shared
        ioa = (shared / total).astype(np.float32)
        best = ioa.argmax(axis=1)
        takers = np.bincount(best, minlength=len(prev_ids))
        for r, c in enumerate(best):
            if ioa[r, c] >= np.float32(threshold):
                taken.append((int(curr[r] if takers[c] == 1 else curr[ioa[:, c].argmax()]), int(prev_ids[c])))
    named, goals = {o for o, _ in taken}, {n for _, n in taken}
    fresh = max(int(prev_ids.max(initial=0)), int(curr.max())) + 1
    free = [int(c) for c in curr if int(c) not in named]
    out = labels.copy()
    for k, c in enumerate(c for c in free if unique_new or c in goals):
        _renumbered(out, c, fresh + k)
    for old, new in taken:
        _renumbered(out, old, new)
    return out


def track(labels: DataFrame, keys: Sequence[str] = ("position",), threshold: float = 0.4, denominator: str = "area_prev", unique_new: bool = True, first_frame: int = 0) -> DataFrame:
    """``(…, frame_i, y, x, label)`` with labels that follow objects from frame to frame, from ``first_frame`` on.

    What continues nothing gets a number above all of its frame and the one before; or, without ``unique_new``, only if its
    own number is taken. A task holds the object pixels of one position.
    """
    shape = labels.select(*keys, "frame_i", "y", "x", "label").schema
    union = {"area_prev": False, "union": True}[denominator]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame_i", "y", "x"]).reset_index(drop=True)
        place = rows["y"].to_numpy(np.int64) << 32 | rows["x"].to_numpy(np.int64)
        label, frame = rows["label"].to_numpy(np.int64).copy(), rows["frame_i"].to_numpy(np.int64)
        first = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        prev = None
        for a, b in zip(first, [*first[1:], len(frame)]):
            none = (np.empty(0, np.int64), np.empty(0, np.int64))
            if frame[a] > first_frame:
                before = prev[1:] if prev and prev[0] == frame[a] - 1 else none
                label[a:b] = track_step(before, place[a:b], label[a:b], threshold, union, unique_new)
            prev = (frame[a], place[a:b], label[a:b])
        return rows.assign(label=label)

    return labels.where("label <> 0").select(*keys, "frame_i", "y", "x", "label").groupBy(*keys).applyInPandas(fold, shape)


def repeat(labels: DataFrame, start_frame: int, keys: Sequence[str] = ("position",), threshold: float = 0.4, denominator: str = "area_prev", unique_new: bool = True) -> DataFrame:
    """``(…, frame_i, y, x, label)``: frames from ``start_frame`` on tracked anew, from the labels of the one before, which stays as it is.

    Frames before that take no part in the fold. From frame 0 on, frame 0 itself is what the others follow.
    """
    anchor = max(0, start_frame - 1)
    rows = labels.where("label <> 0").select(*keys, "frame_i", "y", "x", "label")
    return rows.where(F.col("frame_i") < anchor).unionByName(track(rows.where(F.col("frame_i") >= anchor), keys, threshold, denominator, unique_new, anchor))


def repeat_and_measure(channels: dict[str, DataFrame], start_frame: int, n_frames: int | DataFrame, keys: Sequence[str] = ("position",), threshold: float = 0.4, denominator: str = "area_prev", unique_new: bool = True, **options) -> DataFrame:
    """The object table of channels (dense pixels with labels) after ``repeat``; ``options`` go to ``objects.measure``."""
    from cellweave.operators import objects

    at = [*keys, "frame_i", "y", "x"]
    first = next(iter(channels.values()))
    new = checkpointed(repeat(first, start_frame, keys, threshold, denominator, unique_new)).withColumnRenamed("label", "__new")
    renamed = {c: p.join(new, at, "left").withColumn("label", F.coalesce("__new", F.lit(0))).drop("__new") for c, p in channels.items()}
    return objects.measure(renamed, n_frames, keys=list(keys), **options)


def disappeared(tracked: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, frame_i, label)``: the last frame of a run of frames after which a tracked object is not in the next one."""
    rows = tracked.where("label <> 0").select(*keys, "frame_i", "label").distinct()
    ends = tracked.groupBy(*keys).agg(F.max("frame_i").alias("last"))
    after = rows.select(*keys, (F.col("frame_i") - 1).alias("frame_i"), "label")
    return rows.join(after, [*keys, "frame_i", "label"], "left_anti").join(ends, list(keys)).where("frame_i < last").drop("last")


def mapping_of_table(labels: DataFrame, table: DataFrame, delete_untracked: bool = False, first_frame_one: bool = False) -> DataFrame:
    """``(frame_i, label, new_label)``: the track of each object that a tracking table names or has a point in.

    The table holds ``frame_i, track_id`` and a ``mask_id`` or ``y, x``; of several rows for one object the lowest track counts.
    Untracked objects get 0, if they are to go; where their number is now a track's, one above all of the frame.
    """
    rows = table.withColumn("frame_i", F.col("frame_i") - int(first_frame_one)).where("frame_i >= 0")
    present = labels.where("label <> 0")
    objects = present.select("frame_i", "label").distinct()
    parts = []
    if "mask_id" in table.columns:
        parts.append(rows.where("mask_id is not null and mask_id <> 0").select("frame_i", F.col("mask_id").cast("long").alias("label"), "track_id"))
    if "y" in table.columns:
        lone = rows.where("mask_id is null") if "mask_id" in table.columns else rows
        places = lone.select("frame_i", F.round("y").cast("long").alias("y"), F.round("x").cast("long").alias("x"), "track_id")
        parts.append(places.join(present, ["frame_i", "y", "x"]).select("frame_i", "label", "track_id"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    found = found.groupBy("frame_i", "label").agg(F.min("track_id").cast("long").alias("new_label"))
    tracked = objects.join(found, ["frame_i", "label"])
    rest = objects.join(found, ["frame_i", "label"], "left_anti").join(rows.select("frame_i").distinct(), "frame_i", "left_semi")
    if delete_untracked:
        return tracked.unionByName(rest.withColumn("new_label", F.lit(0).cast("long")))
    goals = tracked.select("frame_i", F.col("new_label").alias("label")).distinct()
    clashing = rest.join(goals, ["frame_i", "label"], "left_semi")
    top = objects.groupBy("frame_i").agg(F.max("label").alias("a")).join(tracked.groupBy("frame_i").agg(F.max("new_label").alias("b")), "frame_i", "left")
    moved = clashing.join(top, "frame_i").withColumn("new_label", F.greatest("a", "b") + F.col("label"))
    return tracked.unionByName(moved.select("frame_i", "label", "new_label"))


#: The columns of an object table that hold ids.
ID_COLUMNS = ("Cell_ID", "relative_ID", "Cell_ID_tree", "parent_ID_tree", "root_ID_tree", "sister_ID_tree")


def apply_mappers(df: DataFrame, first: DataFrame, second: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """An object table after tracking: ids by the mappers ``(frame_i, label, new_label)``, the first before the second; deleted rows go.

    Negative ids stay.
    """
    named = lambda m, rank: m.select("frame_i", "label", F.col("new_label"), F.lit(rank).alias("__rank"))
    both = named(first, 1)
    if second is not None:
        both = both.unionByName(named(second, 2))
    if deleted is not None:
        both = both.unionByName(named(deleted.withColumn("new_label", F.lit(None).cast(first.schema["new_label"].dataType)), None))
    one = both.groupBy(F.col("frame_i").alias("__frame"), F.col("label").alias("__label")).agg(F.min_by("new_label", "__rank").alias("__new"), F.max(F.col("__rank").isNull()).alias("__gone"))
    # A join for each column of ids: a frame's changes are as many as it has objects, too many to go along with every row.
    out, ids = df, [c for c in df.columns if c in ID_COLUMNS]
    rest = -1 - F.pmod(F.xxhash64(*map(col, ids)), F.lit(1 << 20))  # what finds nothing, each in a place of its own
    for k, c in enumerate(ids):
        found = (one if c == "Cell_ID" else one.where("__label >= 0")).withColumnRenamed("__new", f"__new{k}")
        keyed = out.withColumn("__key", F.coalesce(col(c).cast("long") if c == "Cell_ID" else F.when(col(c) >= 0, col(c).cast("long")), rest))
        out = keyed.join(found, (keyed["frame_i"] == found["__frame"]) & (keyed["__key"] == found["__label"]), "left")
        if c == "Cell_ID":
            out = out.where(~F.coalesce(F.col("__gone") & (col(c) == F.col("__label")), F.lit(False)))
        out = out.drop("__frame", "__label", "__key", "__gone")
    new = {c: F.coalesce(F.when(col(c) >= 0, F.col(f"__new{k}")), col(c)).alias(c) for k, c in enumerate(ids)}
    return out.select(*(new.get(c, col(c)) for c in df.columns))
