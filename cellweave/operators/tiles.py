"""Parts and holes of planes of any size: tiles for themselves, then what meets over their borders.

No task holds more than a tile. Where a part goes on over a border, its two names are united over all tiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.pixels import FRAME
from cellweave.operators.planes import parts_of
from cellweave.operators.unions import joined, united
from cellweave.session import checkpointed

#: Side of a tile, in pixels.
TILE = 1024


def parts(pixels: DataFrame, keys: Sequence[str] = FRAME, tile: int = TILE) -> DataFrame:
    """``(…, y, x, part)``: pixels that hang together by edges have one ``part``, whatever tiles they are in."""
    at = list(keys)
    placed = pixels.select(*at, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumns({"__ty": F.floor(F.col("y") / tile), "__tx": F.floor(F.col("x") / tile)})
    shape = placed.drop("__ty", "__tx").withColumn("part", F.lit(0).cast("long")).schema
    made = [0]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y, x = rows["y"].to_numpy(np.int64) % tile, rows["x"].to_numpy(np.int64) % tile
        mask = np.zeros((y.max() + 1, x.max() + 1), bool)
        mask[y, x] = True
        # Names tell the task's attempt and go on from tile to tile, so no two tiles share one.
        found = parts_of(mask)[y, x] + made[0]
        made[0] = int(found.max())
        return rows[[*at, "y", "x"]].assign(part=(TaskContext.get().taskAttemptId() << 34) + found)

    own = checkpointed(placed.groupBy(*at, "__ty", "__tx").applyInPandas(run, shape))
    edges = None
    for c in ("y", "x"):
        last = own.where(F.col(c) % tile == tile - 1).withColumn(c, F.col(c) + 1).withColumnRenamed("part", "u")
        first = own.where(F.col(c) % tile == 0).withColumnRenamed("part", "v")
        met = last.join(first, [*at, "y", "x"]).select("u", "v")
        edges = met if edges is None else edges.unionAll(met)
    roots = united(edges.distinct()).select(F.col("node").alias("part"), "root")
    return own.join(roots, "part", "left").select(*at, "y", "x", F.coalesce("root", "part").alias("part"))


def segment_above(pixels: DataFrame, level: float, keys: Sequence[str] = FRAME, tile: int = TILE) -> DataFrame:
    """``(…, y, x, label)``: the parts of each plane above a level, numbered in reading order of their first pixels."""
    at = list(keys)
    found = checkpointed(parts(pixels.where(F.col("value") > level), at, tile))
    first = found.groupBy(*at, "part").agg(F.min(F.struct("y", "x")).alias("__first"))
    numbers = first.withColumn("label", F.row_number().over(Window.partitionBy(*at).orderBy("__first")).cast("long")).drop("__first")
    return found.join(numbers, [*at, "part"]).select(*at, "y", "x", "label")


def fill_holes(labels: DataFrame, keys: Sequence[str] = FRAME, tile: int = TILE) -> DataFrame:
    """``(…, y, x, label)``: what a label encloses becomes that label, other labels included; of labels within labels the outermost counts.

    A hole is a part of what is not the label in its box that does not touch the box's edge.
    """
    at = [*keys, "label"]
    own = labels.where("label <> 0").select(*at, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    boxes = checkpointed(own.groupBy(*at).agg(*(f(c).alias(f"__{c}{i}") for c in ("y", "x") for i, f in enumerate((F.min, F.max)))))
    boxes = boxes.withColumn("__size", (F.col("__y1") - F.col("__y0") + 1) * (F.col("__x1") - F.col("__x0") + 1))
    # A label whose box is no larger than a tile needs no tiles: a task fills it whole, together with others.
    fits = (F.col("__y1") - F.col("__y0") < tile) & (F.col("__x1") - F.col("__x0") < tile)
    whole = own.join(boxes.where(fits).select(*at), at).repartition(*at).sortWithinPartitions(*at)
    shape = own.withColumn("__size", F.lit(0).cast("long")).schema
    ranked = whole.mapInPandas(lambda batches: _filled(batches, at), shape)
    if not boxes.where(~fits).isEmpty():
        ranked = ranked.unionByName(_filled_over_tiles(own.join(boxes.where(~fits).select(*at), at), boxes.where(~fits), at, tile))
    best = F.max_by("label", F.struct("__size", (-F.col("label")).alias("l")))
    return ranked.groupBy(*keys, "y", "x").agg(best.alias("label"))


def _filled_over_tiles(own: DataFrame, boxes: DataFrame, at: list[str], tile: int) -> DataFrame:
    """``(…, y, x, __size)``: the pixels of labels and their holes, with the size of the label's box."""
    inside = boxes.select(*at, F.explode(F.sequence("__y0", "__y1")).alias("y"), "__x0", "__x1").select(*at, "y", F.explode(F.sequence("__x0", "__x1")).alias("x"))
    free = checkpointed(parts(inside.join(own, [*at, "y", "x"], "left_anti"), at, tile))
    open_ = free.join(boxes, at).where("y in (__y0, __y1) or x in (__x0, __x1)").select("part").distinct()
    holes = free.join(open_, "part", "left_anti").select(*at, "y", "x")
    return own.unionByName(holes).join(boxes.select(*at, "__size"), at).select(*at, "y", "x", "__size")


def _filled(batches: Iterator[pd.DataFrame], at: list[str]) -> Iterator[pd.DataFrame]:
    """``_filled_over_tiles`` of rows ordered by label, as many whole labels at once as a batch has."""
    held: list[pd.DataFrame] = []
    for rows in batches:
        new = _begins(rows, at)
        if len(new) and held and (len(new) > 1 or len(_begins(pd.concat([held[-1].tail(1), rows.head(1)]), at)) > 1):
            # The last label may go on in the next batch.
            cut = new[-1] if len(new) > 1 else 0
            yield _filled_labels(pd.concat([*held, rows[:cut]], ignore_index=True), at)
            held = [rows[cut:]]
        elif len(rows):
            held.append(rows)
    if held:
        yield _filled_labels(pd.concat(held, ignore_index=True), at)


def _begins(rows: pd.DataFrame, at: list[str]) -> np.ndarray:
    """Where a label's rows begin."""
    if not len(rows):
        return np.empty(0, np.int64)
    unlike = np.zeros(len(rows) - 1, bool)
    for c in at:
        v, none = rows[c].to_numpy(), rows[c].isna().to_numpy()
        unlike |= ((v[1:] != v[:-1]) | (none[1:] != none[:-1])) & ~(none[1:] & none[:-1])
    return np.flatnonzero(np.r_[True, unlike])


def _filled_labels(rows: pd.DataFrame, at: list[str]) -> pd.DataFrame:
    """All labels of a table in their boxes, with a free rim, one after the other in one array of cells."""
    first = _begins(rows, at)
    which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(rows)]))
    y, x = rows["y"].to_numpy(np.int64), rows["x"].to_numpy(np.int64)
    y0, y1, x0, x1 = (f.reduceat(v, first) for v in (y, x) for f in (np.minimum, np.maximum))
    width, height = x1 - x0 + 3, y1 - y0 + 3
    end = np.cumsum(width * height)
    start = end - width * height
    free = np.ones(int(end[-1]), bool)
    free[start[which] + (y - y0[which] + 1) * width[which] + x - x0[which] + 1] = False
    owner = np.repeat(np.arange(len(first)), width * height)
    place = np.arange(len(free)) - start[owner]
    # Runs of free cells in a row of a box, then what runs meet in the row below.
    column = place % width[owner]
    begins = free & ((column == 0) | ~np.r_[False, free[:-1]])
    run = np.cumsum(begins) - 1
    below = np.flatnonzero(free & (place < (width * (height - 1))[owner]))
    below = below[free[below + width[owner[below]]]]
    root = joined(int(begins.sum()), run[below], run[below + width[owner[below]]])
    cells = np.flatnonzero(free)
    hole = cells[root[run[cells]] != root[run[start[owner[cells]]]]]
    found = owner[hole]
    filled = rows[at].iloc[first[found]].assign(y=place[hole] // width[found] + y0[found] - 1, x=column[hole] + x0[found] - 1)
    sizes = ((width - 2) * (height - 2))[np.r_[which, found]]
    return pd.concat([rows[[*at, "y", "x"]], filled], ignore_index=True).assign(__size=sizes)
