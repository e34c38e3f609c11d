"""Figures of whole cell-cycle phases and cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import NAN, col, integer, lossy, number, or_nan, require
from cellweave.operators.relatives import ROW_ID

CYCLE = ("Cell_ID", "generation_num", "position", "file")


def phase_quantities(df: DataFrame, grouping: Sequence[str], channels: Sequence[str] = ()) -> DataFrame:
    """One row per phase: growth, beginning and end, and whether the phase and its cycle are complete.

    A phase is complete if it begins after frame 0 and ends before the last frame of its position (and before
    ``max_t``, where given); a cycle, if exactly two phases of it are. Ties of a frame go by row order.
    """
    measures = ("cell_area_um2", "cell_vol_fl", "cell_area_um2_rel", "cell_vol_fl_rel", "combined_mother_bud_volume")
    if not {"max_frame_pos", *CYCLE} <= set(grouping) or len(set(grouping)) < len(grouping):
        raise ValueError("grouping columns repeat or lack max_frame_pos, Cell_ID, generation_num, position or file")
    require(df, "frame_i", *measures, *grouping, ROW_ID)
    used = [c for c in channels if f"{c}_corrected_mean" in df.columns]
    per_channel = ("corrected_amount", "corrected_mean", "corrected_concentration", "combined_amount_mother_bud")
    require(df, *(f"{c}_{p}" for c in used for p in per_channel))
    extra = ["max_t"] if "max_t" in df.columns else []
    values = [*measures, *(f"{c}_{p}" for c in used for p in per_channel), *extra]
    frame = number(df, "frame_i")
    order = F.struct(frame, F.col(ROW_ID))
    row = F.struct(*(number(df, v).alias(v) for v in dict.fromkeys(values)))
    g = df.groupBy(*map(col, grouping)).agg(F.min_by(row, order).alias("a"), F.max_by(row, order).alias("z"), F.min(frame).alias("begin"), F.max(frame).alias("end"))
    first, last = (lambda c: F.col(f"a.`{c}`")), (lambda c: F.col(f"z.`{c}`"))
    growth = lambda c: or_nan(last(c)) - or_nan(first(c))
    limit = or_nan(number(df.select("max_frame_pos"), "max_frame_pos"))
    before = lambda bound: ~F.isnan(bound) & (F.col("end") < bound)
    complete = (F.col("begin") > 0) & before(limit)
    if extra:
        complete &= before(or_nan(first("max_t")))
    columns = {
        "phase_area_growth": growth("cell_area_um2"), "phase_volume_growth": growth("cell_vol_fl"),
        "phase_area_at_beginning": first("cell_area_um2"), "phase_volume_at_beginning": first("cell_vol_fl"), "phase_volume_at_end": last("cell_vol_fl"),
        "phase_daughter_area_growth": growth("cell_area_um2_rel"), "phase_daughter_volume_growth": growth("cell_vol_fl_rel"),
        "phase_length": F.col("end") - F.col("begin"), "phase_begin": F.col("begin"), "phase_end": F.col("end"),
        "phase_combined_volume_at_end": last("combined_mother_bud_volume"), "complete_phase": F.coalesce(complete, F.lit(False)).cast("long"),
    }
    for c in used:
        columns |= {
            f"phase_{c}_amount_at_beginning": first(f"{c}_corrected_amount"), f"phase_{c}_mean_at_beginning": first(f"{c}_corrected_mean"),
            f"phase_{c}_concentration_at_beginning": first(f"{c}_corrected_concentration"), f"phase_{c}_concentration_at_end": last(f"{c}_corrected_concentration"),
            f"phase_{c}_combined_amount_at_beginning": first(f"{c}_combined_amount_mother_bud"), f"phase_{c}_combined_amount_at_end": last(f"{c}_combined_amount_mother_bud"),
        }
    out = g.select(*map(col, grouping), *(v.alias(k) for k, v in columns.items()))
    whole_cycle = F.sum("complete_phase").over(Window.partitionBy(*CYCLE)) == 2
    return out.withColumn("complete_cycle", whole_cycle.cast("long"))


def derived_cycle_columns(df: DataFrame, grouping: Sequence[str] = ()) -> DataFrame:
    """``will_divide`` for whole cycles, and ``end_of_cell_cycle_frame_i``: the last frame in S of those that divide, or -1.

    Tables of several positions name the columns that tell these apart in ``grouping``.
    """
    require(df, "frame_i", "Cell_ID", "cell_cycle_stage", "generation_num", "will_divide")
    cell, generation = integer(df, "Cell_ID"), integer(df, "generation_num")
    cycle = Window.partitionBy(*map(col, grouping), cell, generation)
    known = cell.isNotNull() & generation.isNotNull()
    n = number(df, "will_divide")
    divides = F.max(F.coalesce((n > 0) & ~F.isnan(n), F.lit(False))).over(cycle) & known
    last_s = F.max(F.when(lossy(df, "cell_cycle_stage") == "S", integer(df, "frame_i"))).over(cycle)
    return df.withColumns({
        "will_divide": F.when(divides, F.lit(1.0)).otherwise(n),
        "end_of_cell_cycle_frame_i": F.when(divides, F.coalesce(last_s, F.lit(-1))).otherwise(-1),
    })


__all__ = ["NAN", "derived_cycle_columns", "phase_quantities"]
