"""Joins of an object with its relative: mother with bud, and back.

Tables carry their row order in ``_row_id``; where keys repeat, it decides which row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.coerce import NAN, alike, col, integer, key, lossy, number, or_nan, require

ROW_ID = "_row_id"
#: Columns that, where present, belong to the key of an object beside its frame.
CONTEXT = ("max_frame_pos", "file", "selection_subset", "position", "directory")


def relatives_data(df: DataFrame, channels: Sequence[str] = (), grouping: Sequence[str] = ()) -> DataFrame:
    """Every row with its relative's columns as ``<name>_rel``, and amounts of mother and bud together.

    The relative is the first row with ``Cell_ID`` equal to ``relative_ID`` in the same frame and context. During S the
    combined amounts are sums (NaN where a part is missing); otherwise the row's own.
    """
    require(df, "frame_i", "Cell_ID", "relative_ID", "cell_cycle_stage", "cell_vol_fl", *grouping)
    shared = list(dict.fromkeys(["frame_i", *(c for c in CONTEXT if c in df.columns), *grouping]))
    carried = [c for c in df.columns if c != ROW_ID and not c.endswith("_rel") and c not in shared]
    own, relative = alike(df, "Cell_ID", "relative_ID")
    # One key of all parts: nulls in it meet nulls, and the first rows and the join are dealt by it alike. Its hash goes first, as sorting compares that fast.
    parts = [key(df, c).alias(f"k{i}") for i, c in enumerate(shared)]
    keyed = lambda of: (F.xxhash64(*parts, of).alias("__hash"), F.struct(*parts, of.alias("id")).alias("__key"))
    names = {c: f"__r{i}" for i, c in enumerate(carried)}
    first = Window.partitionBy("__hash", "__key").orderBy(ROW_ID)
    right = df.select(*keyed(own), ROW_ID, *(col(c).alias(n) for c, n in names.items()))
    right = right.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", ROW_ID)
    both = df.select("*", *keyed(relative)).join(right, ["__hash", "__key"], "left")
    kept = [c for c in df.columns if not (c.endswith("_rel") and c[:-4] in carried)]
    out = both.select(*map(col, kept), *(F.col(n).alias(f"{c}_rel") for c, n in names.items()))
    in_s = lossy(out, "cell_cycle_stage") == "S"
    pairs = [(f"{c}_{a}", f"{c}_combined_{b}_mother_bud") for c in channels for a, b in (("corrected_amount", "amount"), ("raw_sum", "raw_sum"))]
    sums = {b: a for a, b in pairs if a in out.columns and f"{a}_rel" in out.columns} | {"combined_mother_bud_volume": "cell_vol_fl"}
    together = lambda c: or_nan(number(out, c)) + or_nan(number(out, f"{c}_rel"))
    return out.withColumns({b: F.when(in_s, together(a)).otherwise(number(out, a)) for b, a in sums.items()})


def generation_of_relative(df: DataFrame, grouping: Sequence[str] = ()) -> DataFrame:
    """``generation_num_relID``: the generation of the relative in the same frame, or -1.

    A row that names this one back counts first, then any of the relative's; of repeated rows the last.
    """
    require(df, "frame_i", "Cell_ID", "relative_ID", "generation_num", ROW_ID, *grouping)
    places = [key(df, c).alias(f"__g{i}") for i, c in enumerate(grouping)]
    names = [f"__g{i}" for i in range(len(grouping))] + ["__frame"]
    ids = [integer(df, a).alias(b) for a, b in (("frame_i", "__frame"), ("Cell_ID", "__cell"), ("relative_ID", "__rel"), ("generation_num", "__gen"))]
    base = df.drop("generation_num_relID").select("*", *places, *ids)
    usable = base.where("__frame is not null and __cell is not null and __rel is not null and __gen is not null")
    last = F.max_by("__gen", ROW_ID)
    back = usable.groupBy(*names, F.col("__rel").alias("__cell"), F.col("__cell").alias("__rel")).agg(last.alias("__back"))
    own = usable.groupBy(*names, F.col("__cell").alias("__rel")).agg(last.alias("__own"))
    same = lambda a, b, on: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in on]
    found = base.alias("t").join(back.alias("b"), same("t", "b", [*names, "__cell", "__rel"]), "left").select("t.*", "__back")
    found = found.alias("t").join(own.alias("o"), same("t", "o", [*names, "__rel"]), "left").select("t.*", "__own")
    known = F.col("__frame").isNotNull() & F.col("__cell").isNotNull() & F.col("__rel").isNotNull()
    value = F.when(known, F.coalesce("__back", "__own", F.lit(-1))).otherwise(-1)
    return found.withColumn("generation_num_relID", value).drop(*names, "__cell", "__rel", "__gen", "__back", "__own")


def mother_bud_total(df: DataFrame, operations: dict[str, str], grouping: Sequence[str] = (), entity: str = "entity", copy_all: bool = True) -> DataFrame:
    """G1 rows, mothers and buds in S, and mothers with what they and their bud have together, marked in ``entity``.

    Columns whose operation names a sum are added up in the total (NaN where a part is missing); others stay the
    mother's. Without ``copy_all`` total rows hold only the columns that have an operation. Of repeated buds the last counts.
    """
    require(df, "frame_i", "Cell_ID", "relative_ID", "cell_cycle_stage", "relationship", ROW_ID)
    stage, role = lossy(df, "cell_cycle_stage"), lossy(df, "relationship")
    part = lambda rows, name: rows.withColumn(entity, F.lit(name))
    g1, mothers, buds = df.where(stage == "G1"), df.where((stage == "S") & (role == "mother")), df.where((stage == "S") & (role == "bud"))
    summed = [c for c, o in operations.items() if "sum" in o.lower() and c in df.columns]
    names = [f"__k{i}" for i in range(len(grouping) + 2)]
    keyed = lambda rows, of: rows.select("*", *(c.alias(n) for c, n in zip([*(key(df, g) for g in grouping), integer(df, "frame_i"), integer(df, of)], names)))
    bud = keyed(buds, "relative_ID").groupBy(*names).agg(F.max_by(F.struct(ROW_ID, *(number(df, c).alias(f"__s{i}") for i, c in enumerate(summed))), ROW_ID).alias("__bud"))
    on = [F.col(f"m.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names]
    total = keyed(mothers, "Cell_ID").alias("m").join(bud.alias("b"), on)
    sums = {c: or_nan(number(df, c)) + or_nan(F.col(f"__bud.__s{i}")) for i, c in enumerate(summed)}
    keep = [c for c in df.columns if copy_all or c in operations or c == ROW_ID]
    total = total.select(*(sums.get(c, F.col(f"m.`{c}`")).alias(c) for c in keep))
    parts = [part(x, n) for x, n in ((g1, "G1"), (mothers, "Mother"), (buds, "Bud"), (total, "Total"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def missing_relatives(df: DataFrame, grouping: Sequence[str] = ()) -> DataFrame:
    """Rows in S whose relative is not in their frame."""
    own, relative = alike(df, "Cell_ID", "relative_ID")
    places = [key(df, c).alias(f"__g{i}") for i, c in enumerate(["frame_i", *grouping])]
    names = [f"__g{i}" for i in range(len(grouping) + 1)]
    left = df.where(lossy(df, "cell_cycle_stage") == "S").select("*", *places, relative.alias("__id"))
    right = df.select(*places, own.alias("__id")).distinct()
    return left.join(right, [*names, "__id"], "left_anti").drop(*names, "__id")


__all__ = ["NAN", "generation_of_relative", "missing_relatives", "mother_bud_total", "relatives_data"]
