"""Repairs, edits and checks of cell-cycle annotations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.coerce import col, integer, is_missing, kind, lossy, number, require, truthy
from cellweave.operators.relatives import ROW_ID

#: Columns of former table versions and what they are called now.
FORMER_NAMES = {
    "Cell cycle stage": "cell_cycle_stage", "# of cycles": "generation_num", "Relative's ID": "relative_ID", "Relationship": "relationship",
    "Emerg_frame_i": "emerg_frame_i", "Division_frame_i": "division_frame_i", "Discard": "is_cell_excluded",
}
#: The annotation columns.
ANNOTATIONS = (
    "cell_cycle_stage", "generation_num", "relative_ID", "relationship", "emerg_frame_i", "division_frame_i", "is_history_known",
    "corrected_on_frame_i", "will_divide", "daughter_disappears_before_division", "disappears_before_division",
)
#: Annotation columns that may be added, and their value up to the last annotated row.
DEFAULTS = {
    "generation_num": 2, "relative_ID": -1, "relationship": "mother", "emerg_frame_i": -1, "division_frame_i": -1, "is_history_known": False,
    "corrected_on_frame_i": -1, "daughter_disappears_before_division": 0, "disappears_before_division": 0,
}
STAGES, ROLES = ("G1", "S"), ("mother", "bud")


def current_names(df: DataFrame) -> DataFrame:
    """Columns of former versions under their present names; an error if two would be called the same."""
    names = [FORMER_NAMES.get(c, c) for c in df.columns]
    twice = next((n for n in names if names.count(n) > 1), None)
    if twice:
        raise ValueError(f"two columns would be called {twice!r}")
    return df.toDF(*names)


def _with_groups(df: DataFrame, grouping: Sequence[str], figures: DataFrame) -> DataFrame:
    """Rows with the figures of their group (a row for each); one row for the whole table if nothing groups."""
    return df.join(figures, list(grouping), "left") if grouping else df.crossJoin(F.broadcast(figures))


def _annotated(df: DataFrame, grouping: Sequence[str]) -> DataFrame:
    """``__annotated``: whether a row is not after the last row that has a stage. Groups are aggregated, never gathered.

    A table that has the column already keeps it.
    """
    if "__annotated" in df.columns:
        return df
    last = df.groupBy(*map(col, grouping)).agg(F.max(F.when(~is_missing(df, "cell_cycle_stage"), F.col(ROW_ID))).alias("__last"))
    marked = _with_groups(df, grouping, last)
    return marked.withColumn("__annotated", F.coalesce(F.col(ROW_ID) <= F.col("__last"), F.lit(False))).drop("__last")


def _typed(df: DataFrame) -> DataFrame:
    """``__cell, __frame, __gen``: ids as integers. A table that has them keeps them, so that what is dealt by them stays so."""
    if "__cell" in df.columns:
        return df
    return df.withColumns({"__cell": integer(df, "Cell_ID"), "__frame": integer(df, "frame_i"), "__gen": integer(df, "generation_num") if "generation_num" in df.columns else F.lit(None).cast("long")})


def add_missing_columns(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """Annotation columns that a table lacks, with their defaults up to its last annotated row."""
    out = df.withColumns({c: F.lit(0) for c in ("is_cell_excluded", "is_cell_dead") if c not in df.columns})
    lacking = {c: v for c, v in DEFAULTS.items() if c not in df.columns}
    if "cell_cycle_stage" not in df.columns or not lacking:
        return out
    marked = _annotated(out, grouping)
    return marked.withColumns({c: F.when(F.col("__annotated"), F.lit(v)) for c, v in lacking.items()}).select(*map(col, out.columns), *lacking)


def add_will_divide(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``will_divide``: 1 on the rows of buds that reach a generation of their own, and on their mother's cycle at the time.

    Nothing changes if the column is there or stages are not. A bud whose mother lacks a row at its first frame is an error.
    """
    if "cell_cycle_stage" not in df.columns or "will_divide" in df.columns:
        return df
    require(df, "frame_i", "Cell_ID", "generation_num", "relative_ID", "relationship", ROW_ID)
    g = list(grouping)
    base = _typed(_annotated(df, g)).withColumn("__rel", integer(df, "relative_ID")).withColumns({"__in": F.col("__annotated") & F.col("__cell").isNotNull(), "__bud": lossy(df, "relationship") == "bud"})
    of_cell = Window.partitionBy(*map(col, g), F.col("__cell"))
    counted = F.col("__in") & (F.col("__gen") > 0)
    first = F.min_by(F.struct("__rel", "__frame", ROW_ID), F.when(F.col("__in") & F.col("__bud"), F.col(ROW_ID))).over(of_cell)
    marked = base.withColumns({"__later": F.max(F.coalesce(counted, F.lit(False))).over(of_cell), "__first": first})
    own = F.col("__in") & F.col("__later") & F.col(f"__first.{ROW_ID}").isNotNull()
    buds = marked.where(own & (F.col(ROW_ID) == F.col(f"__first.{ROW_ID}"))).select(*g, F.col("__rel").alias("__cell"), "__frame").where("__cell is not null and __frame is not null")
    seen = base.where("__in and __frame is not null").groupBy(*g, "__cell", "__frame").agg(F.max_by("__gen", ROW_ID).alias("__gen"), F.lit(True).alias("__found"))
    fails = F.raise_error(F.concat(F.lit("mother "), F.col("__cell").cast("string"), F.lit(" is missing at frame "), F.col("__frame").cast("string")))
    cycles = buds.join(seen, [*g, "__cell", "__frame"], "left").withColumn("__gen", F.when(F.col("__found"), F.col("__gen")).otherwise(fails.cast("long")))
    # All of a mother's cycles in one row, so that the table stays dealt by cell.
    cycles = cycles.where("__gen is not null").groupBy(*g, "__cell").agg(F.collect_set("__gen").alias("__cycles"))
    out = marked.join(cycles, [*g, "__cell"], "left")
    divides = (own & F.col("__bud")) | (F.col("__in") & F.coalesce(F.array_contains("__cycles", F.col("__gen")), F.lit(False)))
    value = F.when(F.col("__annotated"), F.coalesce(divides, F.lit(False)).cast("int"))
    return out.withColumn("will_divide", value).select(*map(col, df.columns), "will_divide")


def fix_will_divide(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``will_divide`` becomes 0 in cycles after which the cell has no further generation."""
    if "cell_cycle_stage" not in df.columns:
        return df
    require(df, "frame_i", "Cell_ID", "generation_num", "will_divide")
    base = _typed(df).withColumn("__on", ~is_missing(df, "cell_cycle_stage"))
    n = number(df, "will_divide")
    known = F.col("__on") & F.col("__cell").isNotNull() & F.col("__gen").isNotNull()
    of_cell = Window.partitionBy(*map(col, grouping), F.col("__cell"))
    there = F.collect_set(F.when(known, F.col("__gen"))).over(of_cell)
    divides = F.max(known & F.coalesce((n > 0) & ~F.isnan(n), F.lit(False))).over(Window.partitionBy(*map(col, grouping), F.col("__cell"), F.col("__gen")))
    marked = base.withColumns({"__there": there, "__divides": divides})
    stale = known & F.col("__divides") & ~F.array_contains("__there", F.col("__gen") + 1)
    return marked.withColumn("will_divide", F.when(stale, F.lit(0).cast(kind(df, "will_divide"))).otherwise(F.col("will_divide"))).select(*map(col, df.columns))


def corrected_blocks(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``corrected_on_frame_i`` in place of ``corrected_assignment``: the first frame of each run of one positive value.

    Where corrections are there already, only the former column goes.
    """
    if "corrected_assignment" not in df.columns:
        return df
    require(df, "frame_i", "Cell_ID", ROW_ID)
    given = df.columns
    df = _typed(df)
    cell, frame, value = F.col("__cell"), F.col("__frame"), number(df, "corrected_assignment")
    of_cell = Window.partitionBy(*map(col, grouping), cell).orderBy(F.coalesce(frame, F.lit((1 << 63) - 1)), ROW_ID)
    changed = F.coalesce(F.lag(lossy(df, "corrected_assignment")).over(of_cell) != lossy(df, "corrected_assignment"), F.lit(False))
    runs = df.withColumn("__changed", changed.cast("int")).withColumn("__run", F.sum("__changed").over(of_cell.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(frame).over(Window.partitionBy(*map(col, grouping), cell, F.col("__run")))
    new = F.when((value > 0) & ~F.isnan(value) & cell.isNotNull(), F.coalesce(first, F.lit(-1))).otherwise(F.lit(-1))
    if "corrected_on_frame_i" in df.columns:
        old = number(df, "corrected_on_frame_i")
        there = df.groupBy(*map(col, grouping)).agg(F.max(F.coalesce((old > -1) & ~F.isnan(old), F.lit(False))).alias("__there"))
        runs = _with_groups(runs.withColumn("__new", new), grouping, there)
        return runs.withColumn("corrected_on_frame_i", F.when(F.col("__there"), integer(df, "corrected_on_frame_i")).otherwise(F.col("__new"))).drop("__changed", "__run", "__new", "__there", "corrected_assignment", *({"__cell", "__frame", "__gen"} - set(given)))
    return runs.withColumn("corrected_on_frame_i", new).drop("__changed", "__run", "corrected_assignment", *({"__cell", "__frame", "__gen"} - set(given)))


def first_of_keys(df: DataFrame, keys: Sequence[str], dealt: Sequence[Column] = ()) -> DataFrame:
    """The first row of each key, by row order; ``dealt`` are columns that follow from the keys, by which the rows are dealt already."""
    order = Window.partitionBy(*dealt, *(lossy(df, k) for k in keys)).orderBy(ROW_ID)
    return df.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def ensure_compatible(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """A table of any version as one of today: index columns go, first rows of repeated objects stay, annotations are completed.

    Missing cells of other columns become 0 if all annotation columns were there. The order of frames and cells counts as
    row order from here on; a frame of 2**22 or a cell of 2**40 or more is an error.
    """
    require(df, "frame_i", "Cell_ID", ROW_ID)
    out = df.drop("index", "level_0")
    if set(ANNOTATIONS) <= set(out.columns):
        fill = {c: F.when(is_missing(out, c), F.lit(0).cast(kind(out, c))).otherwise(col(c)) for c in out.columns if c not in (*ANNOTATIONS, ROW_ID, *grouping)}
        out = out.withColumns(fill)
    # Dealt by cell once: every window below is of a cell, or of less.
    out = _typed(out).repartition(*map(col, grouping), "__cell")
    out = first_of_keys(out, [*grouping, "frame_i", "Cell_ID"], [*map(col, grouping), F.col("__cell")])
    large = F.raise_error(F.concat(F.lit("no room for cell "), F.col("__cell").cast("string"), F.lit(" in the row order"))).cast("long")
    cell = F.when((F.col("__cell") >= 1 << 40) | (F.col("__frame") >= 1 << 22), large).otherwise(F.coalesce("__cell", F.lit(0)))
    out = out.withColumn(ROW_ID, F.coalesce("__frame", F.lit(0)) * F.lit(1 << 40) + cell)
    if "cell_cycle_stage" in out.columns:
        out = _annotated(out, grouping)
    out = add_missing_columns(out, grouping)
    if "generation_num" in out.columns and "generation_num" not in df.columns:
        out = out.withColumn("__gen", integer(out, "generation_num"))
    for step in (add_will_divide, fix_will_divide):
        out = step(out, grouping)
    if "corrected_assignment" in out.columns and "corrected_on_frame_i" not in df.columns:
        out = out.drop("corrected_on_frame_i")  # only defaults, which the blocks replace
    return corrected_blocks(out, grouping).drop("__annotated", "__cell", "__frame", "__gen")


# --- edits ---------------------------------------------------------------------------------------------------------


def apply_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str] = ("frame_i", "Cell_ID")) -> DataFrame:
    """Cells replaced by those of ``edits`` that are not null, by key; an edit of a row that is not there is an error.

    Stages must be G1 or S, relationships mother or bud.
    """
    values = [c for c in edits.columns if c not in keys]
    allowed = {"cell_cycle_stage": STAGES, "relationship": ROLES}
    checked = edits.select(*keys, *(F.when(col(c).isNull() | col(c).isin(*allowed[c]), col(c)).otherwise(F.raise_error(F.lit(f"no such {c}"))).alias(c) if c in allowed else col(c) for c in values))
    known = df.select(*(col(k) for k in keys)).distinct().withColumn("__known", F.lit(True))
    checked = checked.join(known, list(keys), "left")
    checked = checked.where(F.when(F.col("__known"), F.lit(True)).otherwise(F.raise_error(F.lit("an edited object is not in the table")).cast("boolean"))).drop("__known")
    renamed = checked.select(*(col(k) for k in keys), *(col(c).alias(f"__{c}") for c in values))
    joined = df.join(renamed, list(keys), "left")
    return joined.select(*(F.coalesce(F.col(f"`__{c}`").cast(kind(df, c)), col(c)).alias(c) if c in values else col(c) for c in df.columns))


def propagate_edits(df: DataFrame, edits: DataFrame, keys: Sequence[str] = ("Cell_ID",), end_frame: int | None = None) -> DataFrame:
    """Edits of a cell at a frame, laid on that row and its later rows, up to ``end_frame`` inclusive; the latest edit counts."""
    values = [c for c in edits.columns if c not in (*keys, "frame_i")]
    e = edits.select(*(col(k) for k in keys), F.col("frame_i").alias("__from"), F.struct(*(col(c) for c in values)).alias("__edit"))
    until = F.lit(True) if end_frame is None else (F.col("frame_i") <= end_frame)
    laid = df.select(*(col(k) for k in keys), "frame_i", ROW_ID).join(e, list(keys)).where((F.col("frame_i") >= F.col("__from")) & (until | (F.col("frame_i") == F.col("__from"))))
    laid = laid.groupBy(ROW_ID).agg(F.max_by("__edit", "__from").alias("__edit"))
    joined = df.join(laid, ROW_ID, "left")
    return joined.select(*(F.coalesce(F.col(f"__edit.`{c}`").cast(kind(df, c)), col(c)).alias(c) if c in values else col(c) for c in df.columns))


def assign_mother_bud(df: DataFrame, frame: int, bud: int, mother: int) -> DataFrame:
    """Two rows of a frame become mother and bud of one another, in S."""
    rows = [(frame, bud, "S", "bud", 0, mother), (frame, mother, "S", "mother", None, bud)]
    edits = df.sparkSession.createDataFrame(rows, "frame_i long, Cell_ID long, cell_cycle_stage string, relationship string, generation_num long, relative_ID long")
    return apply_edits(df, edits)


def manual_tracking_edit(df: DataFrame, frame: int, source: int, target: int, keys: Sequence[str] = ()) -> DataFrame:
    """A row's cell gets another id; where that id is in the frame already, the row goes."""
    at = F.col("frame_i") == frame
    there = F.max(at & (F.col("Cell_ID") == target)).over(Window.partitionBy(*map(col, keys), F.col("frame_i")))
    moved = df.withColumn("__there", F.coalesce(there, F.lit(False))).where(~(at & (F.col("Cell_ID") == source) & F.col("__there"))).drop("__there")
    return moved.withColumn("Cell_ID", F.when(at & (F.col("Cell_ID") == source), F.lit(target)).otherwise(F.col("Cell_ID")))


# --- checks --------------------------------------------------------------------------------------------------------


def integrity_of_frames(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, frame_i, category, ids)``: what does not fit together within frames; ids ascending."""
    require(df, "frame_i", "Cell_ID", "relative_ID", "cell_cycle_stage", "relationship", "generation_num")
    at = [*grouping, "frame_i"]
    base = df.select(
        *at, integer(df, "Cell_ID").alias("cell"), integer(df, "relative_ID").alias("rel"),
        lossy(df, "cell_cycle_stage").alias("stage"), lossy(df, "relationship").alias("role"), integer(df, "generation_num").alias("gen"),
    )
    other = base.select(*at, F.col("cell").alias("rel"), F.col("rel").alias("back")).dropDuplicates([*at, "rel"])
    joined = base.join(other, [*at, "rel"], "left")
    bud, in_s = F.col("role") == "bud", F.col("stage") == "S"
    rules = {
        "buds not in S": bud & ~in_s, "buds with a generation other than 0": bud & (F.col("gen") != 0), "relatives in G1": (F.col("stage") == "G1") & (F.col("rel") > 0),
        "mothers of generation 0": (F.col("role") == "mother") & (F.col("gen") < 1), "relatives not in the frame": in_s & F.col("back").isNull(),
        "relatives that name another": in_s & (F.col("back") != F.col("cell")),
    }
    each = joined.select(*at, "cell", F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))).alias("category"))
    many = base.where(bud).groupBy(*at, F.col("rel").alias("cell")).count().where("count > 1").select(*at, "cell", F.lit("mothers with several buds").alias("category"))
    listed = each.unionByName(many).groupBy(*at, "category").agg(F.sort_array(F.collect_set("cell")).alias("ids"))
    counts = base.where(in_s).groupBy(*at).agg(F.count_if(bud).alias("b"), F.count_if(F.col("role") == "mother").alias("m")).where("b <> m")
    uneven = counts.select(*at, F.lit("numbers of mothers and buds differ").alias("category"), F.array().cast("array<bigint>").alias("ids"))
    return listed.unionByName(uneven)


def cycles_without_g1(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, Cell_ID, generation_num)`` of cycles, buds' first ones aside, that have no frame in G1."""
    base = df.select(*grouping, integer(df, "Cell_ID").alias("Cell_ID"), integer(df, "generation_num").alias("generation_num"), lossy(df, "cell_cycle_stage").alias("stage"))
    cycles = base.where("generation_num > 0 and stage <> ''").groupBy(*grouping, "Cell_ID", "generation_num").agg(F.bool_or(F.col("stage") == "G1").alias("has"))
    return cycles.where("not has").drop("has")


def cycles_that_do_not_go_on(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, Cell_ID, generation_num)`` of cycles that are said to divide (``will_divide`` above 0) and have no next generation."""
    cycle = [*grouping, "Cell_ID", "generation_num"]
    base = df.select(*grouping, F.coalesce(integer(df, "Cell_ID"), F.lit(0)).alias("Cell_ID"), F.coalesce(integer(df, "generation_num"), F.lit(0)).alias("generation_num"), number(df, "will_divide").alias("divides"))
    before = base.select(*grouping, "Cell_ID", (F.col("generation_num") - 1).alias("generation_num")).distinct()
    return base.where(F.col("divides") > 0).select(*cycle).distinct().join(before, cycle, "left_anti")


def integrity_of_cycles(df: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, category, Cell_ID, generation_num)``: what does not fit together over all frames; the second only if there is a ``will_divide``."""
    found = [(cycles_without_g1(df, grouping), "cycles without G1")]
    if "will_divide" in df.columns:
        found.append((cycles_that_do_not_go_on(df, grouping), "will_divide without next generation"))
    parts = [p.select(*grouping, F.lit(name).alias("category"), "Cell_ID", "generation_num") for p, name in found]
    return reduce(DataFrame.unionByName, parts)


def cycle_fields(df: DataFrame, asked: DataFrame, grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, frame_i, Cell_ID, cell_cycle_stage, generation_num, relative_ID, relationship, is_history_known)`` of the objects asked for.

    ``asked`` holds ``(*grouping, frame_i, Cell_ID)``; of several rows of an object the first counts, an object without one has none. Ids that are no
    numbers are -1; of texts only "true" and "1" are known history.
    """
    at = [*grouping, "frame_i", "Cell_ID"]
    known = F.lower(lossy(df, "is_history_known")).isin("true", "1") if isinstance(kind(df, "is_history_known"), T.StringType) else truthy(df, "is_history_known")
    fields = {"cell_cycle_stage": lossy(df, "cell_cycle_stage"), "generation_num": F.coalesce(integer(df, "generation_num"), F.lit(-1)), "relative_ID": F.coalesce(integer(df, "relative_ID"), F.lit(-1)), "relationship": lossy(df, "relationship"), "is_history_known": known}
    rows = df.select(*map(col, grouping), integer(df, "frame_i").alias("frame_i"), integer(df, "Cell_ID").alias("Cell_ID"), ROW_ID, *(v.alias(k) for k, v in fields.items()))
    found = rows.join(asked.select(*grouping, F.col("frame_i").cast("long"), F.col("Cell_ID").cast("long")).distinct(), at)
    return found.withColumn("__n", F.row_number().over(Window.partitionBy(*at).orderBy(ROW_ID))).where("__n = 1").select(*at, *fields)


# --- custom annotations --------------------------------------------------------------------------------------------


def memberships(df: DataFrame, names: Sequence[str], grouping: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, name, frame_i, Cell_ID)`` of every flag column that is true."""
    flags = F.explode(F.array(*(F.when(truthy(df, n), F.lit(n)) for n in names)))
    rows = df.select(*grouping, flags.alias("name"), integer(df, "frame_i").alias("frame_i"), integer(df, "Cell_ID").alias("Cell_ID"))
    return rows.where("name is not null and frame_i is not null and Cell_ID is not null").distinct()


def toggled(members: DataFrame, changes: DataFrame) -> DataFrame:
    """Memberships after each change has put in what was out and taken out what was in."""
    both = members.unionByName(changes)
    return both.groupBy(*members.columns).count().where("count % 2 = 1").drop("count")


def write_flags(df: DataFrame, members: DataFrame, names: Sequence[str], grouping: Sequence[str] = ("position",), delete: Sequence[str] = ()) -> DataFrame:
    """The table with a 0/1 column for each name, and without the columns of names that are gone."""
    at = [*grouping, "frame_i", "Cell_ID"]
    wide = members.groupBy(*at).agg(*(F.max((F.col("name") == n).cast("int")).alias(f"__{n}") for n in names))
    joined = df.drop(*delete).join(wide, at, "left")
    kept = [c for c in df.columns if c not in names and c not in delete]
    return joined.select(*map(col, kept), *(F.coalesce(F.col(f"`__{n}`"), F.lit(0)).alias(n) for n in names))
