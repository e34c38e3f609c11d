"""Lineage forests: building, editing, propagating and asking about them.

A forest is a table of objects with ``Cell_ID_tree, generation_num_tree, parent_ID_tree, root_ID_tree, is_history_known``
and ``sisters``, an array; ``flat_sisters`` makes columns of it. Questions are joins. So are changes in an order where each step
sees the last one's result: a row then points to the one it takes its values from, and pointers are followed by doubling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.coerce import integer, require
from cellweave.operators.relatives import ROW_ID
from cellweave.session import checkpointed

TREE = ("Cell_ID_tree", "generation_num_tree", "parent_ID_tree", "root_ID_tree", "is_history_known", "sisters")
_KINDS = {c: T.LongType() for c in TREE[:4]} | {"is_history_known": T.BooleanType(), "sisters": T.ArrayType(T.LongType())}
CYCLE = ("generation_num", "relative_ID", "relationship")


def roots(df: DataFrame) -> DataFrame:
    """Every cell as a root of its own."""
    cell = integer(df, "Cell_ID")
    none = F.array().cast("array<bigint>")
    return df.withColumns({"Cell_ID_tree": cell, "generation_num_tree": F.lit(1).cast("long"), "parent_ID_tree": F.lit(-1).cast("long"), "root_ID_tree": cell, "is_history_known": F.lit(False), "sisters": none})


def normalised(df: DataFrame) -> DataFrame:
    """A forest that was loaded: rows without a parent become roots, others lose gaps; sisters ascend and do not repeat."""
    cell, parent = integer(df, "Cell_ID"), F.coalesce(integer(df, "parent_ID_tree"), F.lit(-1).cast("long"))
    lone = parent <= 0
    own = [c for c in df.columns if c == "sister_ID_tree" or c.startswith("sister_ID_tree_")]
    values = F.col("sisters") if "sisters" in df.columns else F.array(*(integer(df, c) for c in own)).cast("array<bigint>")
    kept = F.array_sort(F.array_distinct(F.filter(values, lambda x: x > 0)))
    return df.withColumns({
        "Cell_ID_tree": F.coalesce(integer(df, "Cell_ID_tree"), cell), "parent_ID_tree": parent,
        "generation_num_tree": F.when(lone, 1).otherwise(F.coalesce(integer(df, "generation_num_tree"), F.lit(2))).cast("long"),
        "root_ID_tree": F.when(lone, cell).otherwise(F.coalesce(integer(df, "root_ID_tree"), parent)),
        "is_history_known": ~lone, "sisters": F.when(lone, F.array().cast("array<bigint>")).otherwise(kept),
    }).drop(*own)


def _last_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of one cell in one frame the last in row order."""
    w = Window.partitionBy(*keys, "frame_i", "Cell_ID")
    return df.withColumn("__last", F.max(ROW_ID).over(w)).where(F.col(ROW_ID) == F.col("__last")).drop("__last")


def _followed(nodes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(*by, node, generation, root)`` of ``(*by, node, next, generation, root)``, whose pointers never meet again.

    A node without ``next`` is settled; any other has the root of the one it points to, and a generation more. Pointers are
    doubled: a round takes each as far again, so there are as many rounds as the longest way has binary digits, each one join
    of what is open, checkpointed.
    """
    nodes = checkpointed(nodes.withColumn("hops", F.lit(1).cast("long")))
    while nodes.where("next is not null").limit(1).count():
        target = nodes.select(*by, F.col("node").alias("next"), F.col("next").alias("__next"), F.col("hops").alias("__hops"), F.col("generation").alias("__generation"), F.col("root").alias("__root"))
        settled = F.col("__next").isNull()
        moved = nodes.where("next is not null").drop("generation", "root").join(target, [*by, "next"]).select(
            *by, "node", F.col("__next").alias("next"), (F.col("__generation") + F.when(settled, F.col("hops")).otherwise(0)).alias("generation"), F.col("__root").alias("root"),
            (F.col("hops") + F.col("__hops")).alias("hops"),
        )
        nodes = checkpointed(nodes.where("next is null").unionByName(moved))
    return nodes.select(*by, "node", "generation", "root")


def _others(family: str) -> Column:
    """A family without the cell itself; none where there is no family."""
    return F.coalesce(F.array_except(family, F.array("Cell_ID")), F.array().cast("array<bigint>"))


def _laid_out(df: DataFrame, other: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in other if c not in TREE), *(F.col(c).cast(_KINDS[c]).alias(c) for c in TREE))


def from_cycles(df: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """A forest from cell-cycle columns: whoever is not a mother descends from its relative, if that is above 0.

    Generation and root are the parent's, as its row stands when row order comes to the child; the parent's row is that of
    the same frame (the last), else its first. A parent without any row counts as a root itself. So each row points to its parent's if that
    comes before it, and pointers are followed by doubling. Row order tells a position's rows apart; keys have no nulls.
    """
    require(df, "frame_i", "Cell_ID", *CYCLE, ROW_ID)
    by = list(keys)
    typed = df.withColumns({c: integer(df, c) for c in ("frame_i", "Cell_ID", "relative_ID", "generation_num")})
    typed = typed.withColumn("__parent", F.when((F.col("relative_ID") > 0) & (F.lower(F.coalesce("relationship", F.lit(""))) != "mother"), F.col("relative_ID")))
    row = F.struct(ROW_ID, F.col("__parent").isNotNull().alias("child"), F.coalesce("generation_num", F.lit(1)).alias("generation"))
    here = typed.groupBy(*by, "frame_i", F.col("Cell_ID").alias("__parent")).agg(F.max(row).alias("__here"))
    first = typed.groupBy(*by, F.col("Cell_ID").alias("__parent")).agg(F.min(row).alias("__first"))
    links = typed.where("__parent is not null").select(*by, "frame_i", ROW_ID, "__parent", "generation_num")
    links = links.join(here, [*by, "frame_i", "__parent"], "left").join(first, [*by, "__parent"], "left").withColumn("__of", F.coalesce("__here", "__first"))
    source = F.col("__of")
    nodes = links.select(
        *by, F.col(ROW_ID).alias("node"), F.when(source["child"] & (source[ROW_ID] < F.col(ROW_ID)), source[ROW_ID]).alias("next"),
        F.coalesce(source["generation"] + 1, F.greatest(F.lit(2), F.coalesce("generation_num", F.lit(2)))).cast("long").alias("generation"), F.col("__parent").alias("root"),
    )
    found = _followed(nodes, by).select(*by, F.col("node").alias(ROW_ID), "generation", "root")
    family = typed.where("__parent is not null").groupBy(*by, "frame_i", F.col("__parent").alias("__top")).agg(F.array_sort(F.collect_set("Cell_ID")).alias("__family"))
    # A cell's sisters stand in the last of its rows in a frame; where those rows name several parents, the largest counts.
    w = Window.partitionBy(*by, "frame_i", "Cell_ID")
    marked = typed.withColumns({"__top": F.max("__parent").over(w), "__last": F.max(ROW_ID).over(w)})
    out = marked.join(found, [*by, ROW_ID], "left").join(family, [*by, "frame_i", "__top"], "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumns({
        "Cell_ID_tree": F.col("Cell_ID"), "generation_num_tree": F.coalesce("generation", "generation_num", F.lit(1)), "parent_ID_tree": F.coalesce("__parent", F.lit(-1)),
        "root_ID_tree": F.coalesce("root", "Cell_ID"), "is_history_known": F.col("__parent").isNotNull(), "sisters": F.when(F.col(ROW_ID) == F.col("__last"), _others("__family")).otherwise(none),
    })
    return _laid_out(out, df.columns)


def build(df: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """A forest of whatever the table has: complete tree columns, else cell-cycle columns, else roots."""
    tree = [c for c in df.columns if c.startswith("sister_ID_tree")] or ["sister_ID_tree"]
    needed = [*TREE[:5], *tree]
    if set(needed) <= set(df.columns) and not df.where(" or ".join(f"`{c}` is null" for c in needed)).limit(1).count():
        return normalised(df)
    return from_cycles(df, keys) if set(CYCLE) <= set(df.columns) else roots(df)


def _regrouped(forest: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sisters anew for the families of ``cells`` (``*keys, Cell_ID``), at each cell's first frame."""
    by = list(keys)
    parent = F.coalesce("parent_ID_tree", F.lit(-1))
    own = forest.join(cells, [*by, "Cell_ID"], "left_semi").groupBy(*by, "Cell_ID").agg(F.max(F.struct((-F.col("frame_i")).alias("f"), F.col(ROW_ID).alias("r"), parent.alias("p"))).alias("o"))
    own = checkpointed(own.select(*by, (-F.col("o.f")).alias("frame_i"), F.col("o.r").alias(ROW_ID), F.col("o.p").alias("parent_ID_tree")))
    families = own.where("parent_ID_tree > 0").select(*by, "frame_i", "parent_ID_tree").distinct()
    members = forest.join(families, [*by, "frame_i", "parent_ID_tree"], "left_semi").groupBy(*by, "frame_i", "parent_ID_tree").agg(F.array_sort(F.collect_set("Cell_ID")).alias("__family"))
    lone = own.where("parent_ID_tree <= 0").select(*by, ROW_ID, F.lit(True).alias("__lone"))
    out = forest.join(members, [*by, "frame_i", "parent_ID_tree"], "left").join(lone, [*by, ROW_ID], "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumn("sisters", F.when(F.col("__lone"), none).when(F.col("__family").isNotNull(), _others("__family")).otherwise(F.col("sisters")))
    return _laid_out(out, forest.columns)


def update_frames(forest: DataFrame, edits: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """Cells get other parents in a frame, by ``edits`` (``*keys, frame_i, Cell_ID, parent_ID``; -1: none, history unknown).

    A parent that is not in the frame makes the cell a root. A frame's edits count in the order of the cells' ids: a parent
    with a smaller id gives what its own edit has made of it, any other what it was. The families of the cells are regrouped. An
    edit of a cell that is not there is an error; of several edits of a cell the largest parent counts.
    """
    by, at = list(keys), [*keys, "frame_i"]
    edits = edits.select(*by, integer(edits, "frame_i").alias("frame_i"), integer(edits, "Cell_ID").alias("Cell_ID"), integer(edits, "parent_ID").alias("parent_ID"))
    edits = checkpointed(edits.groupBy(*at, "Cell_ID").agg(F.coalesce(F.max("parent_ID"), F.lit(-1)).alias("parent_ID")))
    frames = forest.join(edits.select(*at).distinct(), at, "left_semi")
    rows = checkpointed(_last_rows(frames, keys).select(*at, "Cell_ID", ROW_ID, F.coalesce("Cell_ID_tree", "Cell_ID").alias("tree"), F.coalesce("generation_num_tree", F.lit(1)).alias("g"), F.coalesce("root_ID_tree", "Cell_ID_tree", F.lit(-1)).alias("r")))
    missing = edits.join(rows, [*at, "Cell_ID"], "left_anti").first()
    if missing:
        raise ValueError(f"cell {missing['Cell_ID']} is not in frame {missing['frame_i']}")
    parents = rows.select(*at, F.col("Cell_ID").alias("parent_ID"), F.col("tree").alias("__tree"), F.col("g").alias("__g"), F.col("r").alias("__r"))
    edited = edits.select(*at, F.col("Cell_ID").alias("parent_ID"), F.lit(True).alias("__edited"))
    each = edits.join(rows.select(*at, "Cell_ID", ROW_ID), [*at, "Cell_ID"]).join(parents, [*at, "parent_ID"], "left").join(edited, [*at, "parent_ID"], "left")
    child = F.col("__tree").isNotNull() & (F.col("parent_ID") > 0)
    each = checkpointed(each.withColumn("child", child))
    nodes = each.select(
        *at, F.col("Cell_ID").alias("node"), F.when(F.col("child") & F.col("__edited") & (F.col("parent_ID") < F.col("Cell_ID")), F.col("parent_ID")).alias("next"),
        F.when(F.col("child"), F.col("__g") + 1).otherwise(1).cast("long").alias("generation"), F.when(F.col("child"), F.col("__r")).otherwise(F.col("Cell_ID")).alias("root"),
    )
    values = _followed(nodes, at).withColumnRenamed("node", "Cell_ID").join(each.select(*at, "Cell_ID", ROW_ID, "child", F.col("__tree").alias("__of")), [*at, "Cell_ID"])
    values = values.select(*by, ROW_ID, F.col("child").alias("__child"), F.col("__of"), "generation", "root")
    out = forest.join(values, [*by, ROW_ID], "left")
    hit, kept = F.col("__child").isNotNull(), lambda new, old: F.when(F.col("__child").isNotNull(), new).otherwise(F.col(old))
    out = out.withColumns({
        "parent_ID_tree": kept(F.when(F.col("__child"), F.col("__of")).otherwise(-1), "parent_ID_tree"), "generation_num_tree": kept(F.col("generation"), "generation_num_tree"), "root_ID_tree": kept(F.col("root"), "root_ID_tree"),
        "is_history_known": kept(F.col("__child"), "is_history_known"), "sisters": F.when(hit & ~F.col("__child"), F.array().cast("array<bigint>")).otherwise(F.col("sisters")),
    })
    return _regrouped(checkpointed(_laid_out(out, forest.columns)), edits.select(*by, "Cell_ID").distinct(), keys)


def update_frame(forest: DataFrame, frame: int, parents: dict[int, int], keys: Sequence[str] = ("position",), position: dict[str, object] | None = None) -> DataFrame:
    """``update_frames`` with the same few edits of one frame in every position, or in one."""
    places = forest.select(*keys).distinct()
    for name, value in (position or {}).items():
        places = places.where(F.col(name) == F.lit(value))
    pairs = F.array(*(F.struct(F.lit(c).cast("long").alias("Cell_ID"), F.lit(p).cast("long").alias("parent_ID")) for c, p in parents.items()))
    return update_frames(forest, places.select(*keys, F.lit(frame).cast("long").alias("frame_i"), F.inline(pairs)), keys) if parents else forest


def propagate(forest: DataFrame, frame: int, cells: Sequence[int] | DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """A frame's tree values of some cells on all their later rows, and their children there descend from them anew.

    ``cells`` are ids, in every position, or a table ``(*keys, Cell_ID)``. Children are the rows whose parent is one of the ids that the cell has in
    its tree from the frame on. Cells count in the order of their ids, each seeing what smaller ones have made of it: a row that has
    descended from one may go on to a larger one, so rows move on until none does, and pointers to who was seen are
    followed by doubling. A cell is no child of its own.
    """
    by, at = list(keys), [*keys, "frame_i"]
    if not isinstance(cells, DataFrame):
        ids = F.array(*(F.lit(int(c)).cast("long") for c in cells)) if cells else F.array().cast("array<bigint>")
        cells = forest.select(*by).distinct().select(*by, F.explode(ids).alias("Cell_ID"))
    cells = cells.select(*by, integer(cells, "Cell_ID").alias("Cell_ID")).distinct()
    own = checkpointed(_last_rows(forest.where(F.col("frame_i") >= frame).join(cells, [*by, "Cell_ID"], "left_semi"), keys).select(*at, "Cell_ID", ROW_ID, F.struct(*TREE).alias("__tree")))
    sources = own.where(F.col("frame_i") == frame).select(*by, "Cell_ID", F.col("__tree").alias("__new"))
    later = own.where(F.col("frame_i") > frame).join(sources, [*by, "Cell_ID"]).select(*at, "Cell_ID", ROW_ID, "__new")
    moved = forest.join(later.select(*by, ROW_ID, "__new"), [*by, ROW_ID], "left")
    moved = moved.withColumns({c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)) for c in TREE})
    moved = checkpointed(_laid_out(moved, forest.columns))

    tree = F.coalesce(F.col("__new")["Cell_ID_tree"], F.col("Cell_ID"))
    aliases = own.join(sources.select(*by, "Cell_ID"), [*by, "Cell_ID"], "left_semi")
    aliases = aliases.select(*by, F.col("Cell_ID").alias("over"), F.explode(F.array("Cell_ID", F.coalesce(F.col("__tree")["Cell_ID_tree"], F.col("Cell_ID")))).alias("parent")).distinct()
    parents = checkpointed(later.select(*at, F.col("Cell_ID").alias("over"), F.col(ROW_ID).alias("__row"), tree.alias("tree"), F.coalesce(F.col("__new")["generation_num_tree"], F.lit(1)).alias("g"), F.coalesce(F.col("__new")["root_ID_tree"], tree).alias("r")))
    offers = checkpointed(aliases.join(parents.select(*at, "over", "tree"), [*by, "over"]))
    moving = moved.where(F.col("frame_i") > frame).select(*at, ROW_ID, "Cell_ID", F.col("parent_ID_tree").alias("parent"), F.lit(None).cast("long").alias("after"))
    steps = None
    while True:
        met = moving.join(offers, [*at, "parent"]).where("over <> Cell_ID and (after is null or over > after)")
        step = checkpointed(met.groupBy(*at, ROW_ID, "Cell_ID").agg(F.min(F.struct("over", "tree")).alias("m")).select(*at, ROW_ID, "Cell_ID", F.col("m.over").alias("after"), F.col("m.tree").alias("parent")))
        if not step.limit(1).count():
            break
        steps = step if steps is None else steps.unionByName(step)
        moving = step
    if steps is None:
        return _regrouped(moved, cells, keys)
    steps = checkpointed(steps)
    seen = steps.select(*by, F.col(ROW_ID).alias("__row"), F.col("after").alias("before"))
    nodes = parents.join(seen, [*by, "__row"], "left").groupBy(*at, "over").agg(F.max(F.when(F.col("before") < F.col("over"), F.col("before"))).alias("next"), F.first("g").alias("generation"), F.first("r").alias("root"))
    values = _followed(nodes.withColumnRenamed("over", "node"), at)
    last = steps.groupBy(*at, ROW_ID).agg(F.max(F.struct("after", "parent")).alias("s")).select(*at, ROW_ID, F.col("s.after").alias("node"), F.col("s.parent").alias("__of"))
    found = last.join(values, [*at, "node"]).select(*by, ROW_ID, "__of", "generation", "root")
    out = moved.join(found, [*by, ROW_ID], "left")
    hit = F.col("__of").isNotNull()
    new = {"parent_ID_tree": F.col("__of"), "generation_num_tree": F.col("generation") + 1, "root_ID_tree": F.col("root"), "is_history_known": F.lit(True)}
    out = out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()})
    touched = cells.unionByName(steps.select(*by, "Cell_ID")).distinct()
    return _regrouped(checkpointed(_laid_out(out, forest.columns)), touched, keys)


def frame_rows(forest: DataFrame, frame: int) -> DataFrame:
    return forest.where(F.col("frame_i") == frame)


def frame_changes(forest: DataFrame, keys: Sequence[str] = ("position",), frame: int | None = None) -> DataFrame:
    """``(…, frame_i, kind, Cell_ID, parent_ID)`` of every frame after 0: new cells with a parent, orphans, and lost cells.

    A cell is lost if it was in the frame before, is not in this one, and is not the parent of a new one here.
    """
    rows = forest.select(*keys, "frame_i", integer(forest, "Cell_ID").alias("Cell_ID"), integer(forest, "parent_ID_tree").alias("parent_ID"))
    at = [*keys, "frame_i", "Cell_ID"]
    if frame is not None:
        rows = rows.where(F.col("frame_i").isin(frame - 1, frame))
    before = rows.select(*keys, (F.col("frame_i") + 1).alias("frame_i"), "Cell_ID").distinct()
    new = rows.where("frame_i > 0").join(before, at, "left_anti")
    child = F.coalesce(F.col("parent_ID") > 0, F.lit(False))
    new = new.select(*keys, "frame_i", F.when(child, "with parent").otherwise("orphan").alias("kind"), "Cell_ID", F.when(child, F.col("parent_ID")).otherwise(-1).alias("parent_ID"))
    parents = new.where("kind = 'with parent'").select(*keys, "frame_i", F.col("parent_ID").alias("Cell_ID"))
    last = rows.groupBy(*keys).agg(F.max("frame_i").alias("__last"))
    lost = before.join(rows, at, "left_anti").join(parents, at, "left_anti").join(last, list(keys)).where("frame_i <= __last and frame_i > 0")
    out = new.unionByName(lost.select(*keys, "frame_i", F.lit("lost").alias("kind"), "Cell_ID", F.lit(-1).cast("long").alias("parent_ID")))
    return out if frame is None else out.where(F.col("frame_i") == frame)


def mother_candidates(forest: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """``(…, frame_i, candidates)``: cells of the frame before that are not in this one, ascending; the first is the next to propose."""
    rows = forest.select(*keys, "frame_i", "Cell_ID").distinct()
    before = rows.select(*keys, (F.col("frame_i") + 1).alias("frame_i"), "Cell_ID")
    frames = rows.select(*keys, "frame_i").distinct()
    gone = before.join(rows, [*keys, "frame_i", "Cell_ID"], "left_anti").groupBy(*keys, "frame_i").agg(F.array_sort(F.collect_list("Cell_ID")).alias("candidates"))
    return frames.join(gone, [*keys, "frame_i"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<bigint>")))


def first_frames(df: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """Every row with the first frame of its cell."""
    return df.withColumn("first_frame_i", F.min("frame_i").over(Window.partitionBy(*keys, "Cell_ID")))


def same_frame_parents(forest: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """``parent_there``: whether the parent has a row in the child's frame, and ``parent_first``: its first frame anywhere, or null."""
    own = forest.select(*keys, "frame_i", F.col("Cell_ID").alias("parent_ID_tree")).distinct().withColumn("parent_there", F.lit(True))
    first = forest.groupBy(*keys, F.col("Cell_ID").alias("parent_ID_tree")).agg(F.min("frame_i").alias("parent_first"))
    out = forest.join(own, [*keys, "frame_i", "parent_ID_tree"], "left").join(first, [*keys, "parent_ID_tree"], "left")
    return out.withColumn("parent_there", F.coalesce("parent_there", F.lit(False)))


def sisters_of(forest: DataFrame, keys: Sequence[str] = ("position",)) -> DataFrame:
    """``sisters`` of every row with a parent: the frame's other children of that parent, ascending."""
    w = Window.partitionBy(*keys, "frame_i", "parent_ID_tree")
    family = F.array_sort(F.collect_set("Cell_ID").over(w))
    others = F.array_except(family, F.array("Cell_ID"))
    return forest.withColumn("sisters", F.when(F.col("parent_ID_tree") > 0, others).otherwise(F.array().cast("array<bigint>")))


def flat_sisters(forest: DataFrame, width: int) -> DataFrame:
    """Sisters as ``sister_ID_tree``, ``sister_ID_tree_1`` and so on, -1 where there is none."""
    names = ["sister_ID_tree", *(f"sister_ID_tree_{i}" for i in range(1, width))]
    each = {n: F.coalesce(F.get("sisters", F.lit(i)), F.lit(-1)) for i, n in enumerate(names)}
    return forest.withColumns(each).drop("sisters")


