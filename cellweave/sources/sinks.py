"""Small files that are written beside the images: slice choices, regions, id mappers, definitions, provenance.

What grows with the number of positions is a table of lines, ``(path, n, line)``, that tasks write, one folder per path;
what is one file by nature is a text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sources.sidecars import METADATA_ORDER

#: The columns of a file of slice choices, in their order.
SLICE_COLUMNS = (
    "filename", "frame_i", "z_slice_used_dataPrep", "which_z_proj", "is_from_dataPrep", "z_slice_used_gui", "which_z_proj_gui", "resegmented_in_gui",
    "crop_lower_z_slice", "crop_upper_z_slice",
)


def write_lines(lines: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """The lines of every path in their order, as one text file in ``folder/path=...``; readers find ``path`` as a column."""
    lines.repartition("path").sortWithinPartitions("path", "n").select("path", "line").write.mode(mode).partitionBy("path").text(folder)


def _field(c: str, kind: str) -> Column:
    """A field of a CSV line: flags as 1 and 0, nulls empty, quotes where commas, quotes or line ends ask for them."""
    text = F.col(c).cast("int").cast("string") if kind == "boolean" else F.col(c).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text), F.lit(""))


def csv_lines(table: DataFrame, path_col: str, columns: list[str], order: list[str]) -> DataFrame:
    """``(path, n, line)`` of a CSV file per path: a header, then its rows by ``order``; columns that are lacking stay empty."""
    kinds = dict(table.dtypes)
    own = [_field(c, kinds[c]) if c in kinds else F.lit("") for c in columns]
    row = F.struct(*(F.col(c) for c in order))
    body = table.select(F.col(path_col).alias("path"), F.struct(F.lit(1).alias("part"), row.alias("at")).alias("n"), F.concat_ws(",", *own).alias("line"))
    nothing = F.lit(None).cast(body.schema["n"].dataType["at"].dataType)
    head = table.select(F.col(path_col).alias("path")).distinct().select("path", F.struct(F.lit(0).alias("part"), nothing.alias("at")).alias("n"), F.lit(",".join(columns)).alias("line"))
    return head.unionByName(body)


def slice_lines(slices: DataFrame, path_col: str = "path") -> DataFrame:
    """Slice choices as lines of a file per path."""
    return csv_lines(slices, path_col, list(SLICE_COLUMNS), ["filename", "frame_i"])


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """``(path, key, value)`` as lines of a metadata file per path: known keys first in their order, others by name."""
    known = F.array_position(F.array(*map(F.lit, METADATA_ORDER)), F.col("key"))
    ranked = metadata.withColumn("__rank", F.when(known > 0, known).otherwise(len(METADATA_ORDER) + 1)).withColumnsRenamed({"key": "Description", "value": "values"})
    return csv_lines(ranked, "path", ["Description", "values"], ["__rank", "Description"])


def background_roi_json(rois: DataFrame) -> DataFrame:
    """``(path, n, line)``: regions ``(path, n, top, left, bottom, right)`` as one JSON list per path, each with ``pos`` and ``size``."""
    number = lambda c: F.col(c).cast("double")
    own = F.struct(F.array(number("left"), number("top")).alias("pos"), F.array(number("right") - number("left"), number("bottom") - number("top")).alias("size"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", own.alias("roi")))), lambda x: x["roi"])
    return rois.groupBy("path").agg(F.to_json(listed).alias("line")).select("path", F.lit(0).alias("n"), "line")


def _by_frame(rows: DataFrame, value: Column) -> DataFrame:
    """``(path, n, line)``: a JSON object per path of what each frame has, frames as text in the order of text."""
    each = rows.select("path", F.struct(F.col("frame_i").cast("string").alias("frame"), value.alias("of")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list("e")), lambda x: F.concat(F.lit('"'), x["frame"], F.lit('":'), x["of"]))
    return each.groupBy("path").agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("line")).select("path", F.lit(0).alias("n"), "line")


def replaced_ids_json(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(path, n, line)``: id changes ``(path, frame_i, old, new)`` of the two passes of a tracking table, as JSON per path.

    A frame has ``first_pass`` (ids that made way) and ``second_pass`` (ids that became tracks), each only if it has changes.
    """
    pairs = lambda rows, name: rows.groupBy("path", "frame_i").agg(F.array_sort(F.collect_set(F.struct(F.col("old").cast("string").alias("old"), F.col("new").cast("long").alias("new")))).alias(name))
    both = pairs(first, "a").join(pairs(second, "b"), ["path", "frame_i"], "full")
    part = lambda c, name: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{name}":'), F.to_json(F.map_from_entries(c))))
    own = F.concat(F.lit("{"), F.concat_ws(",", part("a", "first_pass"), part("b", "second_pass")), F.lit("}"))
    return _by_frame(both, own)


def deleted_ids_json(deleted: DataFrame) -> DataFrame:
    """``(path, n, line)``: the ids ``(path, frame_i, old)`` that went in each frame, as JSON per path, ``{frame: [ids]}``."""
    rows = deleted.groupBy("path", "frame_i").agg(F.array_sort(F.collect_set(F.col("old").cast("long"))).alias("ids"))
    return _by_frame(rows, F.to_json("ids"))


def lineage_info_json(changes: DataFrame) -> DataFrame:
    """``(path, n, line)``: what is new and gone in a frame (``lineage.frame_changes``, with ``path``) as JSON per path: cells with a parent, orphans, lost cells."""
    of = lambda kind, value: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, value)))
    pair = F.struct(F.col("Cell_ID").cast("long").alias("cell_id"), F.col("parent_ID").cast("long").alias("parent_id"))
    cell = F.col("Cell_ID").cast("long")
    own = F.struct(of("with parent", pair).alias("cells_with_parent"), of("orphan", cell).alias("orphan_cells"), of("lost", cell).alias("lost_cells"))
    return changes.groupBy("path").agg(F.to_json(own).alias("line")).select("path", F.lit(0).alias("n"), "line")


def mapper_names(segm: str) -> tuple[str, str]:
    """Names of the files of deleted and of replaced ids beside a tracked label image."""
    stem = segm.rsplit(".", 1)[0]
    return f"{stem}_deletedIDs_mapper.json", f"{stem}_replacedIDs_mapper.json"


def definitions_json(definitions: dict[str, dict]) -> str:
    """Custom annotations by name, as ``sidecars.annotation_definitions`` reads them."""
    names = {"kind": "type", "symbol": "symbol", "colour": "symbolColor", "shortcut": "shortcut", "description": "description", "keep_active": "keepActive", "hide": "isHideChecked"}
    kinds = {"single": "Single time-point", "multiple": "Multiple time-points", "class": "Multiple values class"}
    out = {}
    for name in sorted(definitions):
        own = {names[k]: v for k, v in definitions[name].items()}
        out[name] = own | {"type": kinds.get(own.get("type"), own.get("type"))}
    return json.dumps(out, indent=2, ensure_ascii=False)


def equations_ini(sources: list[str], formulas: dict[str, str]) -> str:
    """Where the columns of a joined table come from: its tables, and the formulas by name."""
    tables = [f"table{k} = {s}" for k, s in enumerate(sources, 1)]
    return "\n".join(["[sources]", *tables, "", "[equations]", *(f"{n} = {formulas[n]}" for n in sorted(formulas))])
