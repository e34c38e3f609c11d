"""Lineage tables on disk: loaded or begun by position, and written back position by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import lineage
from cellweave.operators.relatives import ROW_ID

#: The columns that tell a lineage row apart, beside its position.
OBJECT = ("frame_i", "Cell_ID")


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether a table has been written there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def load_or_begin(objects: DataFrame, folder: str, position: str = "position") -> DataFrame:
    """The forest of every position of ``objects``: as it was written to ``folder``, or begun of the object table where it was not.

    A position that has been written is what was written, with the rows of a forest that was loaded (see ``lineage.normalised``);
    others are built of tree columns, cell-cycle columns or roots, whatever the object table has. Which is which is one anti-join of positions.
    """
    spark = objects.sparkSession
    if not exists(spark, folder):
        return lineage.build(objects, [position])
    kept = spark.read.parquet(folder)
    there = kept.select(position).distinct()
    old = lineage.normalised(kept.join(objects.select(position).distinct(), position, "left_semi"))
    new = lineage.build(objects.join(there, position, "left_anti"), [position])
    names = [c for c in new.columns if c in old.columns]
    return old.select(*names).unionByName(new.select(*names))


def write(forest: DataFrame, folder: str, position: str = "position") -> None:
    """The forest's positions in ``folder``, a partition for each; positions that ``forest`` does not hold stay as they are."""
    forest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(position).parquet(folder)


def edit(objects: DataFrame, folder: str, edits: DataFrame, position: str = "position") -> DataFrame:
    """Edits ``(position, frame_i, Cell_ID, parent_ID)`` of a table in place: only the positions that they name are read and written.

    Returns the edited positions' forest. A position without a written table is begun of ``objects`` first.
    """
    named = edits.select(position).distinct()
    before = load_or_begin(objects.join(named, position, "left_semi"), folder, position)
    after = lineage.checkpointed(lineage.update_frames(before, edits, [position]))
    write(after, folder, position)
    return after


def add_tree(objects: DataFrame, keys: Sequence[str] = ("position",), width: int | None = None) -> DataFrame:
    """An object table with the columns of its lineage, sisters as columns: as many as the largest family asks for, or ``width``.

    Tree columns that are there and filled are brought into order; others are derived.
    """
    forest = lineage.build(objects, keys)
    if width is None:
        width = max(1, forest.agg(F.max(F.size("sisters"))).first()[0] or 1)
    return lineage.flat_sisters(forest, width)


__all__ = ["OBJECT", "ROW_ID", "add_tree", "edit", "exists", "load_or_begin", "write"]
