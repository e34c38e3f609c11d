"""Numbering of rows in an order, by ranges: no task sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.session import checkpointed

_PLACE = (1 << 33) - 1


def numbered(rows: DataFrame, order: Sequence[str], name: str = "n") -> DataFrame:
    """``rows`` with their place ``name`` in the order of some columns, from 1; rows alike in all of them stand in any order.

    Rows are sorted by ranges; a range's rows count on from those of all ranges before it. What is broadcast is a number for each range.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = checkpointed(dealt.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND(_PLACE)}))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(ranges), "__range").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__range", "__place", "__before")
