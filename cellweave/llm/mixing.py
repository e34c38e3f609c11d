"""Mixing of sources to target weights, by weighted fair queueing.

Each source's documents stand in a queue of their own, in the order of a hash of their ids, and behind it once more for a
second time round. A document's virtual finish time is what its source has served up to its end, divided by the source's target. All
queues are sorted by that time into one, which is cut where the budget is spent: at any place in it every source has been
served in proportion to its target.

Sorting is by ranges, and running sums are those of each range plus what stands before it, so that a source with a third of all
rows is spread over as many tasks as any other rows. Only sums of ranges, at most one for each range, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import checkpointed, looked_up

#: Weights of the sources in turn, the mix's size as a fraction of all sizes, and how often a document may come.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
TIMES = 2
#: Rows of a sorted range, about.
RANGE_ROWS = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space in a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, group: str, value: str, order: Sequence[str], ranges: int) -> DataFrame:
    """``rows`` sorted by ``group`` and ``order``, with ``before``: the sum of ``value`` over the group's earlier rows.

    ``value`` is a long without nulls. Rows alike in all of ``order`` may change places. Only a range's first group can have
    begun in a range before it, so what is broadcast is one sum for each range at most.
    """
    kinds = rows.schema
    names = [f.name for f in kinds]
    keys = [group, *order]
    dealt = rows.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(max(1, ranges), *keys, "__spread")
    dealt = dealt.sortWithinPartitions(*keys).select(*names, F.spark_partition_id().alias("__range"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = batch.column(names.index(group)).dictionary_encode()
            at = codes.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            before = np.cumsum(size) - size
            base = before[starts].copy()
            if codes.dictionary[int(at[0])].as_py() == last:
                base[0] -= carried
            before = before - np.repeat(base, np.diff(starts, append=len(size)))
            last, carried = codes.dictionary[int(at[-1])].as_py(), int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*names, "__range", "before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    summed = checkpointed(dealt.mapInArrow(sums, f"{fields}, __range int, before long"))
    each = summed.groupBy(group, "__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    begun = each.select(group, "__range", F.sum("__sum").over(earlier).alias("__base")).where("__base > 0")
    based = summed.join(F.broadcast(begun), [group, "__range"], "left")
    return based.withColumn("before", F.col("before") + F.coalesce("__base", F.lit(0))).select(*names, "before")


def ranked(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``rows``, whose ``key`` is unique, with their place ``name`` in the order of ``key``, from 0."""
    marked = rows.withColumn("__one", F.lit(1).cast("long")).withColumn("__all", F.lit(0))
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    return running(marked, "__all", "__one", [key], ranges).withColumnRenamed("before", name).drop("__one", "__all")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES) -> DataFrame:
    """``sources`` (``key``, ``source_size``, further columns) with ``target``, the words that each source gives the mix.

    In the order of ``key`` sources weigh ``weights``, repeating. They share the budget by weight; a target stops at
    ``times`` the source's size, and what is above is shared anew among the others until none is above. Each round is one
    sum over the sources.
    """
    placed = checkpointed(ranked(sources, "key", "__place"))
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("__weight", weigh).withColumn("__most", F.col("source_size") * times)
    budget = float((placed.agg(F.sum("source_size")).first()[0] or 0) * share[0]) / share[1]
    level, rounds = 0.0, True
    while rounds:
        above = F.lit(level) * F.col("__weight") > F.col("__most")
        full, rest = placed.agg(F.sum(F.when(above, F.col("__most"))), F.sum(F.when(~above, F.col("__weight")))).first()
        reached = (budget - (full or 0)) / rest if rest else level
        rounds, level = reached > level, max(level, reached)
    due = F.lit(level) * F.col("__weight")
    return placed.withColumn("target", F.when(due > F.col("__most"), F.col("__most").cast("double")).otherwise(due)).drop("__place", "__weight", "__most")


def _queues(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: tuple[int, int], times: int, seed: str) -> tuple[DataFrame, int, int]:
    """All rows in their sources' queues with ``source_size``, ``target`` and ``before``; the budget; ranges to sort in."""
    source = F.col(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))
    shuffled = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)
    rows = checkpointed(df.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), shuffled.alias("turn")))
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    sources = checkpointed(targets(sources, weights, share, times))
    n, total = sources.agg(F.sum("__rows"), F.sum("source_size")).first()
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if (n or 0) > 1 << 14 else 1, -(-(n or 0) // RANGE_ROWS))
    queued = running(rows, "key", "size", ["turn", "doc_id", "size"], ranges)
    return looked_up(queued, sources, "key", "__rows"), (total or 0) * share[0] // share[1], ranges


def _stream(queued: DataFrame, times: int, ranges: int) -> DataFrame:
    """Every time that a document may come, sorted by virtual finish time, with ``ahead``: the words of all before it."""
    round_ = F.explode(F.sequence(F.lit(0), F.least(F.lit(times - 1), F.floor(F.col("target") / F.col("source_size")).cast("int"))))
    rows = queued.where("size > 0").select("*", round_.alias("round"))
    finish = (F.col("round") * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target")
    rows = rows.withColumn("finish", finish).withColumn("__all", F.lit(0)).withColumnRenamed("before", "queued")
    return running(rows, "__all", "size", ["finish", "key", "round", "queued"], times * ranges).drop("__all").withColumnRenamed("before", "ahead")


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES, seed: str = "mix:") -> DataFrame:
    """The mix itself, in order: ``(doc_id, source, round, finish, ahead, words)``, sorted by virtual finish time.

    A row is one time that a document is read: all its words, or of the very last the first ``words``, as the budget is spent
    there. Rows are as in ``mix``.
    """
    queued, budget, ranges = _queues(df, id_col, text_col, source_col, weights, share, times, seed)
    stream = _stream(queued, times, ranges).where(F.col("ahead") < budget)
    return stream.select("doc_id", "source", "round", "finish", "ahead", F.least("size", F.lit(budget) - F.col("ahead")).alias("words"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES, seed: str = "mix:") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` of every row: its words, its source's words and target, and
    the words that the mix takes of it, repeats counted.

    Words are what ASCII white space separates; null and empty texts have none and are never taken. A null source is a source of its own, the
    last. The budget is ``share`` of all words, rounded down; the document at which it is spent is taken in part.
    Documents come in the order of a hash of ``seed`` and id, ties by id, then size, so reruns agree; rows alike in id, source and size are
    taken in any order among themselves. Ids may repeat or be null. An empty table gives none.
    """
    queued, budget, ranges = _queues(df, id_col, text_col, source_col, weights, share, times, seed)
    queued = checkpointed(queued)
    place = F.struct("finish", "key", "round", "queued")
    last = _stream(queued, times, ranges).where(F.col("ahead") < budget).agg(F.max(F.struct(place.alias("place"), (F.lit(budget) - F.col("ahead")).alias("rest"))).alias("last")).first()[0]
    taken = F.lit(0).cast("long")
    if last is not None:
        end, rest = last["place"], last["rest"]
        edge = F.struct(F.lit(end["finish"]), F.lit(end["key"]), F.lit(end["round"]), F.lit(end["queued"]).cast("long"))
        for k in range(times):
            finish = (F.lit(k) * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target")
            own = F.struct(finish, F.col("key"), F.lit(k), F.col("before"))
            words = F.when(own < edge, F.col("size")).when(own == edge, F.least("size", F.lit(rest).cast("long"))).otherwise(0)
            taken = taken + F.when((F.col("size") > 0) & (k * F.col("source_size") <= F.col("target")), words).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def oracle(weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES, seed: str = "mix:") -> str:
    """The mix in SQL, over ``documents``."""
    weigh = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
    WITH d AS (
      SELECT doc_id, source, coalesce('0' || source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             left(md5('{seed}' || coalesce(doc_id::VARCHAR, '')), 16) AS turn
      FROM documents
    ), s AS (
      SELECT k, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY k) - 1) % {len(weights)} {weigh} END AS w FROM d GROUP BY k
    ), a AS (
      SELECT *, {times} * source_size AS most, row_number() OVER r AS i, coalesce(sum({times} * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(source_size) OVER () AS total
      FROM s WINDOW r AS (ORDER BY {times} * source_size / w, k)
    ), l AS (
      SELECT CAST(total * {share[0]} AS DOUBLE) / {share[1]} AS budget, total * {share[0]} // {share[1]} AS whole, (CAST(total * {share[0]} AS DOUBLE) / {share[1]} - CAST(full_before AS DOUBLE)) / CAST(rest AS DOUBLE) AS level
      FROM a WHERE (CAST(total * {share[0]} AS DOUBLE) / {share[1]} - CAST(full_before AS DOUBLE)) / CAST(rest AS DOUBLE) * w <= most ORDER BY i LIMIT 1
    ), t AS (
      SELECT s.*, whole, CASE WHEN level * w > {times} * source_size THEN CAST({times} * source_size AS DOUBLE) ELSE level * w END AS target FROM s, l
    ), q AS (
      SELECT d.*, source_size, target, whole, coalesce(sum(size) OVER (PARTITION BY d.k ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER () AS row_id
      FROM d JOIN t ON d.k = t.k
    ), m AS (
      SELECT *, CAST(r * source_size + before + size AS DOUBLE) / target AS finish FROM q, range({times}) e(r) WHERE size > 0 AND r * source_size <= target
    ), c AS (
      SELECT *, coalesce(sum(size) OVER (ORDER BY finish, k, r, before ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM m
    ), g AS (SELECT row_id, sum(greatest(0, least(size, whole - ahead))) AS taken FROM c GROUP BY row_id)
    SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN g ON q.row_id = g.row_id"""
