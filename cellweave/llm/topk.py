"""Exact top-k by inner product, with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into shards by their ids; a shard sorts each dimension once. Blocks of queries are sent to every
shard. A query reads the lists of the dimensions it weighs, from the end that its weight's sign favours, a few ranks
deeper each round; vectors met for the first time are scored in full. What no list has shown yet scores at most the
weighted sum of the values at the present depth, and once that bound is below the k-th best score the shard is done.
The best of all shards are merged. Every query meets every vector's shard: a stated query set against all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import checkpointed

#: Vectors of a shard at most on average; shards at least, if there are that many vectors; queries of a block.
SHARD = 1 << 15
SHARDS = 48
BLOCK = 1024
#: Ranks that the first round reads of each list; each further round reads as many as all before.
DEPTH = 4
_LIMIT = 1 << 63


class Shard:
    """The vectors of a shard, each dimension's order, and the search."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by_id], vectors[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable")
        self.largest = float(np.abs(self.x).max(initial=0))

    def search(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the ``k`` best, ties to the smaller id."""
        n, d = self.x.shape
        exact = self.largest * float(np.abs(q).max(initial=0)) * max(1, d) < 2**53
        x, weights = (self.x, q) if exact else (self.x.astype(object), np.array([int(v) for v in q], object))
        used = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        seen[np.searchsorted(self.ids, own, "left") : np.searchsorted(self.ids, own, "right")] = True
        best_rows, best = np.empty(0, np.int64), np.empty(0, x.dtype)
        depth = DEPTH
        while True:
            if depth >= n or not len(used):
                new = np.flatnonzero(~seen)
            else:
                up = used[q[used] > 0]
                down = used[q[used] < 0]
                met = np.concatenate([self.order[n - depth :, up].ravel(), self.order[:depth, down].ravel()])
                new = np.unique(met[~seen[met]])
            seen[new] = True
            scores = x[new] @ weights
            if not exact:
                scores = np.array([int(sum(int(a) * b for a, b in zip(row, weights))) for row in self.x[new].tolist()], object)
            best_rows, best = np.concatenate([best_rows, new]), np.concatenate([best, scores])
            first = sorted(range(len(best)), key=lambda i: (-best[i], best_rows[i]))[:k] if not exact else np.lexsort((best_rows, -best))[:k]
            best_rows, best = best_rows[first], best[first]
            if depth >= n or not len(used):
                break
            edge = np.where(q[used] > 0, self.x[self.order[n - depth, used], used], self.x[self.order[depth - 1, used], used])
            bound = sum(int(a) * int(b) for a, b in zip(edge.tolist(), q[used].tolist()))
            if len(best) == k and best[-1] > bound:
                break
            depth *= 2
        return [(int(self.ids[r]), max(-_LIMIT, min(_LIMIT - 1, int(s)))) for r, s in zip(best_rows, best)]


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other vectors of every query by integer inner product.

    Components become floor(``scale`` * x). Vectors that are null or hold a null or non-finite component take no part,
    nor do rows with a null id; vectors meet only those of their own length. Rows alike in id and vector are one row, and a
    vector never meets rows of its own id. Unlike vectors of one id are candidates each, and as queries share one ranking, of all their scores. Ties go to the smaller id; fewer than ``k`` candidates give all. Scores beyond 64
    bits count as the largest or smallest. An empty table gives none.
    """
    array = vectors.schema[vector_col].dataType.simpleString()
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>" if array.startswith("array") else array).alias("v"), is_query.alias("q"))
    rows = rows.where("id is not null and v is not null").where(~F.exists("v", bad)).withColumn("d", F.size("v")).dropDuplicates(["id", "v"])
    rows = checkpointed(rows)
    n = rows.count()
    shards = max(min(SHARDS, -(-n // 128)), -(-n // SHARD), 1)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    none = F.lit(None)
    own = rows.select("d", shard.alias("shard"), F.lit(-1).alias("block"), "id", "v", none.cast("binary").alias("ids"), none.cast("binary").alias("matrix"))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().values.to_numpy(zero_copy_only=False)
        d = key[0].as_py()
        parts = range(0, len(ids), BLOCK)
        return pa.table({
            "d": pa.array([d] * len(parts), pa.int32()), "block": pa.array([key[1].as_py()] * len(parts), pa.int32()),
            "ids": pa.array([ids[i : i + BLOCK].tobytes() for i in parts], pa.binary()), "matrix": pa.array([flat[i * d : (i + BLOCK) * d].tobytes() for i in parts], pa.binary()),
        })

    queries = rows.where("q")
    blocks = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(8, -(-n // (32 * BLOCK))))).cast("int")
    queries = queries.select("id", "v", "d", blocks.alias("block")).groupBy("d", "block").applyInArrow(packed, "d int, block int, ids binary, matrix binary")
    sent = queries.select("d", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", none.cast("long").alias("id"), none.cast("array<double>").alias("v"), "ids", "matrix")
    dealt = own.unionByName(sent).repartition("d", "shard").sortWithinPartitions("d", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values, built = None, [], [], None
        for batch in batches:
            names = batch.schema.names
            c = {x: batch.column(i).to_pylist() for i, x in enumerate(names) if x != "v"}
            v = batch.column(names.index("v"))
            out = []
            for r in range(batch.num_rows):
                here = c["d"][r], c["shard"][r]
                if here != at:
                    at, ids, values, built = here, [], [], None
                if c["block"][r] < 0:
                    ids.append(c["id"][r])
                    values.append(np.floor(np.array(v[r].as_py(), np.float64) * scale))
                elif ids:
                    built = built or Shard(np.array(ids, np.int64), np.array(values).reshape(len(ids), here[0]))
                    asked = np.frombuffer(c["ids"][r], np.int64)
                    matrix = np.floor(np.frombuffer(c["matrix"][r], np.float64).reshape(len(asked), here[0]) * scale)
                    out += [(int(i), x, s) for i, q in zip(asked, matrix) for x, s in built.search(int(i), q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
