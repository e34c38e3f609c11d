"""Substring dedup: a count-min prefilter over word windows, then exact grouping.

A window is ``window`` consecutive words of one document. A word is removed when some window that
covers it has a word sequence that also starts in a document with a smaller id.

Documents are dealt into chunks of a few megabytes by a hash of id, text and the part of the table that they
come from, so that like rows spread too; one exchange of the texts serves all three passes, so every pass sees the
same documents together.

1. *Sketch.* Each chunk contributes the cells of its distinct windows, once each. Chunk sketches are
   sparse (sorted cell numbers); a shard of cells merges them into count-min rows and returns to each
   chunk those of its cells whose estimate is two or more. Collisions only raise an estimate, so no
   window that occurs in two chunks is lost.
2. *Exact grouping.* Only windows estimated to be in two chunks go on, once per chunk and window, as
   96-bit digests with the chunk's smallest id. A shard of digests finds the smallest id of all and
   tells each chunk which of its windows begin in a smaller document elsewhere.
3. *Removal.* Each chunk settles its own repeats, adds those found elsewhere, and drops the words.

A window that any number of documents share costs at most one record per chunk; no document's windows
are ever compared in pairs. The number of cells and shards follows the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import bounded, pack, pack_sorted, power_of_two, sole, split_words, text_bytes, unpack, unpack_sorted, word_hashes

#: Bytes of text that one chunk holds on average, and windows that one shard holds at most on average.
CHUNK_BYTES = 4 << 20
SHARD_WINDOWS = 1 << 21
#: Cells per window of the whole corpus (as a power of two), and count-min rows with their width per window.
CELL_BITS = 4
ROW_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Odd bases of the two window polynomials.
BASES = (0x9DDFEA08EB382D69, 0xD6E8FEB86659FD93)
_LAST = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """A 64-bit hash of each ``window`` consecutive word hashes, by doubling widths."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, level, width, step, rest = np.zeros(n, np.uint64), 0, words, 1, base, window
    while rest:
        if rest & 1:
            out = out * np.uint64(step) + level[at : at + n]
            at += width
        rest >>= 1
        if rest:
            level = level[:-width] * np.uint64(step) + level[width:]
            width, step = 2 * width, step * step % (1 << 64)
    return _mixed(out)


class _Chunk:
    """The documents of one chunk in a fixed order, with the hashes of their windows."""

    def __init__(self, table: pa.Table, window: int):
        sole("chunks", dict)
        ids = [_LAST if x is None else x for x in table["__id"].to_pylist()]
        texts = ["" if x is None else x for x in table["__text"].to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.words, self.lengths = split_words(table["__text"].combine_chunks().take(pa.array(self.order, pa.int64())))
        flat = word_hashes(self.words)
        self.ends = np.cumsum(self.lengths)
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        n = max(0, len(flat) - window + 1)
        whole = np.arange(n) + window <= self.ends[doc[:n]] if n else np.empty(0, bool)
        self.at = np.flatnonzero(whole)
        self.owner = self.ids[doc[self.at]]
        self.high = window_hashes(flat, window, BASES[0])[self.at] if n else np.empty(0, np.uint64)
        self.low = (window_hashes(flat, window, BASES[1])[self.at] if n else np.empty(0, np.uint64)).astype(np.uint32)

    def groups(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows ordered by digest, where each digest begins, and the first window that has it.

        Documents are in the order of their ids, so the first window belongs to the digest's smallest id.
        """
        rows = np.arange(len(self.at)) if keep is None else np.flatnonzero(keep)
        order, starts = _by_digest(self.high[rows], self.low[rows])
        rows = rows[order]
        return rows, starts, np.minimum.reduceat(rows, starts) if len(rows) else rows


def _by_digest(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal digests together, and where each begins in it."""
    order = np.argsort(high)
    h, w = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (w[1:] != w[:-1])).any():  # two digests agree in their high parts alone
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        same = (h[1:] == h[:-1]) & (w[1:] == w[:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    return order, np.flatnonzero(new)


def _split(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending keys whose leading bits name the shard."""
    shards = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(shards)) + 1
    return [(int(shards[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(keys)]) if b > a]


def _table(schema: pa.Schema, **columns: list) -> pa.Table:
    return pa.table({k: pa.array(columns[k], schema.field(k).type) for k in schema.names}, schema=schema)


_CELLS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("cells", pa.binary())])
_REPEATED = pa.schema([("chunk", pa.int64()), ("cells", pa.binary())])
_DIGESTS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("least", pa.binary()), ("at", pa.binary())])
_ELSEWHERE = pa.schema([("chunk", pa.int64()), ("at", pa.binary())])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, chunk_bytes: int = CHUNK_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Remove from every text the words of windows that begin in a document with a smaller id.

    Returns one row per input row: ``document`` (the input row as a struct, so names cannot clash),
    ``n_words``, ``n_removed`` (long) and ``kept_text`` (kept words joined by one space).

    Words are maximal runs of anything but the six ASCII white-space characters, taken from the whole
    text. A null or empty text has no words and an empty ``kept_text``. A null id counts as larger than
    every id, and two rows with equal (or null) ids are not smaller than one another, so exact repeats
    of a row keep their words. Texts shorter than the window lose nothing. An empty table gives none.
    """
    total = text_bytes(df, text_col)
    chunks = max(1, -(-total // chunk_bytes))
    windows = max(1, total // 6)
    shard_bits = power_of_two(windows / shard_windows)
    cell_bits = min(60, power_of_two(windows) + CELL_BITS)
    row_bits = max(8, power_of_two(2 * min(windows, shard_windows)))

    docs = bounded(df).select(
        F.struct("*").alias("document"), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.spark_partition_id()), F.lit(chunks)).alias("chunk"),
    )
    by_chunk = docs.groupBy("chunk")

    def sketch(key: tuple, table: pa.Table) -> pa.Table:
        cells = np.unique(_Chunk(table, window).high >> np.uint64(64 - cell_bits))
        parts = _split(cells, cell_bits - shard_bits)
        return _table(_CELLS, shard=[s for s, _, _ in parts], chunk=[key[0].as_py()] * len(parts), cells=[pack_sorted(cells[a:b]) for _, a, b in parts])

    def merge(table: pa.Table) -> pa.Table:
        each = [unpack_sorted(x) for x in table["cells"].to_pylist()]
        cells = np.concatenate(each)
        estimate = np.full(len(cells), np.iinfo(np.int64).max)
        for m in ROW_MULTIPLIERS:
            slot = ((cells * np.uint64(m)) >> np.uint64(64 - row_bits)).astype(np.int64)
            estimate = np.minimum(estimate, np.bincount(slot, minlength=1 << row_bits)[slot])
        cuts = np.cumsum([len(x) for x in each])[:-1]
        kept = [x[e >= 2] for x, e in zip(each, np.split(estimate, cuts))]
        found = [(c, x) for c, x in zip(table["chunk"].to_pylist(), kept) if len(x)]
        return _table(_REPEATED, chunk=[c for c, _ in found], cells=[pack_sorted(x) for _, x in found])

    def digests(key: tuple, table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not len(repeated) or not len(table):
            return _DIGESTS.empty_table()
        chunk = _Chunk(table, window)
        cells = np.sort(np.concatenate([unpack_sorted(x) for x in repeated["cells"].to_pylist()]))
        own = chunk.high >> np.uint64(64 - cell_bits)
        keep = cells[np.minimum(np.searchsorted(cells, own), len(cells) - 1)] == own
        _, _, first = chunk.groups(keep)
        parts = _split(chunk.high[first], 64 - shard_bits)
        cut = lambda x, f: [f(x[first[a:b]]) for _, a, b in parts]
        return _table(_DIGESTS, shard=[s for s, _, _ in parts], chunk=[key[0].as_py()] * len(parts), high=cut(chunk.high, pack_sorted), low=cut(chunk.low, pack), least=cut(chunk.owner, pack), at=[pack(first[a:b].astype(np.uint32)) for _, a, b in parts])

    def least(table: pa.Table) -> pa.Table:
        high = [unpack_sorted(x) for x in table["high"].to_pylist()]
        flat, low = np.concatenate(high), np.concatenate([unpack(x, np.uint32) for x in table["low"].to_pylist()])
        owner = np.concatenate([unpack(x, np.int64) for x in table["least"].to_pylist()])
        order, starts = _by_digest(flat, low)
        smallest = np.repeat(np.minimum.reduceat(owner[order], starts), np.diff([*starts, len(order)]))
        smaller = np.empty(len(order), bool)
        smaller[order] = smallest < owner[order]
        cuts = np.cumsum([len(x) for x in high])[:-1]
        found = [(c, unpack(at, np.uint32)[s]) for c, at, s in zip(table["chunk"].to_pylist(), table["at"].to_pylist(), np.split(smaller, cuts)) if s.any()]
        return _table(_ELSEWHERE, chunk=[c for c, _ in found], at=[pack(x) for _, x in found])

    result = T.StructType([T.StructField("document", docs.schema["document"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def remove(table: pa.Table, elsewhere: pa.Table) -> pa.Table:
        chunk = _Chunk(table, window)
        rows, starts, first = chunk.groups()
        repeat = np.zeros(len(rows), bool)
        if len(rows):
            sizes = np.diff([*starts, len(rows)])
            here = chunk.owner[rows] > np.repeat(chunk.owner[first], sizes)
            flagged = np.zeros(len(rows), bool)
            for x in elsewhere["at"].to_pylist():
                flagged[unpack(x, np.uint32)] = True
            repeat[rows] = here | np.repeat(flagged[first], sizes)
        total_words = int(chunk.lengths.sum())
        edge = np.zeros(total_words + 1, np.int64)
        begin = chunk.at[repeat]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
        kept = np.concatenate([[0], np.cumsum(~covered)])
        at = np.concatenate([[0], kept[chunk.ends]])
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), chunk.words.filter(pa.array(~covered))), " ")
        document = table["document"].combine_chunks().take(pa.array(chunk.order, pa.int64()))
        return pa.table({"document": document, "n_words": pa.array(chunk.lengths, pa.int64()), "n_removed": pa.array(chunk.lengths - np.diff(at), pa.int64()), "kept_text": text})

    cells = by_chunk.applyInArrow(sketch, "shard long, chunk long, cells binary")
    repeated = cells.groupBy("shard").applyInArrow(merge, "chunk long, cells binary")
    windows_in_two = by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(digests, "shard long, chunk long, high binary, low binary, least binary, at binary")
    elsewhere = windows_in_two.groupBy("shard").applyInArrow(least, "chunk long, at binary")
    return by_chunk.cogroup(elsewhere.groupBy("chunk")).applyInArrow(remove, result)
