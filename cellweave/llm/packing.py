"""Packing of token ids into sequences of a fixed length, and the matrices that training reads.

Two packers share the tokenizer and the cutting of overlong documents:

* ``pack_matrices``, best-fit-decreasing: each task gathers pools of a fixed number of tokens, packs a pool from its
  longest piece to its shortest with a segment tree over free capacities, and writes matrices of ids with the
  cumulative lengths and position resets of every row. Nothing is shuffled; a pool bounds a task's memory.
* ``place_pieces``, bounded-space online best-fit: only the pieces' lengths are shuffled. A fixed number of sequences is
  open, kept in a bit set keyed by free space; where no more may open, the fullest closes.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweave.llm.common import bounded, slices, sole

#: A task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
LENGTH = 1024
END = 2
#: Words that a task's process remembers at most, and new words that the tokenizer gets as one text.
REMEMBERED = 1 << 17
TOGETHER = 512
LONG = 64
#: Bytes of text that are encoded together.
PART = 4 << 20
#: Open sequences of a task, and pieces that it looks at together before it places the longest of them first.
OPEN = 4096
LOOKAHEAD = 1 << 15
#: Tokens of a pool for best-fit-decreasing, and rows of a matrix.
POOL_TOKENS = 1 << 21
MATRIX_ROWS = 64


#: White space that is followed by a space: a run that a split at spaces would part.
_PARTED = "[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordIds:
    """Texts to ids, by way of their distinct words.

    The byte-level tokenizer splits a text into pieces and encodes each for itself. No piece reaches over a space that
    follows something else than white space, so the ids of a text that is split at its spaces are those of its words in
    turn, each word but the first with a space before it. Arrow splits and numbers the words; the tokenizer sees each
    distinct word once, many together: no id but a word's first begins with a space. A numpy gather then makes one flat array
    of ids. Words that are found again are remembered, up to a fixed number; longer ones than ``LONG`` bytes are not.

    The tokenizer takes texts whole where white space stands before a space, or where the string of one of its added tokens
    stands, which it gives that token's id unless ``special_as_text``; and all texts, if it splits them by another rule.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        rule = json.loads(self.tokenizer.to_str())
        before = rule["pre_tokenizer"] or {}
        split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.splits = split and not rule["normalizer"] and not rule["post_processor"]
        strings = [t["content"] for t in rule["added_tokens"]]
        self.whole = "|".join([_PARTED, *map(re.escape, strings)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([""], pa.string())
        self.ids = self._encoded([" "])[0]
        self.starts, self.counts = np.zeros(1, np.int64), np.array([len(self.ids)])

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of each word, and by number where its ids start and how many they are, in the ids that come last.

        Words that are not remembered are encoded; those found more than once are remembered from then on.
        """
        each = words.dictionary_encode()
        codes = each.indices.to_numpy()
        number = pc.index_in(each.dictionary, self.words)
        new = pc.is_null(number).to_numpy(zero_copy_only=False)
        number = pc.fill_null(number, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = each.dictionary.filter(pa.array(new))
        text = fresh.to_pylist()
        found = self._encoded([f" {' '.join(text[k : k + TOGETHER])}" for k in range(0, len(text), TOGETHER)])
        ids = np.concatenate([self.ids, *found])
        begin = np.flatnonzero(self.spaced[ids[len(self.ids) :]]) + len(self.ids)
        starts, counts = np.concatenate([self.starts, begin]), np.concatenate([self.counts, np.diff(begin, append=len(ids))])
        number[new] = len(self.words) + np.arange(len(fresh))
        again = (np.bincount(codes, minlength=len(new))[new] > 1) & (pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= LONG)
        if len(self.words) + again.sum() > REMEMBERED:
            self._forget()
        keep = np.flatnonzero(again) + len(starts) - len(fresh)
        sizes = counts[keep]
        ends = np.cumsum(sizes)
        self.starts, self.counts = np.concatenate([self.starts, len(self.ids) + ends - sizes]), np.concatenate([self.counts, sizes])
        self.ids = np.concatenate([self.ids, ids[_runs(starts[keep], sizes)]])
        self.words = pa.concat_arrays([self.words, fresh.filter(pa.array(again))])
        return number[codes], starts, counts, ids

    def documents(self, texts: pa.Array, end: int) -> list[np.ndarray]:
        """The ids of each text, and ``end`` after them; a null text is an empty one."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        n = len(texts)
        if not n:
            return []
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.splits else np.ones(n, bool)
        parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        at = parts.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        words = parts.flatten()
        number, starts, counts, ids = self._numbered(words)
        # What begins a text stands for itself: its first word without a space, or all of a text that is taken whole.
        first = pc.if_else(pa.array(whole), texts, words.take(pa.array(at[:-1]))).dictionary_encode()
        begun = self._encoded(first.dictionary.to_pylist())
        own = np.array([len(x) for x in begun], np.int64)
        own_at = len(ids) + np.cumsum(own) - own
        store = np.concatenate([ids, *begun, np.array([end], np.uint32)])
        # The segments of all texts in turn: one for each word and one for the end.
        text = np.repeat(np.arange(n), np.diff(at))
        start, count = np.full(len(number) + n, len(store) - 1), np.ones(len(number) + n, np.int64)
        place = np.arange(len(number)) + text
        start[place], count[place] = starts[number], counts[number]
        head, code = at[:-1] + np.arange(n), first.indices.to_numpy()
        start[head], count[head] = own_at[code], own[code]
        ends = np.cumsum(count)
        flat = store[_runs(start, count)].astype("<u4")
        return np.split(flat, ends[at[1:] + np.arange(n)][:-1])


def tokenizer(path: str) -> WordIds:
    """The tokenizer of this process."""
    return sole(("words", path), lambda: WordIds(path))


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one, or full ones after a first that may be shorter."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


# --- bounded-space online best-fit ---------------------------------------------------------------------------------


class OpenBins:
    """Open sequences by free space; ``put`` says where a piece goes."""

    def __init__(self, length: int, most: int, first_id: int):
        self.length, self.most, self.next = length, most, first_id
        self.bits = self.open = 0
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        sequence = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return sequence

    def put(self, size: int) -> tuple[int, int]:
        """(sequence, offset): the open sequence with the least space that is enough, or a new one."""
        room = self.bits >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.length, self.next
            self.next += 1
        rest = free - size
        if rest:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.at[rest].append(sequence)
            self.bits |= 1 << rest
            self.open += 1
        return sequence, self.length - free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BPE_50K, length: int = LENGTH, end: int = END) -> DataFrame:
    """The pieces of every document: where each begins, its length and the CRC-32 of its ids (32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = tokenizer(path), ["doc_id", "piece", "start", "length", "ids_crc32"]
        for batch in slices(batches, PART):
            rows = []
            for i, ids in zip(batch.column(0).to_pylist(), own.documents(batch.column(1), end)):
                rows += [(i, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cuts(len(ids), length))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def place_pieces(cut: DataFrame, length: int = LENGTH, most_open: int = OPEN, lookahead: int = LOOKAHEAD) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Each task packs the pieces it is dealt, in an order that depends on them alone, so a task that runs again
    places them alike. Pieces are dealt by all that they are and by the task they come from, so that many like ones (null
    ids, repeated rows) spread too. A sequence's id holds its task's number in the high bits.
    """
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    order = [F.xxhash64(*own), *own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(length, most_open, TaskContext.get().partitionId() << 40)
        held: list[pa.RecordBatch] = []

        def placed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes = table["length"].to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for i in np.argsort(-sizes, kind="stable").tolist():
                sequence[i], offset[i] = bins.put(int(sizes[i]))
            table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            return table.combine_chunks().to_batches()[0]

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= lookahead:
                yield placed()
                held = []
        if sum(b.num_rows for b in held):
            yield placed()

    dealt = cut.withColumn("__deal", F.xxhash64(*own, F.spark_partition_id())).repartition("__deal").sortWithinPartitions(*order)
    return dealt.select(*own).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BPE_50K, length: int = LENGTH, end: int = END, most_open: int = OPEN) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``length`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. Whole texts are tokenized, with ``end``
    after each; a null or empty text is just that id. Only documents longer than a sequence are cut. Rows with equal
    or null ids are packed each for itself. An empty table gives none.
    """
    return place_pieces(pieces(df, id_col, text_col, path, length, end), length, most_open)


# --- best-fit-decreasing --------------------------------------------------------------------------------------------


class CapacityTree:
    """A segment tree over free capacities; a node counts the open sequences below it."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, free: int, sequence: int) -> None:
        self.at[free].append(sequence)
        node = self.leaves + free
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(free, sequence) of the least capacity that is ``size`` or more."""
        node = self.leaves + size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, self.at[free].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """The pieces of each sequence, longest pieces first."""
    tree, sequences = CapacityTree(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        found = tree.take(int(sizes[i]))
        free, sequence = found or (length, len(sequences))
        if found is None:
            sequences.append([])
        sequences[sequence].append(i)
        if free > sizes[i]:
            tree.add(free - int(sizes[i]), sequence)
    return sequences


MATRICES = "matrix_id long, n_rows int, ids binary, lengths array<int>, cu_seqlens array<array<int>>, positions binary, doc_ids array<array<long>>, starts array<array<long>>"


def pack_matrices(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = BPE_50K, length: int = LENGTH, end: int = END, pad: int = END, pool_tokens: int = POOL_TOKENS, matrix_rows: int = MATRIX_ROWS) -> DataFrame:
    """Matrices of packed ids, one per row, ``n_rows`` by ``length``.

    ``ids`` and ``positions`` are the matrices row by row, as little-endian unsigned 32-bit integers; a position counts
    from 0 at the start of each segment and, on padding (id ``pad``), from 0 after the last. ``lengths`` has the tokens of
    each row before padding, ``cu_seqlens`` the cumulative segment lengths from 0, ``doc_ids`` and ``starts`` the
    document of each segment and the place in it where the segment starts: with these an overlong document, cut without
    loss, is put together again.

    Whole texts are tokenized, with ``end`` after each; a null or empty text is just that id. Rows with equal or null ids
    are packed each for itself. An empty table gives none.
    """

    def matrices(pool: list[tuple[int | None, int, np.ndarray]], first: int) -> Iterator[dict]:
        sizes = np.array([len(x) for _, _, x in pool], np.int64)
        rows = best_fit_decreasing(sizes, length)
        for k in range(0, len(rows), matrix_rows):
            part = rows[k : k + matrix_rows]
            ids = np.full(len(part) * length, pad, "<u4")
            begins = np.zeros(len(ids), np.int64)
            cumulative = []
            for r, members in enumerate(part):
                edges = [0]
                for i in members:
                    at = r * length + edges[-1]
                    ids[at : at + sizes[i]] = pool[i][2]
                    begins[at] = at
                    edges.append(edges[-1] + int(sizes[i]))
                if edges[-1] < length:
                    begins[r * length + edges[-1]] = r * length + edges[-1]
                cumulative.append(edges)
            positions = (np.arange(len(ids)) - np.maximum.accumulate(begins)).astype("<u4")
            yield {
                "matrix_id": first + k // matrix_rows, "n_rows": len(part), "ids": ids.tobytes(), "lengths": [c[-1] for c in cumulative],
                "cu_seqlens": cumulative, "positions": positions.tobytes(),
                "doc_ids": [[pool[i][0] for i in m] for m in part], "starts": [[pool[i][1] for i in m] for m in part],
            }

    kinds = pa.schema([
        ("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("ids", pa.binary()), ("lengths", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))),
        ("positions", pa.binary()), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("starts", pa.list_(pa.list_(pa.int64()))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pool, tokens, made = tokenizer(path), [], 0, TaskContext.get().partitionId() << 40

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal pool, tokens, made
            for row in matrices(pool, made):
                made += 1
                yield pa.RecordBatch.from_pylist([row], kinds)
            pool, tokens = [], 0

        for batch in slices(batches, PART):
            for i, ids in zip(batch.column(0).to_pylist(), own.documents(batch.column(1), end)):
                for s, n in cuts(len(ids), length):
                    if tokens + n > pool_tokens:
                        yield from flushed()
                    pool.append((i, s, ids[s : s + n]))
                    tokens += n
        if pool:
            yield from flushed()

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, MATRICES)
