"""Token counts of greedy word pieces, by a linear longest-match automaton.

The vocabulary's pieces, those that begin a word and those that go on, form one trie; the second kind hang
below a root of their own. Each node has a failure link: the node that is reached when the longest tokens
are popped from the front of what was read so far, and the number of tokens popped. Both are worked out
once, parents first. A word is then counted in one pass over its characters, without trying a piece twice
and without building any piece.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import MEMO_ENTRIES, bounded, slices

PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")
_WORD_START = "▁"
#: Letters of a word up to which it is remembered, which bounds the memo in bytes.
LONG_WORD = 64


def vocabulary(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, pieces that go on) of a sentence-piece vocabulary; no control or byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in normal]
    begin = [p[1:] for p in names if p.startswith(_WORD_START) and len(p) > 1]
    return begin, [p for p in names if _WORD_START not in p]


class PieceCounter(dict):
    """Word to the number of its greedy pieces, 0 where some part of it is in no piece; remembered within bounds."""

    def __init__(self, begin: Iterable[str], going_on: Iterable[str]):
        super().__init__()
        self.children: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, words in ((0, begin), (1, going_on)):
            for word in words:
                node = root
                for c in word:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                    node = self.children[node][c]
                ends.add(node)
        self.link = [-1] * len(self.children)
        self.pops = [0] * len(self.children)
        todo = deque([0, 1])
        while todo:
            parent = todo.popleft()
            for c, node in self.children[parent].items():
                if node in ends:
                    self.link[node], self.pops[node] = 1, 1
                else:
                    at, popped = self.link[parent], self.pops[parent]
                    while at >= 0 and c not in self.children[at]:
                        popped += self.pops[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.pops[node] = self.children[at][c], popped
                todo.append(node)

    def __missing__(self, word: str) -> int:
        value = self.count(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value

    def count(self, word: str) -> int:
        node = total = 0
        for c in word:
            while c not in self.children[node]:
                if self.link[node] < 0:
                    return 0
                total += self.pops[node]
                node = self.link[node]
            node = self.children[node][c]
        while node != 1:
            if self.link[node] < 0:
                return 0
            total += self.pops[node]
            node = self.link[node]
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(*vocabulary(path))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = PIECES_32K) -> DataFrame:
    """``(id, n_words, n_tokens, n_unknown)`` of every row.

    Words are what Unicode white space separates, in whole texts. Each is cut greedily into the longest pieces; a
    word that cannot be cut whole is one token and counts in ``n_unknown``. Null and empty texts have no words. Ids
    may repeat or be null. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words = text.split() if text else []
                counts = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
                unknown = int((counts == 0).sum())
                rows.append((len(words), int(counts.sum()) + unknown, unknown))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_words", "n_tokens", "n_unknown"])

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long, n_unknown long")
