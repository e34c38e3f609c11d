"""Byte-level BPE, encoding and decoding, by longest matches with backtracking.

Every match of the splitting pattern is encoded separately. A byte string's BPE tokens are the one sequence
whose neighbouring tokens are *compatible*: merging the bytes of the two gives back just the two. An
Aho-Corasick automaton over the tokens (bytes as Latin-1 characters) lists the tokens that begin at each
byte. The encoder lays the longest compatible token, falls back to shorter ones, and takes the last token
back where none fits; a position once left that way is never entered again, since the tokens of a prefix are
unique. Steps are thus linear in the bytes. Compatibility of a pair is worked out once by plain merging of
those few bytes, then remembered. A piece that is itself a token is that token, whatever the merges say.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded, slices

MULTI_50K = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ID_BYTES = 4
#: Pieces, and pairs of tokens, that a task's process remembers at most.
MEMO_ENTRIES = 400_000
#: Characters of a piece beyond which it is not remembered.
LONG_PIECE = 128


class BytePairCodec(dict):
    """Piece of text to the bytes of its ids (little-endian, unsigned, 32 bits), remembered within bounds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            self[piece] = value
        return value

    def merged(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first; only for the few bytes of one or two tokens."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side; ``left`` is -1 at the start of a piece."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO_ENTRIES:
                self.fits.clear()
            alone = [right] if left < 0 else [left, right]
            known = self.fits[left, right] = self.merged(b"".join(self.tokens[t] for t in alone)) == alone
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        if raw in self.ranks:
            return [self.ranks[raw]]
        begin: list[list[tuple[int, int]]] = [[] for _ in raw]
        for last, (token, length) in self.automaton.iter(raw.decode("latin-1")):
            begin[last - length + 1].append((token, last + 1))
        alive = [True] * (len(raw) + 1)
        laid: list[tuple[int, int]] = []
        at, compatible = 0, self.compatible
        while at < len(raw):
            left = laid[-1][0] if laid else -1
            options = begin[at]  # shortest first, as matches come by where they end
            while options and not (alive[options[-1][1]] and compatible(left, options[-1][0])):
                options.pop()
            if options:
                token, end = options.pop()
                laid.append((token, at))
                at = end
            elif laid:
                alive[at] = False
                _, at = laid.pop()
            else:
                raise ValueError("the ranks have no token for some byte")
        return [t for t, _ in laid]

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(a): int(b) for a, b in lines}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> BytePairCodec:
    """The codec of a rank file, once per process."""
    return BytePairCodec(ranks(path), pattern)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks(path).items()}


def decoded(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MULTI_50K) -> DataFrame:
    """``(id, ids)`` of every row; ``ids`` are little-endian unsigned 32-bit integers.

    Whole texts are encoded, without special tokens. A null or empty text has no ids (an empty binary).
    Ids may repeat or be null; each row gets its own. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches):
            ids = [own.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def decode(df: DataFrame, path: str = MULTI_50K) -> DataFrame:
    """``(id, ids)`` to ``(id, ids, decoded)``, the bytes that the ids stand for; null ids give no bytes.

    Together, rows of any length keep their bytes: a token may end within a character, so the result is
    binary, not text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_bytes(path)
        for batch in slices(batches):
            raw = [decoded(x, tokens) if x else b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    return bounded(df).select("id", "ids").mapInArrow(run, "id long, ids binary, decoded binary")
