"""Alignment of two tokenizers' ids over the same bytes, each distinct segment of text once.

A text is cut before its runs of white space, wherever neither vocabulary can merge across: the byte-level tokenizer's own
pattern never goes from other characters on to white space, and of the piece vocabulary no piece holds such a step. White space
that some piece does hold after another character (a line's carriage return, say) begins no segment.

Tasks cut their texts, a chunk of documents at a time, into numbered distinct segments. Segments of all chunks meet by their text, are
tokenized and aligned once, and the pairs of ids that they link are counted, each as often as its segment occurs. Alignments then
go back to the chunks that hold the segment, once to each, and a chunk's documents are composed of them.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellweave.llm.common import bounded, checkpointed, looked_up, pack, sole, stored, unpack

#: A task has one core.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECES_32K = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of texts of a chunk; bytes of a segment up to which it is its own key; bytes of segments that are tokenized as one text.
CHUNK_BYTES = 16 << 20
KEY_BYTES = 64
JOINED_BYTES = 1 << 16
#: Places of a segment in one row.
PLACES = 1024
#: Pairs of ids up to which their counts are broadcast; more meet the segments in a shuffle.
BROADCAST = 1 << 20
#: The characters that Unicode counts as white space, and the sign that stands for a space in pieces.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_SIGN = "\u2581"


def _byte_of() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for what follows 255, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


def _needs(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(f"it cannot be shown where these vocabularies never merge: {what}")


class Pair:
    """A byte-level tokenizer and a piece model, where texts may be cut for both, and the alignment of segments."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        rule = json.loads(self.a.to_str())
        before = rule["pre_tokenizer"] or {}
        _needs(before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"), "the first splits by another rule")
        _needs(not rule["normalizer"] and all(t["special"] for t in rule["added_tokens"]), "the first changes texts, or takes strings out of them")
        code = _byte_of()
        self.bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            if all(c in code for c in piece):
                self.bytes_a[i] = bytes(code[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self._shown(path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        plain = [p.replace(SPACE_SIGN, " ") for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))]
        inside = {d for p in plain for c, d in zip(p, p[1:]) if c not in SPACE and d in SPACE}
        _needs(" " not in inside, "a piece of the second goes on over a space")
        space, joins = f"[{SPACE}]", f"(?:[{''.join(sorted(inside))}][{SPACE}]*[^{SPACE}]*)*" if inside else ""
        self.segment = re.compile(f"{space}+[^{SPACE}]*{joins}")

    def _shown(self, path_b: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as file:
            model.ParseFromString(file.read())
        normal, made = model.normalizer_spec, model.trainer_spec
        _needs(not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces and normal.add_dummy_prefix, "the second changes texts")
        _needs(made.model_type == made.BPE and not made.treat_whitespace_as_suffix and sum(p.type == p.BYTE for p in model.pieces) == 256, "the second is not byte-pair encoding that falls back on bytes")
        _needs(not any(p.type == p.USER_DEFINED for p in model.pieces), "the second takes strings out of texts")

    def segments(self, text: str | None) -> list[str]:
        """The segments of a space and the text; none for a text without tokens."""
        return self.segment.findall(f" {text}") if text and SPACE_SIGN not in text else []

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a text that begins with white space and stands behind some other character."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(f"x{text}"), np.int64)
        head = int(np.searchsorted(np.cumsum(self.length_b[b]), 2)) + 1
        own = text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != b" x" + own or self.length_b[b[:head]].sum() != 2 or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != own:
            raise RuntimeError("a segment's tokens are not its bytes, against what was shown of the vocabularies")
        return a, b[head:]

    def _aligned(self, segments: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        a, b = self._encoded("".join(segments))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends = np.cumsum([len(s.encode()) for s in segments])
        both, any_ = np.intersect1d(ends_a, ends_b), np.union1d(ends_a, ends_b)
        if not np.isin(ends, both).all():
            raise RuntimeError("a token goes over the end of a segment, against what was shown of the vocabularies")
        pairs = a[np.searchsorted(ends_a, any_)] << 32 | b[np.searchsorted(ends_b, any_)]
        names_a, names_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        to_a, to_b = ([0, *np.searchsorted(x, both, "right").tolist()] for x in (ends_a, ends_b))
        groups = [f"{','.join(names_a[i:j])}|{','.join(names_b[k:m])}" for i, j, k, m in zip(to_a, to_a[1:], to_b, to_b[1:])]
        cut_a, cut_b, cut_groups, cut_pairs = ([0, *np.searchsorted(x, ends, "right").tolist()] for x in (ends_a, ends_b, both, any_))
        for s in range(len(segments)):
            g, h = cut_groups[s], cut_groups[s + 1]
            yield cut_a[s + 1] - cut_a[s], cut_b[s + 1] - cut_b[s], h - g, ";".join(groups[g:h]), pairs[cut_pairs[s] : cut_pairs[s + 1]]

    def align(self, segments: list[str]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """Of each segment: tokens of both, groups, the groups' ids as text, and the linked pairs of ids, first << 32 | second.

        Segments that end in white space are tokenized for themselves, all others many together.
        """
        found: list = [None] * len(segments)
        held, size = [], 0
        for i, segment in enumerate(segments):
            if segment[-1] in SPACE:
                found[i] = next(self._aligned([segment]))
                continue
            held.append(i)
            size += len(segment)
            if size >= JOINED_BYTES:
                for k, x in zip(held, self._aligned([segments[k] for k in held])):
                    found[k] = x
                held, size = [], 0
        if held:
            for k, x in zip(held, self._aligned([segments[k] for k in held])):
                found[k] = x
        return found


def _pair(path_a: str, path_b: str) -> Pair:
    return sole(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))


def _chunks(df: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, chunk_bytes: int) -> DataFrame:
    """Documents by chunks: their ids, numbers of segments and segments' numbers, and the chunk's distinct segments with their occurrences."""

    def made(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = _pair(path_a, path_b)
        numbers: dict[str, int] = {}
        ids = pa.chunked_array([b.column(0) for b in held])
        codes, lengths = [], []
        for batch in held:
            for text in batch.column(1):
                found = [numbers.setdefault(s, len(numbers)) for s in own.segments(text.as_py())]
                codes.append(np.array(found, np.int32))
                lengths.append(len(found))
        flat = np.concatenate(codes)
        long = [len(s) > KEY_BYTES or len(s.encode()) > KEY_BYTES for s in numbers]
        keys = [hashlib.sha256(s.encode()).hexdigest()[:32] if x else s for s, x in zip(numbers, long)]
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()), "ids": [pack(ids.fill_null(0).to_numpy().astype(np.int64))], "no_ids": [pack(ids.is_null().to_numpy().astype(np.uint8))],
            "lengths": [pack(np.array(lengths, np.int64))], "codes": [pack(flat)], "keys": pa.array([keys], pa.list_(pa.string())),
            "texts": pa.array([[s if x else None for s, x in zip(numbers, long)]], pa.list_(pa.string())), "times": pa.array([np.bincount(flat, minlength=len(numbers))], pa.list_(pa.int64())),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= chunk_bytes:
                yield made(number, held)
                number, held = number + 1, []
        if held:
            yield made(number, held)

    rows = bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "chunk long, ids binary, no_ids binary, lengths binary, codes binary, keys array<string>, texts array<string>, times array<long>")


def _segments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every distinct segment with its occurrences, its alignment, and where it stands: ``places``, chunks and its number in them.

    A segment comes once from each chunk that has it, and all its rows meet in one sorted range of a task, which aligns it once
    and goes on through what follows. A segment of many chunks fills several rows, ``PLACES`` to a row.
    """
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("keys", "texts", "times")).alias("at", "s")).select("s.keys", "s.texts", "s.times", "chunk", "at")
    dealt = bounded(each).repartition("keys").sortWithinPartitions("keys")
    names = ["segment", "times", "n_a", "n_b", "n_groups", "groups", "pairs", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = _pair(path_a, path_b), TaskContext.get().partitionId() << 40
        last_key, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts, times, chunk, at = (batch.column(i) for i in range(5))
            each = keys.dictionary_encode()
            starts = np.flatnonzero(np.diff(each.indices.to_numpy(), prepend=-1))
            first = texts.take(pa.array(starts)).to_pylist()
            distinct = each.dictionary.to_pylist()
            known = last is not None and distinct[0] == last_key
            found = own.align([t if t is not None else k for k, t in zip(distinct[known:], first[known:])])
            found = [last, *found] if known else found
            last_key, last = distinct[-1], found[-1]
            ends = np.append(starts[1:], batch.num_rows)
            cut = [(k, i, min(i + PLACES, int(z))) for k, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())) for i in range(a, z, PLACES)]
            bounds = np.array([i for _, i, _ in cut] + [batch.num_rows])
            sums = np.add.reduceat(times.to_numpy(), bounds[:-1])
            n_a, n_b, n_groups, groups, pairs = zip(*(found[k] for k, _, _ in cut))
            linked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32()), pa.array(np.concatenate(pairs), pa.int64()))
            places = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([chunk, at], ["chunk", "at"]))
            numbers = [pa.array(x, pa.int64()) for x in (number + np.arange(len(cut)), sums, n_a, n_b, n_groups)]
            number += len(cut)
            yield pa.RecordBatch.from_arrays([*numbers, pa.array(groups, pa.string()), linked, places], names)

    return dealt.mapInArrow(run, "segment long, times long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, places array<struct<chunk: long, at: int>>")


def _counted(segments: DataFrame) -> DataFrame:
    """``(pair, links, best, rows)``: linked pairs, their links in all texts, whether no other first id has more with the second, segments' links."""
    pairs = segments.select("times", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("times").alias("links"), F.count("*").alias("rows"))
    pairs = pairs.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    return pairs.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"), "rows")


def _scored(segments: DataFrame, counted: DataFrame, broadcast: int) -> DataFrame:
    """``segments`` with ``n_best`` and ``count_sum``.

    Up to ``broadcast`` pairs, their counts go to every task as arrays, in which a segment's pairs are looked up; beyond that
    segments' pairs meet the counts in a shuffle, those that most segments have apart.
    """
    if counted.count() > broadcast:
        linked = looked_up(segments.select("segment", F.explode("pairs").alias("pair")), counted, "pair", "rows")
        sums = linked.groupBy("segment").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("links").alias("count_sum"))
        return segments.drop("pairs").join(sums, "segment")
    table = counted.select("pair", "links", "best").toArrow().sort_by("pair")
    sent = segments.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "links", "best")))
    names = [c for c in segments.columns if c != "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = sent.value
        for batch in batches:
            if batch.num_rows:
                own = batch.column(batch.schema.names.index("pairs"))
                starts = own.offsets.to_numpy()[:-1] - own.offsets[0].as_py()
                at = np.searchsorted(pair, own.flatten().to_numpy())
                sums = [pa.array(np.add.reduceat(x[at].astype(np.int64), starts)) for x in (best, links)]
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), *sums], [*names, "n_best", "count_sum"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema if f.name != "pairs")
    return bounded(segments).mapInArrow(run, f"{kinds}, n_best long, count_sum long")


def vocabulary_map(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BPE_50K, path_b: str = PIECES_32K, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(a_id, b_id, links, best)``: the pairs of ids that overlap somewhere, how often, and whether it is the second id's most frequent."""
    segments = _segments(_chunks(df, id_col, text_col, path_a, path_b, chunk_bytes), path_a, path_b)
    pair = F.col("pair")
    return _counted(checkpointed(segments)).select(F.shiftright(pair, 32).alias("a_id"), pair.bitwiseAND((1 << 32) - 1).alias("b_id"), "links", "best")


_SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str = BPE_50K, path_b: str = PIECES_32K, chunk_bytes: int = CHUNK_BYTES, broadcast: int = BROADCAST) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` of every row.

    The first tokenizer (byte-level) encodes a space and the whole text, the second (pieces) the text, before which it puts a space itself;
    strings of special tokens are plain text. ``groups`` lists the ids between byte offsets where tokens of both end, as
    ``a1,a2|b1;a3|b2,b3``. A link is an overlap of a token of each; a pair's count is its links in all texts; ``n_best`` are the links
    whose count no other first id exceeds with the same second id, ``count_sum`` sums the counts. A null or empty text, and one that holds the pieces' sign
    for a space, whose bytes the pieces do not give back, has no tokens: zeros and an empty ``groups``. Ids may repeat or be null.
    An empty table gives none. Vocabularies of which it cannot be shown where they never merge raise a ``ValueError``.
    """
    chunks, _ = stored(_chunks(df, id_col, text_col, path_a, path_b, chunk_bytes))
    segments, _ = stored(_segments(chunks, path_a, path_b))
    counted = checkpointed(_counted(segments))
    scored = _scored(segments.drop("times"), counted, broadcast)
    back = scored.select(F.explode("places").alias("p"), *_SUMS, "groups").select("p.chunk", "p.at", *_SUMS, "groups")

    def composed(found: pa.Table, docs: pa.Table) -> pa.Table:
        found = found.take(pa.array(np.argsort(found["at"].to_numpy())))
        groups = found["groups"].to_pylist()
        sums = {c: found[c].to_numpy() for c in _SUMS}
        rows: dict[str, list] = {c: [] for c in ("id", *_SUMS, "groups")}
        for d in docs.to_pylist():
            lengths, codes = unpack(d["lengths"], np.int64), unpack(d["codes"], np.int32)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            rows["id"].append(pa.array(unpack(d["ids"], np.int64), pa.int64(), mask=unpack(d["no_ids"], np.uint8) > 0))
            for c, x in sums.items():
                total = np.concatenate([[0], np.cumsum(x[codes])])
                rows[c].append(pa.array(total[ends[1:]] - total[ends[:-1]]))
            each = codes.tolist()
            rows["groups"].append(pa.array([";".join(map(groups.__getitem__, each[i:j])) for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.string()))
        return pa.table({c: pa.chunked_array(x) for c, x in rows.items()})

    kinds = ", ".join(f"{c} long" for c in _SUMS)
    docs = chunks.select(F.col("chunk").alias("of"), "ids", "no_ids", "lengths", "codes")
    out = back.groupBy("chunk").cogroup(docs.groupBy("of")).applyInArrow(composed, f"id long, {kinds}, groups string")
    links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    return out.select("id", "n_a", "n_b", "n_groups", links, "n_best", "count_sum", "groups")
