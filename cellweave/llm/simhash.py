"""SimHash near-dedup through anchor points of a covering code.

A document's fingerprint has 64 bits, in two blocks of 32 or four of 16. Fingerprints within 3 bits of each other
differ in at most one bit on one of two blocks, those within 7 on one of four, so each block is searched with a
threshold of one; those within 11 differ in at most two on one of four, searched with a threshold of two. A block's
anchors are the words of the Hamming code of length 31 (or 15) over its low bits, with its high bit as it is. That code
is perfect: every value lies within the covering radius, 1, of exactly one anchor, its home. A fingerprint is replicated
to every anchor within covering radius plus threshold on the low bits, and to those one bit nearer with the other high
bit: 17 (or 9, or 44) at most. If two blocks differ within the threshold, the second reaches the home of the first, so
comparing the fingerprints at home with all that were replicated to the anchor finds every link.

Only distinct fingerprints are replicated, 34, 36 or 176 times at most. Anchors with many fingerprints are compared in
parts, each pair of parts in its own task if need be; a task returns a spanning forest of the links it finds,
never all pairs of a group. The forests become components with a few joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations
from operator import xor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded, checkpointed, looked_up, sole
from cellweave.llm.components import components, local_forest

SEED = 42
DISTANCE = 3
#: The blocks' width and the threshold in each of them, for each largest distance.
BLOCKS = {3: (32, 1), 7: (16, 1), 11: (16, 2)}
#: Fingerprints of an anchor that one task compares with as many others, pairs compared at once, and replicas sent at once.
BLOCK = 8192
PAIRS = 1 << 21
SENT = 1 << 16
#: Pairs from which a group is compared on its own, and cells of its square that are compared at once.
SQUARE, CELLS = 1 << 14, 1 << 18
#: Anchors with more than a block of fingerprints up to which they are broadcast; more meet the replicas in a shuffle.
BROADCAST = 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(text: str | None) -> list[bytes]:
    """The words that fingerprints and shingles are made of."""
    return (text or "").encode().translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text; zero if it has no words."""
    words = normal(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; ``fp`` holds the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("fingerprints", dict)
        for batch in batches:
            bits = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["id", "fp"])

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


@lru_cache
def _code(width: int, threshold: int) -> tuple[list[np.uint64], np.ndarray, np.ndarray]:
    """Parity masks of the Hamming code's checks on a block's low bits; for each syndrome, the flips that lead to anchors.

    These are the anchors within covering radius plus threshold, less one where the high bit flips too. The home comes
    first. The last array tells flips from filling.
    """
    length, high = width - 1, 1 << (width - 1)
    masks = [np.uint64(sum(1 << (p - 1) for p in range(1, length + 1) if p >> j & 1)) for j in range(length.bit_length())]
    found: list[list[int]] = [[] for _ in range(length + 1)]
    for weight in range(threshold + 2):
        for places in combinations(range(1, length + 1), weight):
            flip, syndrome = sum(1 << (p - 1) for p in places), reduce(xor, places, 0)
            found[syndrome] += [flip, flip | high] if weight <= threshold else [flip]
    flips = np.zeros((length + 1, max(map(len, found))), np.uint64)
    use = np.zeros(flips.shape, bool)
    for s, each in enumerate(found):
        flips[s, : len(each)], use[s, : len(each)] = each, True
    return masks, flips, use


def anchors(fp: np.ndarray, width: int = 32, threshold: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor with its block's number in the high bits, whether it is home)."""
    masks, flips, use = _code(width, threshold)
    out = []
    for block in range(64 // width):
        value = (fp >> np.uint64(width * block)) & np.uint64((1 << width) - 1)
        syndrome = sum(((np.bitwise_count(value & m) & 1).astype(np.int64) << j) for j, m in enumerate(masks))
        near = (value[:, None] ^ flips[syndrome]) | np.uint64(block << 32)
        row, column = np.nonzero(use[syndrome])
        out.append((row, near[row, column], column == 0))
    return tuple(np.concatenate(x) for x in zip(*out))


def _near(keys: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home row, other row) of all pairs within ``distance`` in whole groups (rows ordered by key, home side first), in parts."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(keys)])
    homes = np.add.reduceat(side == 0, starts) if len(starts) else np.empty(0, np.int64)
    others = sizes - homes
    large = homes * others >= SQUARE
    for at, n, m in zip(starts[large], homes[large], others[large]):
        yield from _near_in_one(fp, int(at), int(n), int(m), distance)
    starts, homes, others = starts[~large], homes[~large], others[~large]
    total = np.cumsum(homes * others)
    for k in range(0, int(total[-1]) if len(total) else 0, PAIRS):
        pair = np.arange(k, min(k + PAIRS, int(total[-1])))
        group = np.searchsorted(total, pair, "right")
        inside = pair - (total[group] - homes[group] * others[group])
        i = starts[group] + inside // others[group]
        j = starts[group] + homes[group] + inside % others[group]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= distance
        if near.any():
            yield i[near], j[near]


def _near_in_one(fp: np.ndarray, at: int, n: int, m: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of one large group, ``n`` homes from ``at`` on and ``m`` others after them: whole rows of its square at once."""
    home, other, step = fp[at : at + n, None], fp[at + n : at + n + m], max(1, CELLS // m)
    held, size = [], 0
    for k in range(0, n, step):
        close = np.flatnonzero(np.bitwise_count(home[k : k + step] ^ other) <= distance)
        held.append((at + k + close // m, at + n + close % m))
        size += len(close)
        if size and (size > CELLS or k + step >= n):
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0


def _busy(members: DataFrame) -> DataFrame:
    """``(anchor, homes, others)``: in how many parts either side of an anchor with more than a block of members is; broadcast while they are few.

    Of the members one in 17, 9 or 44 is at home, so that others are sent more than once at anchors with a whole block of homes alone.
    """
    counts = members.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h")).where((F.col("n") > BLOCK) & (F.col("h") > 0))
    busy = checkpointed(counts.select("anchor", *(F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("h", "homes"), ("n", "others")))))
    return F.broadcast(busy) if busy.count() <= BROADCAST else busy.hint("merge")


def meetings(
    fps: DataFrame, distance: int, found: Callable[[np.ndarray, np.ndarray, np.ndarray, Callable[[str, np.ndarray], np.ndarray]], Iterator[tuple[np.ndarray, ...]]], shape: str
) -> DataFrame:
    """What ``found(anchor, i, j, of)`` yields of the pairs within ``distance`` that meet at an anchor.

    ``fps`` has distinct rows of ``fp`` and any other long columns; ``of(column, i)`` has those of the rows ``i``.
    Two rows meet at least once with each of them at home.
    """
    width, threshold = BLOCKS[min(d for d in BLOCKS if d >= distance)]
    own = ["fp", *(c for c in fps.columns if c != "fp")]
    typed = ", ".join(f"{c} long" for c in own)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, SENT // (_code(width, threshold)[1].shape[1] * (64 // width)))
        for batch in batches:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            for k in range(0, batch.num_rows, most):
                part = [x[k : k + most] for x in columns]
                row, anchor, home = anchors(part[0].view(np.uint64), width, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), *(pa.array(x[row]) for x in part), pa.array(home)], ["anchor", *own, "home"])

    members = fps.select(*own).mapInArrow(replicate, f"anchor long, {typed}, home boolean")
    # Spark takes replicas to be as few as fingerprints; the left side of an outer join is one that it never broadcasts.
    dealt = members.join(_busy(members), "anchor", "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("homes", "others")})
    part = lambda c: F.pmod(F.xxhash64(*own), F.col(c)).cast("int")
    # Each row goes to every part of the home side and, from home, to every part of the other side.
    dealt = dealt.withColumn("each", F.explode(F.sequence(F.lit(0), F.col("homes") + F.when(F.col("home"), F.col("others")).otherwise(0) - 1)))
    other = F.col("each") < F.col("homes")
    a, b = F.when(other, F.col("each")).otherwise(part("homes")), F.when(other, part("others")).otherwise(F.col("each") - F.col("homes"))
    rows = dealt.select("anchor", a.alias("a"), b.alias("b"), other.cast("int").alias("side"), *own).repartition("anchor", "a", "b").sortWithinPartitions("anchor", "a", "b", "side")
    names = [x.split()[0] for x in shape.split(", ")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def pairs(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fp = parts[2].view(np.uint64)
            of = lambda name, rows: fp[rows] if name == "fp" else parts[2 + own.index(name)][rows]
            for i, j in _near(parts[0], parts[1], fp, distance):
                for columns in found(parts[0][i, 0], i, j, of):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names)

        for batch in batches:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            new = [np.stack(columns[:3], axis=1), *columns[3:]]
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            last = np.flatnonzero((held[0] != held[0][-1]).any(axis=1)) if len(held[0]) else []
            if len(last):
                cut = last[-1] + 1
                yield from pairs([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield from pairs(held)

    return rows.mapInArrow(compare, shape)


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(u, v)``: edges that connect the distinct fingerprints ``fp`` as all links within ``distance`` do."""

    def forest(_: np.ndarray, i: np.ndarray, j: np.ndarray, of: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = of("fp", i), of("fp", j)
        a, b = a[a != b], b[a != b]
        if len(a):
            yield local_forest(a, b)

    return meetings(fps.select("fp"), distance, forest, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (fingerprint bits as a signed long) and ``component_id``.

    A component holds all fingerprints reachable over links of ``distance`` (11 at most) or fewer bits;
    ``component_id`` is its smallest id. Texts are taken whole, A-Z in lower case; words are runs of anything
    but ASCII white space. Null and empty texts have fingerprint zero and link like any other. Rows with
    equal ids each get their row. A null id counts as larger than any; a component of null ids has a null
    ``component_id``. An empty table gives none.
    """
    if not 0 <= distance <= max(BLOCKS):
        raise ValueError("the blocks cover distances from 0 to 11")
    docs = checkpointed(fingerprints(df, id_col, text_col, shingle))
    least = docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    roots = components(links(least, distance))
    own = checkpointed(least.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    classes = checkpointed(own.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
    known = checkpointed(looked_up(own.select("fp", "n", "root"), classes, "root", "members"))
    return looked_up(docs, known.select("fp", "component_id", "n"), "fp", "n").select("id", "fp", "component_id")
