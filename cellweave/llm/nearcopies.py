"""Near copies: texts that share four fifths of their five-word shingles, found among close SimHash fingerprints.

Fingerprints only propose. Each proposed pair of texts is decided by its whole shingle sets, and groups are formed of the
pairs that pass. A first round decides the links to the fingerprint with most links at each anchor and to each fingerprint's
nearest; texts that it joins need no further comparison with each other. A second round finds the fingerprints that have
other links, and a third decides every such link, none left out.

No pair leaves the task where it is found: of a group's links only the texts go on, once for each group, their sets are brought to
it, all pairs of its two sides are decided there, and a forest of the similar ones is what comes out. Before that, a pair must pass
bounds that no similar pair fails: the sizes, and the parities of the sets' members in 512 bins, of which no more can differ than members do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded, checkpointed, looked_up, slices, sole
from cellweave.llm.components import components, local_forest
from cellweave.llm.simhash import BLOCKS, fingerprint, meetings, normal

#: Words to a shingle of the decision, and the shared part of a similar pair's shingles as a fraction.
SHINGLE = 5
SHARED, OF = 4, 5
PARITIES = 8
#: Shingles of home texts that a task holds at once, of others that pass a block of them, and edges before they are thinned.
HELD, PASSING = 1 << 21, 1 << 24
MOST_EDGES = 1 << 16
#: Texts of linked fingerprints up to which their keys are broadcast; more meet the documents in a shuffle.
BROADCAST = 1 << 20


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = normal(text)
    if not words:
        return np.empty(0, np.uint64)
    grams = (b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def parities(members: np.ndarray) -> np.ndarray:
    """For each of 64 bins a word, whether an odd number of members falls in it; as signed words."""
    counts = np.bincount((members & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _signed(df: DataFrame, id_col: str, text_col: str, row_col: str) -> DataFrame:
    """``(id, row, fp, text_hash)`` of every row; the hash tells texts apart that differ in more than case and white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole("fingerprints", dict)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
            hashes = [xxhash.xxh3_128_digest(b" ".join(normal(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), pa.array(hashes, pa.binary())], ["id", "row", "fp", "text_hash"])

    rows = bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, row {rows.schema['row'].dataType.simpleString()}, fp long, text_hash binary")


def _sets(df: DataFrame, entries: DataFrame, text_col: str, row_col: str) -> DataFrame:
    """``(node, fp, n, p0 ... p7, members)``: size, parities and packed shingle set of the texts of ``entries``."""
    wanted = entries.select("row", "node", "fp")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    names = ["node", "fp", "n", *(f"p{k}" for k in range(PARITIES)), "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            marks = np.array([parities(x) for x in sets], np.int64).reshape(-1, PARITIES)
            columns = [pa.array([len(x) for x in sets], pa.int64()), *(pa.array(np.ascontiguousarray(m)) for m in marks.T), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    texts = bounded(df).select(F.col(row_col).alias("row"), F.col(text_col).alias("text")).join(wanted, "row").select("node", "fp", "text")
    shape = ", ".join(f"{c} {'binary' if c == 'members' else 'long'}" for c in names)
    return texts.mapInArrow(run, shape).dropDuplicates(["node"])


def _decided(met: DataFrame, sets: DataFrame, labels: DataFrame | None = None, distance: int = 64) -> DataFrame:
    """``(u, v)``: similar pairs that connect what all similar pairs between the sides of each group connect.

    ``met`` holds ``(group, node, side)``, each once, side 0 or 1. A pair counts if its ``labels`` (``node, label``), if there are any, are unlike
    and its fingerprints differ in ``distance`` bits at most. A task holds shingles of some home texts of a group and lets the
    others pass; a group with more on either side is dealt in blocks, each text's set being sent once to each of its blocks.
    """
    sized = met.join(sets.select("node", "n"), "node")
    sized = checkpointed(sized.withColumn("label", F.col("node")) if labels is None else sized.join(labels, "node"))
    sums = sized.groupBy("group").agg(*(F.ceil(F.sum(F.when(F.col("side") == s, F.col("n") + 1).otherwise(0)) / most).cast("int").alias(c) for s, c, most in ((0, "a", HELD), (1, "b", PASSING))))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = sized.drop("n").join(sums.where("a > 0 and b > 0"), "group")
    home = dealt.where("side = 0").select("group", "node", "label", "side", own("a").alias("p"), every("b").alias("q"))
    other = dealt.where("side = 1").select("group", "node", "label", "side", own("b").alias("q"), every("a").alias("p"))
    rows = bounded(home.unionByName(other).join(sets.select("node", "members", "fp"), "node"))
    rows = rows.select("group", "p", "q", "side", "node", "fp", "label", "members").repartition("group", "p", "q").sortWithinPartitions("group", "p", "q", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, homes, index, edges = None, [], None, []

        def forest() -> Iterator[pa.RecordBatch]:
            if edges:
                u, v = local_forest(np.array([e[0] for e in edges]), np.array([e[1] for e in edges]))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for r, (key, side, node, fp, label) in enumerate(zip(keys, *(batch.column(k).to_pylist() for k in range(3, 7)))):
                if key != at:
                    yield from forest()
                    at, homes, index, edges = key, [], None, []
                members = np.frombuffer(batch.column(7)[r].as_buffer(), np.uint64)
                if side == 0:
                    homes.append((node, fp, label, members.copy()))
                    continue
                if index is None:
                    index = _Held(homes)
                edges += [(int(h), node) for h in index.similar(node, fp, label, members, distance)]
                if len(edges) > MOST_EDGES:
                    edges = list(zip(*(x.tolist() for x in local_forest(*(np.array(e) for e in zip(*edges))))))
        yield from forest()

    return rows.mapInArrow(run, "u long, v long").distinct()


class _Held:
    """Texts that a task holds, and which of them a further text is similar to."""

    def __init__(self, homes: list[tuple[int, int, int, np.ndarray]]):
        self.node, fp, self.label = (np.array([h[k] for h in homes], np.int64) for k in range(3))
        self.fp, self.n = fp.view(np.uint64), np.array([len(h[3]) for h in homes], np.int64)
        every, owner = np.concatenate([h[3] for h in homes]), np.repeat(np.arange(len(homes)), self.n)
        order = np.argsort(every, kind="stable")
        self.every, self.owner = every[order], owner[order]

    def similar(self, node: int, fp: int, label: int, members: np.ndarray, distance: int) -> np.ndarray:
        low, high = np.searchsorted(self.every, members, "left"), np.searchsorted(self.every, members, "right")
        sizes = high - low
        ends = np.cumsum(sizes)
        places = np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        both = np.bincount(self.owner[places], minlength=len(self.n))
        close = np.bitwise_count(self.fp ^ np.int64(fp).view(np.uint64)) <= distance
        return self.node[(both * OF >= (self.n + len(members) - both) * SHARED) & close & (self.label != label) & (self.node != node)]


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` as ``(group, node, side)``: each counts with its end that is in more pairs, the other being with it."""
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("d"))
    known = pairs
    for side in ("u", "v"):
        known = known.join(ends.select(F.col("node").alias(side), F.col("d").alias(f"d_{side}")), side)
    first = F.col("d_u") >= F.col("d_v")
    hubs = known.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("group"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("node"))
    return hubs.select("group", "node", F.lit(1).alias("side")).unionByName(hubs.select("group", F.col("group").alias("node"), F.lit(0).alias("side"))).distinct()


def _first_links(fps: DataFrame, distance: int) -> DataFrame:
    """``(u, v)``: each fingerprint's nearest, and its links to those with most links at the anchors where it is at home."""

    def found(anchor: np.ndarray, i: np.ndarray, j: np.ndarray, of: Callable) -> Iterator[tuple[np.ndarray, ...]]:
        a, b = of("fp", i), of("fp", j)
        use = a != b
        if not use.any():
            return
        u, v, at = a[use], b[use], anchor[use]
        order = np.lexsort((v, np.bitwise_count(u ^ v), u))
        first = order[np.r_[True, u[order][1:] != u[order][:-1]]]
        yield u[first], v[first], np.bitwise_count(u ^ v)[first].astype(np.int64)
        order = np.lexsort((v, at))
        new = np.flatnonzero(np.r_[True, (v[order][1:] != v[order][:-1]) | (at[order][1:] != at[order][:-1])])
        place, vertex, degree = at[order][new], v[order][new], np.diff(new, append=len(order))
        best = np.lexsort((vertex, -degree, place))
        best = best[np.r_[True, place[best][1:] != place[best][:-1]]]
        star = vertex[best][np.searchsorted(place[best], at)] == v
        edges = np.unique(np.stack([u[star], v[star]], axis=1), axis=0)
        yield edges[:, 0], edges[:, 1], np.full(len(edges), -1)

    rows = checkpointed(meetings(fps.select("fp"), distance, found, "u long, v long, bits long"))
    nearest = rows.where("bits >= 0").groupBy("u").agg(F.min(F.struct("bits", "v")).alias("near")).select("u", F.col("near.v").alias("v"))
    return rows.where("bits < 0").select("u", "v").unionByName(nearest).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _open(of: Callable, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows have unlike labels; each pair counts in one order."""
    return of("label", i) < of("label", j)


def _open_fingerprints(labelled: DataFrame, distance: int) -> DataFrame:
    """``fp``: the fingerprints that have a link between unlike labels."""

    def found(_: np.ndarray, i: np.ndarray, j: np.ndarray, of: Callable) -> Iterator[tuple[np.ndarray, ...]]:
        use = _open(of, i, j)
        if use.any():
            yield (np.unique(of("fp", np.concatenate([i[use], j[use]]))),)

    return meetings(labelled, distance, found, "fp long").distinct()


def _open_groups(marked: DataFrame, distance: int) -> DataFrame:
    """``(group, node, side)``: by anchor the texts that have a link between unlike labels there which passes the bounds.

    A link counts at one anchor alone: in the first block where its fingerprints are near enough, with the smaller one at home.
    """
    width, threshold = BLOCKS[min(d for d in BLOCKS if d >= distance)]
    mask = np.uint64((1 << width) - 1)

    def found(anchor: np.ndarray, i: np.ndarray, j: np.ndarray, of: Callable) -> Iterator[tuple[np.ndarray, ...]]:
        use = of("label", i) != of("label", j)
        anchor, i, j = anchor[use], i[use], j[use]
        for k in range(0, len(i), 1 << 17):
            at, a, b = anchor[k : k + (1 << 17)], i[k : k + (1 << 17)], j[k : k + (1 << 17)]
            fp_a, fp_b, u, v = of("fp", a), of("fp", b), of("node", a), of("node", b)
            differ = fp_a ^ fp_b
            first = np.full(len(at), -1)
            for block in reversed(range(64 // width)):
                first[np.bitwise_count((differ >> np.uint64(width * block)) & mask) <= threshold] = block
            keep = (first == at >> 32) & ((fp_a < fp_b) | ((fp_a == fp_b) & (u < v)))
            n, m = of("n", a), of("n", b)
            room = (n + m) * (OF - SHARED)
            odd = sum(np.bitwise_count((of(f"p{p}", a) ^ of(f"p{p}", b)).view(np.uint64)).astype(np.int64) for p in range(PARITIES))
            keep &= (np.abs(n - m) * (OF + SHARED) <= room) & (odd * (OF + SHARED) <= room)
            for side, node in ((0, u), (1, v)):
                own = np.unique(np.stack([at[keep], node[keep]], axis=1), axis=0)
                if len(own):
                    yield own[:, 0].copy(), own[:, 1].copy(), np.full(len(own), side)

    return meetings(marked, distance, found, "group long, node long, side long").distinct()


def near_copies(df: DataFrame, distance: int, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row") -> DataFrame:
    """``(id, row, component)`` of every row; ``row_col``, of any type that can be compared, tells the rows apart.

    A component holds the texts reachable over pairs whose fingerprints differ in ``distance`` bits at most and which share
    at least 0.8 of their distinct five-word shingles. Texts that differ in case (A-Z) and white space alone are one; texts
    without words, null ones too, are one. Texts are told apart by 128-bit hashes, shingles by 64 bits. An empty table gives none.
    """
    rows = checkpointed(_signed(df, id_col, text_col, row_col))
    nodes = rows.groupBy("text_hash").agg(F.min("fp").alias("fp"), F.min("row").alias("row"), F.count("*").alias("n"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    first = checkpointed(_first_links(nodes.select("fp").distinct(), distance))
    shared = nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    busy = first.select(F.col("u").alias("fp")).union(first.select(F.col("v").alias("fp"))).union(shared).distinct()
    entries = checkpointed(nodes.join(busy, "fp", "left_semi").select("fp", "node", "row"))
    sets = checkpointed(_sets(df, entries, text_col, row_col))
    least = entries.groupBy("fp").agg(F.min("node").alias("least"))
    pairs = entries.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v"))
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in ("u", "v")]
    pairs = checkpointed(pairs.unionByName(first.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))))
    sure = checkpointed(_decided(_stars(pairs), sets))
    roots = components(sure).select(F.col("u").alias("node"), F.col("v").alias("root"))
    labelled = checkpointed(entries.join(roots, "node", "left").select("fp", "node", F.coalesce("root", "node").alias("label")))
    still = _open_fingerprints(labelled.select("fp", "label").distinct(), distance)
    marked = checkpointed(labelled.join(still, "fp", "left_semi").join(sets.drop("members", "fp"), "node"))
    groups = checkpointed(_open_groups(marked, distance))
    more = checkpointed(_decided(groups, sets, labelled.select("node", "label"), distance))
    roots = components(sure.unionByName(more)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    known = checkpointed(nodes.join(roots, "node", "left").select("text_hash", "n", F.coalesce("root", "node").alias("component")))
    return looked_up(rows, known, "text_hash", "n").select("id", "row", "component")
