"""A quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

* The tokens of a text are its runs of letters, as they are written, and its runs of other signs. Whole tokens are hashed
  into a fixed number of buckets. Each bucket has a fixed sparse vector of +1 and -1 (its index vector); a bucket's context
  vector sums the index vectors of its neighbours over the whole corpus. Tasks add these sums up for their part of the corpus;
  the parts meet by block of buckets, in two steps.
* A document is pooled from its tokens' context vectors alone: per dimension their mean, and the mean product of those of
  tokens one and two apart, which tells running text from the same few words over and over.
* A network with one hidden layer is fitted with numpy on a bounded sample of labelled documents. A temperature, fitted on
  documents of the sample that the network has not seen, calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import bounded, pack, slices, sole, split_words, unpack

BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 4
REACH = 2
BLOCK = 256
#: Labelled documents that the network is fitted on, at most: those whose ids hash lowest.
SAMPLE = 8000
INPUTS = (REACH + 1) * DIMENSIONS
HIDDEN = 32
#: Where there is nothing to learn from, every document has this score.
PRIOR = 0.5

_rng = np.random.default_rng(20240)
INDEX_AT = np.argsort(_rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
INDEX_SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))
#: First step of the merge: groups of parts for each block. Tokens of a text that are pooled at once.
MERGES = 16
POOLED = 1 << 11


@lru_cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    points = np.r_[0:0xD800, 0xE000:0x110000]
    found = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", points.astype("<u4").tobytes().decode("utf-32-le")):
        found[points[m.start() : m.end()]] = True
    return found


def _flat(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of words, of which none is null, in turn, and where each of them begins, with the end last."""
    if not len(words):
        return b"", np.zeros(1, np.int32)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    return data.slice(at[0], at[-1] - at[0]).to_pybytes(), at - at[0]


def _cut(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of distinct words in turn, as bytes, and how many each word has; all words are cut at once."""
    raw, starts = _flat(words)
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(data & 0xC0 != 0x80)
    letter = _letters()[np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")]
    begins = np.zeros(len(data), bool)
    begins[at[1:]] = letter[1:] != letter[:-1]
    begins[starts[:-1]] = True
    begins = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.r_[begins, len(data)].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, offsets, pa.py_buffer(raw)]), np.diff(np.searchsorted(begins, starts))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all tokens in turn, how many each text has); a null text has none."""
    sole("tokens", dict)
    words, n_words = split_words(texts, unicode=True)
    each = words.dictionary_encode()
    found, sizes = _cut(each.dictionary)
    known = found.dictionary_encode()
    raw, at = _flat(known.dictionary)
    at = at.tolist()
    buckets = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])), np.int64, len(at) - 1)[known.indices.to_numpy()] % BUCKETS
    starts, codes = np.cumsum(sizes) - sizes, each.indices.to_numpy()
    size = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = buckets[np.repeat(starts[codes] - ends[:-1], size) + np.arange(ends[-1])]
    at = np.concatenate([[0], np.cumsum(n_words)])
    return flat, np.diff(ends[at])


def context_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vectors (buckets, dimensions) over all whole texts, each scaled to length one, or zero if unseen.

    What reaches the driver has a fixed size, whatever the corpus; no task holds more than one part and its sum at once.
    """
    size = BLOCK * DIMENSIONS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in slices(batches):
            flat, counts = tokens(batch.column(0))
            text = np.repeat(np.arange(len(counts)), counts)
            both = [text[:-reach] == text[reach:] for reach in range(1, REACH + 1)]
            left = np.concatenate([flat[:-reach][b] for reach, b in enumerate(both, 1)])
            right = np.concatenate([flat[reach:][b] for reach, b in enumerate(both, 1)])
            word, other = np.concatenate([left, right]) * DIMENSIONS, np.concatenate([right, left])
            for j in range(NONZERO):
                total += np.bincount(word + INDEX_AT[other, j], INDEX_SIGN[other, j], BUCKETS * DIMENSIONS)
        parts = total.astype(np.int64).reshape(-1, size)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            own = np.full(len(used), TaskContext.get().partitionId() % MERGES)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own), pa.array([pack(parts[k]) for k in used], pa.binary())], ["block", "part", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column("sums"):
                total += unpack(x.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([0], pa.int64()), "sums": pa.array([pack(total)], pa.binary())})

    shape = "block long, part long, sums binary"
    sums = bounded(df).select(F.col(text_col).alias("text")).mapInArrow(gather, shape)
    sums = sums.groupBy("block", "part").applyInArrow(add, shape).groupBy("block").applyInArrow(add, shape)
    vectors = np.zeros((BUCKETS, DIMENSIONS))
    for row in sums.collect():
        vectors[row.block * BLOCK : (row.block + 1) * BLOCK] = unpack(row.sums, np.int64).reshape(BLOCK, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(documents, INPUTS): per dimension the mean of the tokens' context vectors, and the mean products of tokens one and two apart.

    Zeros where there are no such tokens. A text's row is the same to the last bit whatever texts come with it.
    """
    flat, counts = tokens(texts)
    sums = np.zeros((REACH + 1, len(counts), DIMENSIONS))
    ends = np.cumsum(counts)
    for own, begin, end in zip(range(len(counts)), (ends - counts).tolist(), ends.tolist()):
        for k in range(begin, end, POOLED):
            part = vectors.take(flat[k : min(k + POOLED + REACH, end)], axis=0, mode="clip")
            n = min(POOLED, end - k)
            sums[0, own] += np.einsum("ij->j", part[:n])
            for reach in range(1, REACH + 1):
                m = min(n, len(part) - reach)
                if m > 0:
                    sums[reach, own] += np.einsum("ij,ij->j", part[:m], part[reach : m + reach])
    means = [x / np.maximum(counts - reach, 1)[:, None] for reach, x in enumerate(sums)]
    return np.hstack(means).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs; ``score`` gives calibrated probabilities of a good document."""

    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(((x - self.centre) / self.spread) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, from a fixed range of candidates."""
    candidates = np.geomspace(0.25, 8, 60)
    losses = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in candidates]
    return float(candidates[int(np.argmin(losses))])


def fit_network(x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 256, decay: float = 1e-3) -> Network | None:
    """A network for labels 0 and 1. Every fifth row only calibrates; None where the others have not both labels.

    Without a fifth row the temperature stays 1.
    """
    x = x.astype(np.float64)
    aside = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~aside])) < 2:
        return None
    seen, rng = np.flatnonzero(~aside), np.random.default_rng(7)
    spread = x[seen].std(axis=0)
    net = Network(x[seen].mean(axis=0), np.where(spread > 1e-6, spread, 1.0), [rng.normal(0, 0.15, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.15, HIDDEN), np.zeros(())], 1.0)
    z = (x - net.centre) / net.spread
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        rows = rng.choice(seen, min(batch, len(seen)), replace=False)
        a, b, c, d = net.weights
        hidden = np.tanh(z[rows] @ a + b)
        error = (1 / (1 + np.exp(-np.clip(hidden @ c + d, -30, 30))) - y[rows]) / len(rows)
        back = np.outer(error, c) * (1 - hidden**2)
        grads = [z[rows].T @ back + decay * a, back.sum(axis=0), hidden.T @ error + decay * c, error.sum()]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - 0.005 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if aside.any():
        net.temperature = _calibrated(net.logits(x[aside]), y[aside])
    return net


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's label is never learnt from: crc32 of the id as text is 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, Network | None]:
    """(context vectors, network). Vectors are gathered from all documents; the network is fitted on at most ``sample``.

    Labels may be numbers, booleans or text. Those other than 0 and 1, of null ids, of held-out rows or of documents that are not there are not learnt from; of
    repeated labels of an id the lower counts, of its unlike texts the one whose pooled vector has the lowest bytes. Where the
    labels learnt from are not of both kinds there is no network.
    """
    vectors = context_vectors(docs, text_col)
    value = F.col(label_col).cast("string").try_cast("double") if dict(labels.dtypes)[label_col] != "boolean" else F.col(label_col).cast("double")
    usable = labels.select(F.col(id_col).cast("long").alias("id"), value.alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("id").isNotNull()).withColumn("y", F.col("y").cast("int"))
    usable = usable.where(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = usable.join(text.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    spark = docs.sparkSession
    known = spark.createDataFrame(chosen.collect(), "id long, y int")
    sampled = text.join(F.broadcast(known), "id").select("id", "y", "text")
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pooled(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    rows = sampled.mapInArrow(pool, "id long, y int, x binary").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), INPUTS)
    return vectors, fit_network(x, np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, vectors: np.ndarray, network: Network | None, text_col: str = "text") -> DataFrame:
    """``(document, score, predicted)``: each input row as a struct, so names cannot clash, with its score.

    Whole texts are scored; null and empty ones too, as documents without words. ``predicted`` is 1 where the score is 0.5 or
    more. Rows with equal or null ids each get their score. Without a network every score is 0.5. An empty table gives none.
    """
    rows = bounded(docs).select(F.struct("*").alias("document"), F.col(text_col).alias("text"))
    shape = T.StructType([T.StructField("document", rows.schema["document"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = shared.value
        for batch in slices(batches):
            x = pooled(batch.column(1), known)
            p = net.score(x.astype(np.float64)) if net else np.full(len(x), PRIOR)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["document", "score", "predicted"])

    return rows.mapInArrow(run, shape)
