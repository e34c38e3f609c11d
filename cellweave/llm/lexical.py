"""Ranked lexical search over blocks of documents, with block-max pruning.

The index has one row for each block, a run of documents as they are stored. Its head holds the block's terms, how many of its
documents have each, and the term's maxima there: the most occurrences in a document and the shortest such document. Its body is
the forward index: each document's terms with their occurrences.

A query bounds every block by what its terms could score at their maxima. The best block of each query, of all the index, is
scored first; its k-th score is the query's threshold everywhere. Each task then sorts its blocks by a query's bound and scores
their bodies until the bound drops below the threshold, which rises with what the task itself finds. Bodies of blocks that no
query wants are never unpacked. Queries are a stated set, held against all blocks a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import bounded, checkpointed, dropped, pack, slices, stored, unpack

#: Bytes of a block's texts, about; blocks that a task sorts together; queries, and bytes of them, that are held against all blocks at once.
BLOCK_BYTES = 1 << 20
TOGETHER = 32
QUERIES, QUERY_BYTES = 1024, 4 << 20

#: A byte of a term as it counts, 0 for any other: digits, letters, of which A to Z in lower case, and all beyond ASCII.
_LOW = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)

HEAD = "block long, n_docs long, n_terms long, words binary, word_lengths binary, df binary, most binary, least binary"
BODY = "ids binary, no_ids binary, sizes binary, counts binary, terms binary, tfs binary"
_NAMES = [x.split()[0] for x in f"{HEAD}, {BODY}".split(", ")]


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in turn, and how many each text has; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    if not n:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    low = _LOW[data]
    word = low > 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    start[first] = word[first]
    kept = low[word]
    at = np.append((np.cumsum(word) - 1)[start], len(kept)).astype(np.int32)
    begun = np.concatenate([[0], np.cumsum(start)])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())]), np.diff(begun[ends])


def block_of(ids: pa.Array, texts: pa.Array) -> dict[str, object]:
    """A block's head and body, without its number."""
    terms, sizes = terms_of(texts)
    each = terms.dictionary_encode()
    words, n_words = each.dictionary, max(1, len(each.dictionary))
    pairs, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n_words + each.indices.to_numpy(), return_counts=True)
    doc, term = pairs // n_words, (pairs % n_words).astype(np.int32)
    by_term = np.argsort(term, kind="stable")
    starts = np.flatnonzero(np.diff(term[by_term], prepend=-1))
    reduced = lambda f, x: pack(f.reduceat(x[by_term], starts) if len(starts) else x[:0])
    joined = b"".join(words.to_pylist())
    return {
        "n_docs": int((sizes > 0).sum()), "n_terms": int(sizes.sum()), "words": zstandard.ZstdCompressor(level=1).compress(joined), "word_lengths": pack(pc.binary_length(words).to_numpy().astype(np.int32)),
        "df": reduced(np.add, np.ones(len(term), np.int64)), "most": reduced(np.maximum, tf.astype(np.int64)), "least": reduced(np.minimum, sizes[doc].astype(np.int64)),
        "ids": pack(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)), "no_ids": pack(pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8)), "sizes": pack(sizes.astype(np.int64)),
        "counts": pack(np.bincount(doc, minlength=len(sizes)).astype(np.int64)), "terms": pack(term), "tfs": pack(tf.astype(np.int64)),
    }


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of all documents. Nothing is shuffled; a block's number tells the task and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in slices(batches, block_bytes):
            if part.num_rows:
                made = {"block": number} | block_of(part.column(0), part.column(1))
                number += 1
                yield pa.RecordBatch.from_pydict({c: pa.array([made[c]], pa.binary() if isinstance(made[c], bytes) else pa.int64()) for c in _NAMES})

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{HEAD}, {BODY}")


class Asked:
    """A bounded block of queries: their distinct terms, and what each term weighs once the corpus is counted."""

    def __init__(self, texts: list[str | None]):
        terms, sizes = terms_of(pa.array(texts, pa.string()))
        each = terms.dictionary_encode()
        self.words = each.dictionary
        codes = each.indices.to_numpy().astype(np.int64)
        width = max(1, len(self.words))
        pairs = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + codes)
        self.n = len(texts)
        self.query, self.term = pairs // width, pairs % width
        self.at = np.searchsorted(self.query, np.arange(len(texts) + 1))

    def weigh(self, n: int, length: int, df: dict[int, int]) -> None:
        self.n_docs, self.length = n, length
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.words))], np.int64)

    def places(self, row: dict[str, object]) -> np.ndarray:
        """Of each of the block's terms the number among the queries' terms, -1 where no query has it."""
        lengths = unpack(row["word_lengths"], np.int32)
        at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        joined = zstandard.ZstdDecompressor().decompress(row["words"]) if len(lengths) else b""
        words = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(joined)])
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def impact(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 10 + 90 * size * self.n_docs // self.length
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)

    def bounds(self, row: dict[str, object]) -> np.ndarray:
        """What a document of the block scores at most, for each query."""
        places = self.places(row)
        have = places >= 0
        value = np.zeros(len(self.words) + 1, np.int64)
        value[places[have]] = self.impact(unpack(row["most"], np.int64)[have], unpack(row["least"], np.int64)[have]) * self.weights[places[have]]
        sums = np.concatenate([[0], np.cumsum(value[self.term])])
        return sums[self.at[1:]] - sums[self.at[:-1]]


class Body:
    """A block's forward index as far as queries ask for it, and their scores."""

    def __init__(self, asked: Asked, row: dict[str, object]):
        self.asked = asked
        places, terms = asked.places(row), unpack(row["terms"], np.int32)
        sizes, counts = unpack(row["sizes"], np.int64), unpack(row["counts"], np.int64)
        mine = np.flatnonzero(places[terms] >= 0)
        doc, term = np.repeat(np.arange(len(sizes)), counts)[mine], places[terms[mine]]
        value = asked.impact(unpack(row["tfs"], np.int64)[mine], sizes[doc]) * asked.weights[term]
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order]
        self.at = np.searchsorted(term[order], np.arange(len(asked.words) + 1))
        self.ids, self.no_ids = unpack(row["ids"], np.int64), unpack(row["no_ids"], np.uint8)

    def scores(self, query: int) -> np.ndarray:
        """Rows (score, no id, id) of the documents with a score above 0."""
        total = np.zeros(len(self.ids), np.int64)
        for t in self.asked.term[self.asked.at[query] : self.asked.at[query + 1]]:
            own = slice(self.at[t], self.at[t + 1])
            total[self.doc[own]] += self.value[own]
        found = np.flatnonzero(total)
        return np.stack([total[found], self.no_ids[found].astype(np.int64), self.ids[found]], axis=1)


def best_of(rows: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best rows: highest scores, ties by id, none last."""
    return rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[:k]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, object]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _frequencies(blocks: DataFrame, asked: Asked) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked.words), np.int64)
        for row in _rows(batches):
            places = asked.places(row)
            have = places >= 0
            total[places[have]] += unpack(row["df"], np.int64)[have]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["term", "df"])

    counted = blocks.select("words", "word_lengths", "df").mapInArrow(run, "term long, df long")
    return {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def _thresholds(blocks: DataFrame, asked: Asked, k: int) -> np.ndarray:
    """Of each query the k-th score in its best block of all, 0 if that has fewer."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, where = np.zeros(asked.n, np.int64), np.zeros(asked.n, np.int64)
        for row in _rows(batches):
            now = asked.bounds(row)
            more = now > most
            most[more], where[more] = now[more], row["block"]
        own = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(x[own], pa.int64()) for x in (np.arange(asked.n), most, where)], ["query", "bound", "block"])

    heads = blocks.select(*[x.split()[0] for x in HEAD.split(", ")])
    first = heads.mapInArrow(bound, "query long, bound long, block long").groupBy("query").agg(F.max(F.struct("bound", "block")).alias("first")).collect()
    wanted: dict[int, list[int]] = {}
    for r in first:
        wanted.setdefault(r["first"]["block"], []).append(r["query"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            body = Body(asked, row)
            at = wanted[row["block"]]
            kth = [int(x[-1, 0]) if len(x) == k else 0 for x in (best_of(body.scores(q), k) for q in at)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(kth, pa.int64())], ["query", "kth"])

    threshold = np.zeros(asked.n, np.int64)
    if wanted:
        for r in blocks.where(F.col("block").isin(list(wanted))).mapInArrow(score, "query long, kth long").collect():
            threshold[r["query"]] = r["kth"]
    return threshold


def _search(blocks: DataFrame, asked: Asked, threshold: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty((0, 3), np.int64) for _ in range(asked.n)]
        limit = threshold.copy()
        held: list[dict[str, object]] = []

        def scored() -> None:
            bounds = np.array([asked.bounds(row) for row in held])
            bodies: dict[int, Body] = {}
            for q in np.flatnonzero((bounds >= np.maximum(limit, 1)).any(axis=0)):
                for b in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[b, q] < max(limit[q], 1):
                        break
                    if b not in bodies:
                        bodies[b] = Body(asked, held[b])
                    rows = bodies[b].scores(q)
                    best[q] = best_of(np.concatenate([best[q], rows[rows[:, 0] >= limit[q]]]), k)
                    if len(best[q]) == k:
                        limit[q] = max(limit[q], best[q][-1, 0])

        for row in _rows(batches):
            held.append(row)
            if len(held) == TOGETHER:
                scored()
                held = []
        if held:
            scored()
        rows = np.concatenate([np.empty((0, 3), np.int64), *best])
        query = np.repeat(np.arange(asked.n), [len(x) for x in best])
        ids = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ids, pa.array(rows[:, 0], pa.int64())], ["query", "doc_id", "score"])

    found = blocks.mapInArrow(run, "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _asked(queries: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The queries, a bounded number at a time."""
    held, size = [], 0
    for item, text in queries.toLocalIterator():
        own = len((text or "").encode())
        if held and (len(held) == QUERIES or size + own > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append((item, text))
        size += own
    if held:
        yield held


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents that score highest for each query, of all, scores above 0 only.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A to Z in lower case, in whole texts; null and empty texts
    have none. Scores are integers: each of a query's distinct terms adds weight(df) * (10^9 tf div (1000 tf + 8 m)), where m grows
    with the document's length. Ties go to the smaller id, rows without an id last. Every row of ``queries`` is a query and every row of
    ``docs`` a document, so ids that repeat come as often as they do. Queries without terms, and all if there are no documents, get none.
    """
    spark = docs.sparkSession
    kind = queries.schema[query_id_col].dataType.simpleString()
    blocks, folder = stored(index(docs, id_col, text_col, block_bytes))
    n, length = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if n:
        for part in _asked(queries.select(query_id_col, query_text_col)):
            asked = Asked([text for _, text in part])
            asked.weigh(n, length, _frequencies(blocks, asked))
            rows = _search(blocks, asked, _thresholds(blocks, asked, k), k)
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(part)], f"query long, item_id {kind}")
            found = found.unionByName(rows.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    found = checkpointed(found)
    dropped(spark, folder)
    return found


ORACLE = r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS row_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms
      FROM documents
    ), c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
    q AS (
      SELECT DISTINCT item_id, item, unnest(terms) AS term
      FROM (SELECT item_id, row_number() OVER () AS item, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM benchmark)
    ), t AS (
      SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
      FROM (SELECT row_id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row_id, term
    ), w AS (
      SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term
    ), s AS (
      SELECT item, any_value(item_id) AS item_id, row_id, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN q USING (term), c GROUP BY item, row_id
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
