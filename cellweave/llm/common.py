"""What several corpus operators share: word hashing, blobs, sizing and checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import checkpointed, shared_dir

#: Largest number of memo entries an executor's Python worker keeps before it starts afresh.
MEMO_ENTRIES = 250_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the tables of the folder, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a written table in the shared folder, its lineage cut and its columns read as they are asked for; and where it is."""
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def dropped(spark: SparkSession, folder: str) -> None:
    """A table that ``stored`` has written goes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key that more than one row in so many has is looked up on its own.
HEAVY = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``key`` is unique and whose ``count`` says how many rows have it.

    Of keys that more than a thousandth of the rows have there are a thousand at most; these are broadcast. The others meet
    in a shuffle, in which none of them is heavy. ``count`` does not stay.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(table.where(F.col(count) * HEAVY > total).drop(count))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(count) * HEAVY <= total).drop(count), key)
    return rows.join(heavy, key).unionByName(rest)


#: Bytes of a batch on its way to Python.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after its session has been told to send Python no more than a few megabytes of rows at once."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        conf.set(_BATCH, BATCH_BYTES)
    return df


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a whole text column; only sizes partitions, never results."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def power_of_two(n: float) -> int:
    """The exponent of the smallest power of two that is at least ``n``."""
    return max(0, int(np.ceil(np.log2(max(1.0, n)))))


def split_words(texts: pa.Array, unicode: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in turn, and how many each text has; a null text has none.

    Words are runs of anything but ASCII white space (space and 9 to 13), or with ``unicode`` but white space of any kind.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    parts = (pc.utf8_split_whitespace if unicode else pc.ascii_split_whitespace)(texts)
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    at = parts.offsets.to_numpy().astype(np.int64)
    return words.filter(real), np.diff(ends[at - at[0]])


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; each distinct word is hashed once."""
    each = words.cast(pa.binary()).dictionary_encode()
    distinct = each.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[each.indices.to_numpy()]


_KEPT: dict[object, object] = {}


def sole(name: object, make: Callable[[], object]) -> object:
    """What this process remembers for one operator; what it remembered for another goes first."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def pack(values: np.ndarray) -> bytes:
    """An integer array as byte planes under zstd; ``unpack`` is its inverse."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.dtype.itemsize).T.tobytes() if len(raw) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values, as packed differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def slices(batches: Iterable[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few megabytes, so that what is made of a part stays small too."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, most * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


__all__ = ["bounded", "checkpointed", "dropped", "looked_up", "pack", "pack_sorted", "power_of_two", "read", "shared_dir", "slices", "sole", "split_words", "stored", "text_bytes", "unpack", "unpack_sorted", "word_hashes"]
