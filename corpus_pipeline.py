"""From documents to packed sequences: quality, near copies, repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the last
return the columns of ``documents``; each is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import nearcopies, packing, quality, substring
from cellweave.llm.common import read, shared_dir

#: Bits in which the fingerprints of proposed near copies differ at most. With three words to a shingle, pairs that share
#: 0.8 of their five-word shingles differ in 7 bits in the median; at 7 bits about half of those near 0.8 would be missed.
NEAR_BITS = 11


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels of those at hand.

    Null and empty texts are scored as texts without tokens; a score of 0.5, as all have where nothing can be learnt, is
    accepted. Rows that share an id each stand for themselves. An empty table gives none.
    """
    fitted = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, *fitted).where("predicted = 1").select("document.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of those with the smallest id, that whose text and columns hash lowest.

    Fingerprints propose pairs, which count if they share 0.8 of their five-word shingles. Every row is judged by its own
    text, so rows that share an id but not a text can all stay; rows are told apart by 128-bit hashes of all their columns, whatever
    these are called. Rows without an id stay, one for each text. An empty table gives none.
    """
    name = "__row"
    while name in docs.columns:
        name += "_"
    own = [F.xxhash64(F.lit(seed), "doc_id", "text", *(F.col(f"`{c}`") for c in docs.columns)) for seed in (1, 2)]
    marked = docs.withColumn(name, F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in own))))
    copies = nearcopies.near_copies(marked, NEAR_BITS, row_col=name)
    kept = copies.where("id is not null").groupBy("component").agg(F.min(F.struct("id", "row")).alias("first"))
    found = marked.join(kept.select(F.col("first.row").alias(name)), name, "left_semi").dropDuplicates([name]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return found.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has; others stay as they are.

    A text that loses words is what is left of them, joined by spaces; ``n_chars`` follows. Documents of which
    nothing is left go.
    """
    changed = substring.dedup_substrings(docs).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("document.text"))
    rows = changed.select("document", "n_removed", text.alias("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("document.n_chars"))
    own = {"text": F.col("text"), "n_chars": n_chars}
    return rows.select(*(own.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 tokens.

    Null and empty texts are packed as the end token alone; rows with equal or null ids each for itself. An empty table gives none.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_poor),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]
#: No stage but the last could be put in SQL for its exact rows; brute-force versions in the tests stand in for it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
