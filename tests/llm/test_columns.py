"""Other columns, whatever they are called, are no business of an operator's."""

import pytest
from pyspark.sql import functions as F

from cellweave.llm import bpe, licences, media, packing, quality, simhash, substring, topk, wordpiece

NAMES = ("id", "text_", "fp", "ids", "chunk", "document", "length", "piece", "score", "anchor", "digest", "media", "y", "n_words", "component_id", "__id", "__text")
OPERATORS = {
    "matrices": packing.pack_matrices, "counts": wordpiece.count_tokens, "substrings": substring.dedup_substrings, "near": simhash.near_duplicates, "licences": licences.scan,
    "codec": lambda d: bpe.decode(bpe.encode(d)), "pack": packing.pack, "payloads": lambda d: media.payload_features(media.store_payloads(d)),
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (None, ""), (1, "one two")], "doc_id long, text string")
    return df.coalesce(1).withColumns({n: F.lit("x") for n in NAMES})


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns(docs, name):
    n = OPERATORS[name](docs).count()
    assert n == (1 if name == "matrices" else 4)


def test_extra_columns_of_classifier_and_search(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int").withColumns({n: F.lit(1) for n in ("id", "text", "x")})
    scored = quality.score(docs, *quality.fit(docs, labels))
    assert scored.select("document.*").columns == docs.columns and scored.count() == 4
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in ("id", "v", "q", "d", "shard", "rank")})
    assert [tuple(r) for r in topk.exact_top_k(vectors, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]
