import math
import random

from pyspark.sql import functions as F

from cellweave.llm.topk import exact_top_k


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[(i, tuple(math.floor(1024 * x) for x in v))] = None
    out = []
    for i, q in usable:
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def search(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(x) for x in exact_top_k(df, F.col("vec_id") % 10 == 0, k=k).collect())


def test_against_brute_force(spark):
    r = random.Random(6)
    values = [x / 8 for x in range(-8, 9)]
    rows = [(i, [r.choice(values) for _ in range(6)]) for i in range(1500)]
    rows += [(3000 + i, [r.choice([0.0, 0.125])] * 6) for i in range(300)]
    rows += [(5000, None), (5010, [None] + [0.5] * 5), (5020, [math.nan] * 6), (5030, [math.inf] * 6), (None, [1.0] * 6), (5040, [0.0] * 6), rows[3], rows[0], (5050, [0.5, 0.25]), (5051, [1.0, 1.0])]
    assert search(spark, rows, 10) == brute(rows, 10)


def test_few_candidates_large_values_and_no_rows(spark):
    rows = [(0, [1.0, -2.0]), (1, [0.5, 0.5]), (2, [3e5, -3e6])]
    assert search(spark, rows, 10) == brute(rows, 10)
    assert search(spark, [], 10) == []


def test_one_id_with_two_vectors(spark):
    got = search(spark, [(0, [1.0]), (0, [2.0]), (1, [3.0]), (2, [4.0])], 3)
    k = 1024 * 1024
    assert got == [(0, 1, 2, 8 * k), (0, 2, 1, 6 * k), (0, 3, 2, 4 * k)]
