import hashlib
import random
import re

from pyspark.sql import functions as F

from cellweave.llm.substring import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            m = least.get(tuple(w[k : k + window]))
            if m is not None and (i is None or m < i):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), " ".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, window, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_substrings(df, window=window, **sizes).select("document.doc_id", "n_words", "n_removed", "kept_text").collect()
    return sorted([tuple(r) for r in got], key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.randint(5, 15))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 6)):
            w += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 12))]
        rows.append((i * 7 % 113, r.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(None, rows[0][1]), (5, None), (6, ""), (9, " \n "), rows[3], rows[3], (200, "a\xa0b  c"), (None, None)]
    expected = brute(rows, 5)
    assert run(spark, rows, 5) == expected
    assert run(spark, rows, 5, chunk_bytes=500, shard_windows=100) == expected
    assert sum(x[2] for x in expected) > 100


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 5) == []
    rows = [(1, "x y " * 60000), (2, "x y " * 30)]
    assert run(spark, rows, 50) == brute(rows, 50)


def test_other_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", "k", 2), (2, None, None, 3)], "doc_id long, text string, chunk string, n_words int")
    got = dedup_substrings(df, window=2).select("document.*", F.col("n_removed").alias("gone")).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [(1, "a b", "k", 2, 0), (2, None, None, 3, 0)]


def test_query_hashes_the_kept_words(spark, tmp_path):
    from cellweave.llm.queries import queries

    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, text), (2, text + " tail")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries()["op3_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got[2].n_removed == 60 and got[2].kept_sha256 == hashlib.sha256(b"tail").hexdigest()
