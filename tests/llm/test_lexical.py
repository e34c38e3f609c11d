import math
import random
import re
from collections import Counter

from cellweave.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, length = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        found = []
        for (i, c), size in zip(counted, sizes):
            m = 100 - 90 + (90 * size * n) // length if length else 1
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def search(spark, docs, queries, k=10, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(x) for x in lexical.search(d, q, k=k, **options).collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 400}" for _ in range(5000)] + ["Été", "ÄB", "naïve", "x_y", "日本"]
    docs = [(i, r.choice([" ", ", ", "\n"]).join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    return docs, [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(15)]


def test_against_brute_force_in_blocks_of_any_size(spark):
    docs, queries = corpus(1, 300)
    docs += [(5000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1]), (900, None), (901, ""), (902, " .,"), docs[3], docs[3]]
    queries += [(100, None), (101, ""), (102, docs[7][1]), (3, "w1 W1 w2"), (None, "ÉTÉ été Été"), (103, "a b nowhere")]
    want = brute(docs, queries, 10)
    for block in (1, 2000, 1 << 20):
        assert search(spark, docs, queries, block_bytes=block) == want


def test_bounds_hold_and_most_blocks_are_left_out():
    import pyarrow as pa

    docs, queries = corpus(2, 400)
    rows = [lexical.block_of(pa.array([i for i, _ in docs[a : a + 20]], pa.int64()), pa.array([t for _, t in docs[a : a + 20]])) for a in range(0, 400, 20)]
    asked = lexical.Asked([t for _, t in queries])
    df = Counter(t for _, text in docs for t in set(terms(text)))
    asked.weigh(sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows), {i: df[w.decode()] for i, w in enumerate(asked.words.to_pylist())})
    for row in rows:
        body, bounds = lexical.Body(asked, row), asked.bounds(row)
        assert all(body.scores(q)[:, 0].max(initial=0) <= bounds[q] for q in range(asked.n))


def test_queries_in_blocks_long_text_and_no_rows(spark, monkeypatch):
    docs, queries = corpus(3, 60)
    docs.append((70, "w1 " * 300_000))
    monkeypatch.setattr(lexical, "QUERIES", 4)
    assert search(spark, docs, queries, k=3) == brute(docs, queries, 3)
    assert search(spark, [], queries) == [] and search(spark, docs, []) == [] and search(spark, [(1, None)], queries) == []


def test_other_columns_may_have_any_name(spark):
    d = spark.createDataFrame([(1, "a b", "x", 5), (2, "b c", "y", 6)], "doc_id long, text string, block string, score int")
    q = spark.createDataFrame([(1, "c", 3)], "item_id long, text string, rank int")
    assert [tuple(x)[:3] for x in lexical.search(d, q).collect()] == [(1, 1, 2)]
