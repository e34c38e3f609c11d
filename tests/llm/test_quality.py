import random
import time
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from cellweave.llm import quality


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "and", "river", "stone", "walked", "over", "bridge", "evening", "light"]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        good = r.random() < 0.7
        if not good:
            kind = r.randrange(3)
            w = [x + r.choice(["$$$", "&&&"]) for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return docs, labels


def plain_tokens(text):
    return [zlib.crc32(t.encode()) % quality.BUCKETS for w in (text or "").split() for t in regex.findall(r"\p{L}+|\P{L}+", w)]


def test_context_vectors_against_plain_sums(spark):
    docs, _ = corpus(20)
    docs += [(None, None), (99, ""), (98, "one"), (97, "Éa,b!! \u2003 c")]
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for _, t in docs:
        b = plain_tokens(t)
        for i, x in enumerate(b):
            for y in b[max(0, i - quality.REACH) : i] + b[i + 1 : i + 1 + quality.REACH]:
                want[x, quality.INDEX_AT[y]] += quality.INDEX_SIGN[y]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, length, out=np.zeros_like(want), where=length > 0)
    got = quality.context_vectors(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert np.allclose(got, want, atol=1e-6)


def test_pooling_against_plain_means(monkeypatch):
    monkeypatch.setattr(quality, "POOLED", 7)
    vectors = np.random.default_rng(3).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    texts = [t for _, t in corpus(30)[0]] + [None, "", "one", "two, x", "long words " * 3000]
    for text, x in zip(texts, quality.pooled(pa.array(texts), vectors)):
        v = vectors[plain_tokens(text)].astype(np.float64)
        each = [v] + [v[:-r] * v[r:] for r in range(1, quality.REACH + 1)]
        want = np.concatenate([e.mean(axis=0) if len(e) else np.zeros(quality.DIMENSIONS) for e in each])
        assert np.allclose(x, want, atol=1e-4)


def test_a_text_is_pooled_alike_whatever_comes_with_it():
    vectors = np.random.default_rng(3).normal(size=(quality.BUCKETS, quality.DIMENSIONS)).astype(np.float32)
    texts = [t for _, t in corpus(3000)[0]]
    together = quality.pooled(pa.array(texts), vectors)
    assert all((quality.pooled(pa.array([t]), vectors)[0] == x).all() for t, x in zip(texts, together))


def test_tokens_of_all_characters_against_the_pattern():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[k : k + 61]) for k in range(0, len(points), 61)] + [None, "", " ", "a,b", "\u00e9t\u00e9\u2003x1y"]
    random.Random(6).shuffle(points)
    texts += ["".join(points[k : k + 67]) for k in range(0, len(points), 67)]
    flat, counts = quality.tokens(pa.array(texts).slice(3))
    want = [plain_tokens(t) for t in texts[3:]]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [b for w in want for b in w]


def test_words_are_cut_in_less_time_than_one_at_a_time():
    """CPU time of the tokens of 200,000 unlike words against that of the pattern on each of them."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) + r.choice(["", ",", ".", "!?"]) for _ in range(200_000)]
    texts, pattern = pa.array([" ".join(words)]), regex.compile(r"\p{L}+|\P{L}+")

    def seconds(run):
        taken = []
        for _ in range(3):
            began = time.process_time()
            run()
            taken.append(time.process_time() - began)
        return min(taken)

    assert seconds(lambda: quality.tokens(texts)) < 0.8 * seconds(lambda: [zlib.crc32(t.encode()) for w in words for t in pattern.findall(w)])


def test_network_and_temperature():
    """The fitted gradient vanishes as a plain one does, and no other candidate temperature has less loss."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=400) > 0).astype(int)
    net = quality.fit_network(x, y)
    aside = np.arange(400) % 5 == 4
    assert ((net.score(x[~aside]) >= 0.5) == y[~aside]).mean() > 0.85
    loss = lambda t: -np.mean(np.log(np.where(y[aside] > 0, 1 / (1 + np.exp(-net.logits(x[aside]) / t)), 1 / (1 + np.exp(net.logits(x[aside]) / t)))))
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.geomspace(0.25, 8, 60))
    a, b, c, d = net.weights
    for row, p in zip(x[:5], net.score(x[:5])):
        hidden = [np.tanh(sum((row[i] - net.centre[i]) / net.spread[i] * a[i, j] for i in range(5)) + b[j]) for j in range(quality.HIDDEN)]
        assert np.isclose(p, 1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, c)) + d) / net.temperature)))
    assert quality.fit_network(x, np.ones(400, int)) is None
    assert quality.fit_network(x[:4], np.array([0, 1, 0, 1])).temperature == 1


def test_repeated_ids_absent_documents_and_ties(spark):
    docs, labels = corpus(300)
    docs += [(4, "another text"), (4, "another text"), docs[7], (5, "word " * 50_000)]
    absent = [(10_000 + i, i % 2, 0) for i in range(200)]
    df, ly = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels + absent, "doc_id long, quality int, toxic int")
    vectors, network = quality.fit(df, ly, sample=60)
    again = quality.fit(df.repartition(5), ly.repartition(3), sample=60)[1]
    assert network is not None and np.allclose(network.weights[0], again.weights[0])
    rows = quality.score(df.withColumn("score", F.lit("x")), vectors, network).select("document.*", F.col("score").alias("own"), "predicted").collect()
    assert len(rows) == 304 and {x.score for x in rows} == {"x"} and len({x.own for x in rows if x.text == "another text"}) == 1
    none = quality.score(df, vectors, None).collect()
    assert {(x.score, x.predicted) for x in none} == {(0.5, 1)}


def test_learns_from_its_labels_alone(spark):
    docs, labels = corpus(500)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    labels = [(i, 1 - y if i in held else y, t) for i, y, t in labels] + [(None, 1, 0), (3, None, 0)]
    truth = dict((i, y) for i, y, _ in corpus(500)[1])
    df = spark.createDataFrame([*docs, (None, None), (900, "")], "doc_id long, text string")
    ly = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.score(df, *quality.fit(df, ly)).select("document.*", "score", "predicted").collect()
    assert len(rows) == 502 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in rows)
    right = [x.predicted == truth[x.doc_id] for x in rows if x.doc_id in held]
    assert np.mean(right) > 0.9


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in quality.score(df, *quality.fit(df, none)).collect()] == [quality.PRIOR]
    empty = df.limit(0)
    assert quality.score(empty, *quality.fit(empty, none)).count() == 0


def test_labels_of_any_type(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "$$$ junk $$$") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(90, 2), (91, None)], "doc_id long, quality int")
    scores = []
    for kind in ("int", "double", "string", "decimal(4,1)"):
        scores.append({r.document.doc_id: r.score for r in quality.score(docs, *quality.fit(docs, labels.withColumn("quality", F.col("quality").cast(kind)))).collect()})
    binary = labels.where("quality in (0, 1)").withColumn("quality", F.col("quality") == 1)
    scores.append({r.document.doc_id: r.score for r in quality.score(docs, *quality.fit(docs, binary)).collect()})
    assert all(s == scores[0] for s in scores) and len({round(v, 3) for v in scores[0].values()}) > 1
    words = spark.createDataFrame([(1, "good"), (2, None)], "doc_id long, quality string")
    assert quality.fit(docs, words)[1] is None
