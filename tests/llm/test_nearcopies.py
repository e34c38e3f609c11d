import random

import corpus_pipeline as p
from cellweave.llm.nearcopies import near_copies, parities, shingles
from cellweave.llm.simhash import fingerprint


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, distance):
    """The set of ids of each group, by comparing every pair."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, fps = [grams(t) for _, t in rows], [fingerprint(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            close = (fps[i] ^ fps[j]).bit_count() <= distance
            if sets[i] == sets[j] or close and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(map(sorted, groups.values()))


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 7)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w))
    chorus = " ".join(r.choice(words) for _ in range(20))
    rows += [" ".join([chorus] * 40 + [f"u{k}x{i}" for i in range(60)]) for k in range(30)]
    rows += [None, "", " \n", "a b", "A  B", "a c", rows[0].upper(), rows[3]]
    return list(enumerate(rows))


def test_groups_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, row long")
    groups = {}
    for x in near_copies(df, p.NEAR_BITS).collect():
        assert x.id == x.row
        groups.setdefault(x.component, []).append(x.id)
    assert sorted(map(sorted, groups.values())) == components(rows, p.NEAR_BITS)
    assert near_copies(df.limit(0), p.NEAR_BITS).count() == 0


def test_close_fingerprints_of_unlike_texts_all_stay(spark):
    chorus = " ".join(f"c{i}" for i in range(20))
    rows = [(k, " ".join([chorus] * 40 + [f"u{k}x{i}" for i in range(60)]), "en", "s", 1) for k in range(5)]
    fps = [fingerprint(t) for _, t, *_ in rows]
    assert max((a ^ b).bit_count() for a in fps for b in fps) <= 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in p.drop_near_copies(spark, docs, "").collect()) == list(range(5))


def test_bounds_let_every_similar_pair_pass():
    texts = [t for _, t in corpus()]
    sets = [shingles(t) for t in texts]
    for i in range(0, len(sets), 3):
        for j in range(i):
            apart = len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
            odd = sum(((int(a) ^ int(b)) % (1 << 64)).bit_count() for a, b in zip(parities(sets[i]), parities(sets[j])))
            assert abs(len(sets[i]) - len(sets[j])) <= apart and odd <= apart


def test_isolated_pairs_further_apart_than_seven_bits(spark):
    r = random.Random(5)
    words, rows, far = [f"w{i}" for i in range(3000)], [], 0
    while far < 12:
        w = [r.choice(words) for _ in range(200)]
        v = list(w)
        for at in range(20, 200, 50):
            v[at] = r.choice(words)
        a, b = " ".join(w), " ".join(v)
        if 8 <= (fingerprint(a) ^ fingerprint(b)).bit_count() <= 11:
            rows += [(2 * far, a), (2 * far + 1, b)]
            far += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in p.drop_near_copies(spark, docs, "").collect()) == [2 * k for k in range(12)]


def test_rows_that_share_an_id_are_judged_by_their_own_texts(spark):
    r = random.Random(9)
    a, b = (" ".join(r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(150)) for _ in range(2))
    rows = [(3, a, "en"), (5, a, "en"), (5, b, "en"), (5, b, "de"), (5, b, "de"), (7, b, "en"), (None, a, "en"), (None, a, "en")]
    seen = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got = p.drop_near_copies(spark, docs, "").collect()
        assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None) == sorted([(3, a), (5, b)])
        assert sum(x.doc_id is None for x in got) == 1
        seen.add(tuple(sorted(x.lang for x in got if x.doc_id == 5)))
    assert len(seen) == 1


def test_texts_of_one_template_send_rows_in_proportion(spark, monkeypatch):
    """Pairs just under the similarity: as many as the square of the texts, but what leaves the tasks is not."""
    from cellweave.llm import nearcopies as n

    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    base = [r.choice(words) for _ in range(600)]
    rows = []
    for i in range(240):
        w = list(base)
        for k in r.sample(range(600), 9):
            w[k] = r.choice(words)
        rows.append((i, " ".join(w), i))
    sent = []
    decided = n._decided

    def counted(met, *rest):
        out = decided(met, *rest)
        sent[-1] += met.count() + out.count()
        return out

    monkeypatch.setattr(n, "_decided", counted)
    for k in (120, 240):
        sent.append(0)
        got = {}
        for x in n.near_copies(spark.createDataFrame(rows[:k], "doc_id long, text string, row long"), p.NEAR_BITS).collect():
            got.setdefault(x.component, []).append(x.id)
        assert sorted(map(sorted, got.values())) == components([(i, t) for i, t, _ in rows[:k]], p.NEAR_BITS)
    assert sent[1] <= 3 * sent[0] and sent[1] < 240 * 239 // 8


def test_recall_at_the_similarity_over_all_pairs(spark):
    """Of pairs of long and short texts that share 0.8 or more, how many 11 bits propose."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows, near, found = [], 0, 0
    for size in [40, 60, 90, 150, 300, 600] * 25:
        a = [r.choice(words) for _ in range(size)]
        b = list(a)
        for _ in range(max(1, size // 55)):
            b[r.randrange(size)] = r.choice(words)
        rows += [" ".join(a), " ".join(b)]
    got = {x.id: x.component for x in near_copies(spark.createDataFrame([(i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, row long"), p.NEAR_BITS).collect()}
    for i in range(0, len(rows), 2):
        a, b = grams(rows[i]), grams(rows[i + 1])
        if 5 * len(a & b) >= 4 * len(a | b):
            near += 1
            found += got[i] == got[i + 1]
    assert near >= 80 and found >= 0.9 * near
