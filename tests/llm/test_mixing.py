import hashlib
import random
import re
from collections import Counter

from cellweave.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def levels(sizes, weights, share, times):
    """Targets by sharing again and again, one source at a time stopped."""
    order = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    budget, stopped = sum(sizes.values()) * share[0] / share[1], set()
    while True:
        rest = [k for k in order if k not in stopped]
        level = (budget - sum(times * sizes[k] for k in stopped)) / sum(weight[k] for k in rest) if rest else 0
        above = [k for k in rest if level * weight[k] > times * sizes[k]]
        if not above:
            return {k: float(times * sizes[k]) if k in stopped else level * weight[k] for k in order}
        stopped |= set(above)


def brute(rows, weights=(3, 1, 2), share=(3, 2), times=2):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in rows]
    sizes = Counter()
    for _, s, n in sized:
        sizes[s] += n
    target = levels(sizes, weights, share, times) if sizes else {}
    turn = lambda i: hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:16]
    stream, served = [], Counter()
    for at, (i, s, n) in sorted(enumerate(sized), key=lambda x: (turn(x[1][0]), x[1][0] is not None, x[1][0] or 0, x[1][2])):
        for k in range(times):
            if n and k * sizes[s] <= target[s]:
                stream.append(((k * sizes[s] + served[s] + n) / target[s], s is None, s or "", k, served[s], n, at))
        served[s] += n
    taken, left = Counter(), sum(sizes.values()) * share[0] // share[1]
    for *_, n, at in sorted(stream):
        taken[at] += min(n, left)
        left -= min(n, left)
    return sorted(((i, s, n, sizes[s], target[s], taken[at]) for at, (i, s, n) in enumerate(sized)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def found(spark, rows, **options):
    return sorted((tuple(x) for x in mixing.mix(frame(spark, rows), **options).collect()), key=repr)


def documents(seed, n):
    r = random.Random(seed)
    sources = ["a"] * 9 + ["b", "c", "d", "é", "z", "", None, "Z"]
    return [(i, " \t".join("w" for _ in range(r.choice([1, 3, 20, 200]))), r.choice(sources)) for i in range(n)]


def test_against_brute_force(spark):
    rows = documents(1, 400) + [(500, None, "a"), (501, "", None), (502, "  x", "only"), (None, "a b", "a"), (None, "c d", "a"), (7, "again", "b"), (7, "again", "b"), (600, None, "empty")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, weights=(1, 5), share=(5, 2), times=4) == brute(rows, (1, 5), (5, 2), 4)


def test_sources_come_near_their_targets_and_the_budget_is_spent(spark):
    rows = documents(2, 2000)
    mixed = found(spark, rows)
    by = Counter()
    for _, s, _, _, _, taken in mixed:
        by[s] += taken
    assert all(abs(by[s] - target) <= 2 * 200 for _, s, _, _, target, _ in mixed)
    assert sum(by.values()) == sum(n for _, _, n, _, _, _ in mixed) * 3 // 2
    assert all(taken <= 2 * n for _, _, n, _, _, taken in mixed)


def test_the_mix_in_order(spark):
    rows = documents(3, 300)
    stream = [tuple(x) for x in mixing.mixture(frame(spark, rows)).collect()]
    assert [x[3] for x in stream] == sorted(x[3] for x in stream)
    taken = Counter()
    for i, _, _, _, ahead, words in stream:
        assert ahead == sum(taken.values())
        taken[i] += words
    assert taken == Counter({i: t for i, _, _, _, _, t in found(spark, rows) if t})


def test_running_sums_over_many_ranges_and_a_hot_group(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.7 else f"g{r.randrange(40)}", r.randrange(50), r.randrange(10)) for _ in range(3000)]
    got = mixing.running(spark.createDataFrame(rows, "g string, v long, o int"), "g", "v", ["o", "v"], 16).collect()
    want, sums = [], Counter()
    for g, v, o in sorted(rows, key=lambda x: (x[0], x[2], x[1])):
        want.append((g, v, o, sums[g]))
        sums[g] += v
    assert sorted(map(tuple, got)) == sorted(want)


def test_no_rows_and_no_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, "a"), (2, " ", None)]) == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
