import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cellweave.llm.components import components
from cellweave.llm.simhash import anchors, fingerprint, links, meetings, near_duplicates


def plain(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, fps, distance=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def test_every_value_has_one_home_and_its_neighbours_reach_it():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    row, anchor, home = anchors(fp)
    assert (np.bincount(row[home]) == 2).all() and np.bincount(row).max() == 34
    other = fp ^ (np.uint64(1) << rng.integers(0, 32, 300).astype(np.uint64)) ^ (np.uint64(3) << np.uint64(40))
    r2, a2, _ = anchors(other)
    homes = {i: set(anchor[home & (row == i)].tolist()) for i in range(300)}
    assert all(homes[i] & set(a2[r2 == i].tolist()) for i in range(300))


def test_links_within_seven_meet_on_a_block_of_sixteen():
    r = random.Random(4)
    for _ in range(200):
        f = g = r.getrandbits(64)
        for bit in r.sample(range(64), r.randint(0, 7)):
            g ^= 1 << bit
        (_, a, home), (_, b, _) = (anchors(np.array([x], np.uint64), 16) for x in (f, g))
        assert set(a[home].tolist()) & set(b.tolist())


def test_fingerprints():
    r = random.Random(5)
    for _ in range(200):
        text = " ".join(r.choice(["Ab", "b\xa0c", "É", "x\n", "zz"]) for _ in range(r.randint(0, 12)))
        assert fingerprint(text) == plain(text)
    assert fingerprint(None) == fingerprint(" \t") == 0


def test_links_find_all_within_three(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for f in base[:40]:
        for _ in range(6):
            for _ in range(r.randint(1, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {x.u: x.v for x in components(links(df)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(signed(f), signed(f)), set()).add(f)
    want = {}
    for f, c in zip(fps, classes(fps, fps)):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(7)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(40):
        w = [r.choice(words) for _ in range(300)]
        for _ in range(r.randint(1, 4)):
            rows.append((r.randint(0, 500), " ".join(w)))
            w[r.randrange(300)] = "edit"
    rows += [(9, None), (8, ""), (None, " "), (None, "only here"), rows[0], rows[0]]
    fps = [plain(t) for _, t in rows]
    for distance in (3, 7):
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), distance=distance).collect()
        want = sorted(zip([i for i, _ in rows], fps, classes([i for i, _ in rows], fps, distance)), key=str)
        assert sorted([(x.id, x.fp % (1 << 64), x.component_id) for x in got], key=str) == want
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_links_within_eleven_meet_on_a_block_of_sixteen_with_threshold_two():
    r = random.Random(6)
    assert np.bincount(anchors(np.array([r.getrandbits(64) for _ in range(300)], np.uint64), 16, 2)[0]).max() == 176
    for _ in range(200):
        f = g = r.getrandbits(64)
        for bit in r.sample(range(64), r.randint(0, 11)):
            g ^= 1 << bit
        (_, a, home), (_, b, _) = (anchors(np.array([x], np.uint64), 16, 2) for x in (f, g))
        assert set(a[home].tolist()) & set(b.tolist())


def test_rows_that_share_an_id_and_heavy_fingerprints(spark):
    """One id on two unlike texts does not link them; a fingerprint that most rows have, and a very long text."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, "one text of its own"), (5, "quite another one here"), (2, "quite another one here")]
    rows += [(i, "") for i in range(100, 1300)] + [(3, long), (4, long.upper())]
    got = {(x.id, x.fp): x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for (i, f), c in got.items() if f == 0} == {100} and len(got) == 1205
    assert sorted(c for (i, _), c in got.items() if i == 5) == [2, 5] and [c for (i, _), c in got.items() if i in (3, 4)] == [3, 3]


def test_replicas_leave_in_small_batches_whatever_comes_in():
    """What tells texts apart goes along with each of 176 replicas: sent by thousands of fingerprints it takes hundreds of MB of a task."""

    class Rows:
        columns = ["fp", *"abcdefghij"]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            raise StopIteration

    rows, rng = Rows(), np.random.default_rng(2)
    with pytest.raises(StopIteration):
        meetings(rows, 11, None, "")
    fp = rng.integers(0, 1 << 63, 5000, dtype=np.int64)
    sent = list(rows.run(iter([pa.RecordBatch.from_arrays([pa.array(fp + k) for k in range(11)], Rows.columns)])))
    assert max(b.nbytes for b in sent) < 8 << 20
    row, anchor, home = anchors(fp.view(np.uint64), 16, 2)
    got = np.concatenate([np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]) for b in sent], axis=1)
    want = np.stack([anchor.view(np.int64), *(fp[row] + k for k in range(11)), home.astype(np.int64)])
    assert (got[:, np.lexsort(got[:2])] == want[:, np.lexsort(want[:2])]).all()


def test_replicas_are_not_broadcast_however_few_spark_takes_them_to_be(spark):
    """3000 fingerprints are 48 kB to Spark, and no more when each has become 34 rows."""
    found = links(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    assert found.count() == 0
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [re.search("[A-Za-z]|$", x).start() for x in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            under = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
            assert not any("MapInArrow" in x for x in lines[k:under]), "\n".join(lines)
    assert any("MapInArrow" in x for x in lines)


@pytest.mark.parametrize("block, most", [(4, 1 << 20), (4, 0), (1, 1 << 20)])
def test_anchors_in_parts(spark, monkeypatch, block, most):
    """Busy anchors, broadcast or not, in many parts: pairs are those of anchors in one part."""
    from cellweave.llm import simhash as s

    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(12)})
    monkeypatch.setattr(s, "BLOCK", block)
    monkeypatch.setattr(s, "BROADCAST", most)
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def pairs(anchor, i, j, of):
        yield of("fp", i), of("fp", j)

    got = {(x.u % (1 << 64), x.v % (1 << 64)) for x in meetings(rows, 3, pairs, "u long, v long").collect()}
    assert got == {(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3}


@pytest.mark.parametrize("cells", [1, 7, 1 << 18])
def test_large_groups_are_compared_as_small_ones_are(monkeypatch, cells):
    from cellweave.llm import simhash as s

    rng = np.random.default_rng(3)
    sizes = [(3, 5), (1, 40), (0, 6), (30, 20), (4, 0), (2, 2)]
    keys = np.repeat(np.arange(6), [a + b for a, b in sizes])[:, None]
    side = np.concatenate([np.r_[np.zeros(a), np.ones(b)] for a, b in sizes])
    fp = rng.integers(0, 1 << 12, len(side)).astype(np.uint64)
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if keys[i] == keys[j] and side[i] < side[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    monkeypatch.setattr(s, "CELLS", cells)
    for square in (1, 30, 1 << 14):
        monkeypatch.setattr(s, "SQUARE", square)
        got = [(int(i), int(j)) for x in s._near(keys, side, fp, 3) for i, j in zip(*x)]
        assert len(got) == len(want) and set(got) == want


def test_what_busy_anchors_send_grows_with_their_members(spark, monkeypatch):
    """One member in 44 of an anchor is at home: twice the fingerprints are about twice the rows sent, not four times."""
    from cellweave.llm import simhash as s

    monkeypatch.setattr(s, "BLOCK", 4)
    sent, dealt = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda rows, *by: sent.append(rows.count()) or dealt(rows, *by))
    for n in (600, 1200):
        fps = spark.range(n).select(F.xxhash64("id").alias("fp"))
        meetings(fps, 11, lambda anchor, i, j, of: iter(()), "u long")
    assert 1.9 * sent[0] < sent[1] < 2.3 * sent[0]
