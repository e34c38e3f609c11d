import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cellweave.llm import packing


def reference(text):
    t = Tokenizer.from_file(packing.BPE_50K)
    return [*t.encode(text or "", add_special_tokens=False).ids, packing.END]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["the", "Éclair", "don't", "tion", "Schönheit", "12345", "a<|endoftext|>b", "\n\n", "  ", "x\ty"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 200, 900, 2500])))) for i in range(60)]
    return [*rows, (None, None), (7, ""), rows[5], rows[5]]


def test_places_are_gapless_and_pieces_whole(spark, rows):
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(reference(t))
    by_sequence, seen = defaultdict(list), defaultdict(list)
    for x in got:
        by_sequence[x.sequence_id].append((x.offset, x.length))
        fits = [d for d in ids[x.doc_id] if zlib.crc32(np.array(d[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32]
        assert fits and all((x.start, x.length) == packing.cuts(len(d), 1024)[x.piece] for d in fits[:1])
        seen[x.doc_id].append(x.length)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert {i: sum(v) for i, v in seen.items()} == {i: sum(map(len, d)) for i, d in ids.items()}
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_are_the_tokenizers_own(special_as_text):
    r = random.Random(11)
    marks = [" ", "  ", "   ", "\n", " \n", "\n ", "\t ", "\xa0", "\xa0 ", "\x1c", "\x1d ", "\u2003 ", "\u3000", "'s", "a", "été", "x1", "²", "_", "!?", "日本", "don't", "<|endoftext|>", "\u0120"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    own = packing.WordIds(packing.BPE_50K, special_as_text)
    t = Tokenizer.from_file(packing.BPE_50K)
    t.encode_special_tokens = special_as_text
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = [x.tolist() for k in range(0, 3000, 100) for x in own.documents(pa.array(texts[k : k + 100]), packing.END)]
    assert got == [[*w, packing.END] for w in want]
    assert own.documents(pa.array([], pa.string()), packing.END) == []
    assert [x.tolist() for x in own.documents(pa.array([None, ""]), 7)] == [[7], [7]]


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    own, texts = packing.WordIds(packing.BPE_50K), [f"word{i} other{i // 3} and\nmore" for i in range(60)]
    got = [x.tolist() for k in range(0, 60, 4) for x in own.documents(pa.array(texts[k : k + 4]), packing.END)]
    assert got == [reference(t) for t in texts] and len(own.words) <= 30


def test_packing_is_close_to_full():
    r = random.Random(1)
    sizes = [min(1024, int(r.lognormvariate(5.5, 1.2)) + 1) for _ in range(20000)]
    bins = packing.OpenBins(1024, packing.OPEN, 0)
    for s in sizes:
        bins.put(s)
    assert bins.next <= 1.01 * sum(sizes) / 1024
    assert len(packing.best_fit_decreasing(np.array(sizes), 1024)) <= 1.005 * sum(sizes) / 1024 + 1


def test_the_fullest_sequence_closes_first():
    bins = packing.OpenBins(10, 2, 0)
    assert [bins.put(6), bins.put(7), bins.put(8)] == [(0, 0), (1, 0), (2, 0)]
    assert bins.put(3) == (0, 6)
    assert bins.put(2) == (2, 8)
    assert bins.put(2) == (3, 0)


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(8)
    for _ in range(50):
        sizes = np.array([r.randint(1, 40) for _ in range(60)])
        free, want = [], []
        for i in np.argsort(-sizes, kind="stable"):
            fit = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
            if not fit:
                free.append(40)
                want.append([])
                fit = [(40, len(free) - 1)]
            b = min(fit)[1]
            free[b] -= sizes[i]
            want[b].append(sizes[i])
        got = packing.best_fit_decreasing(sizes, 40)
        assert len(got) == len(want) and sorted(i for g in got for i in g) == list(range(60))
        assert all(sizes[g].sum() <= 40 for g in got)


def test_matrices_hold_every_id(spark, rows):
    columns = "doc_id long, text string, ids string, lengths int"
    found, want = defaultdict(list), defaultdict(list)
    df = spark.createDataFrame([(*x, "k", 5) for x in rows], columns)
    for m in packing.pack_matrices(df, pool_tokens=5000, matrix_rows=4).collect():
        ids, positions = (np.frombuffer(x, "<u4").reshape(m.n_rows, 1024) for x in (m.ids, m.positions))
        for r in range(m.n_rows):
            edges = m.cu_seqlens[r]
            assert edges[0] == 0 and edges[-1] == m.lengths[r] and (ids[r, edges[-1] :] == packing.END).all()
            assert positions[r, edges[-1] :].tolist() == list(range(1024 - edges[-1]))
            for doc, start, a, b in zip(m.doc_ids[r], m.starts[r], edges, edges[1:]):
                found[doc].append((start, ids[r, a:b].tolist()))
                assert positions[r, a:b].tolist() == list(range(b - a))
    for i, t in rows:
        ids = reference(t)
        want[i] += [(s, ids[s : s + n]) for s, n in packing.cuts(len(ids), 1024)]
    order = lambda x: sorted(x, key=repr)
    assert {d: order(v) for d, v in found.items()} == {d: order(v) for d, v in want.items()}
    assert packing.pack_matrices(df.limit(0)).count() == 0


def test_rows_without_an_id_spread_over_tasks(spark):
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, False)
    try:
        got = packing.pack(spark.range(4000).repartition(8).selectExpr("CAST(NULL AS LONG) AS doc_id", "'a b' AS text"), length=8).collect()
    finally:
        spark.conf.unset(coalesced)
    assert len(got) == 4000 and len({x.sequence_id >> 40 for x in got}) > 1
    assert max(sum(x.length for x in got if x.sequence_id == s) for s in {x.sequence_id for x in got}) <= 8
