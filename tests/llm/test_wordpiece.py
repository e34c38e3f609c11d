import random

from cellweave.llm.wordpiece import PIECES_32K, PieceCounter, count_tokens, counter, vocabulary


def plain(word, begin, going_on):
    at, n, kinds = 0, 0, begin
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in kinds), None)
        if end is None:
            return 0
        at, n, kinds = end, n + 1, going_on
    return n


def test_against_greedy_search():
    r = random.Random(2)
    for _ in range(40):
        begin = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)}
        going_on = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(12)}
        own = PieceCounter(begin, going_on)
        for _ in range(200):
            word = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 14)))
            assert own[word] == plain(word, begin, going_on)


def test_public_vocabulary_and_rows(spark):
    begin, going_on = map(set, vocabulary(PIECES_32K))
    text = "The Schönheit of unbelievable 日本 zzqx \x07bell and " + "a" * 3000
    words = text.split()
    counts = [plain(w, begin, going_on) for w in words]
    rows = [(1, text), (1, text), (None, None), (2, " \n")]
    got = sorted(map(tuple, count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    unknown = counts.count(0)
    assert got == sorted([(1, len(words), sum(counts) + unknown, unknown)] * 2 + [(None, 0, 0, 0), (2, 0, 0, 0)], key=str)
    assert counter(PIECES_32K)["the"] == 1
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_words_are_counted_and_not_remembered():
    own = counter(PIECES_32K)
    word = "ab" * 500_000
    assert own[word] == own.count(word) > 0 and word not in own.keys()
