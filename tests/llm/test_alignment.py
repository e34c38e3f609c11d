import json
import random
from collections import Counter

import pytest
import sentencepiece
from cellweave.llm import alignment
from tokenizers import Tokenizer

A, B = Tokenizer.from_file(alignment.BPE_50K), sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES_32K)
A.encode_special_tokens = True
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def bytes_a(i):
    return bytes(_BYTE[c] for c in A.id_to_token(i))


def bytes_b(i):
    return bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()


def plain(text):
    """(ids of both, groups, links) of a whole text, encoded as one."""
    full = f" {text}".encode()
    a, b = (A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)) if text else ([], [])
    if not text or b"".join(map(bytes_a, a)) != full or b"".join(map(bytes_b, b)) != full:
        return [], [], [], []
    owner_a = [k for k, i in enumerate(a) for _ in bytes_a(i)]
    owner_b = [k for k, i in enumerate(b) for _ in bytes_b(i)]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, x, y = [], 0, 0
    for at in range(1, len(full) + 1):
        if at == len(full) or (owner_a[at] != owner_a[at - 1] and owner_b[at] != owner_b[at - 1]):
            groups.append(f"{','.join(str(a[k]) for k in range(x, owner_a[at - 1] + 1))}|{','.join(str(b[k]) for k in range(y, owner_b[at - 1] + 1))}")
            x, y = owner_a[at - 1] + 1, owner_b[at - 1] + 1
    return a, b, groups, [(a[i], b[j]) for i, j in links]


def brute(rows):
    done = [(i, *plain(t)) for i, t in rows]
    count = Counter(x for *_, links in done for x in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((i, len(a), len(b), len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), ";".join(g)) for i, a, b, g, x in done), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(x) for x in alignment.align(df, **options).collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\r\n x;\r\n\r\n  y"), (5, "a▁b"), (6, "<|endoftext|> <s> a</s>"), (7, "x  "), (8, "\n\n"), (9, "日本語 テキスト　です"),
    (10, "a\x00b \x1c c　 d　　e"), (11, "x" * 5000 + " " + "é" * 3000), (12, "\t\tfoo\r\rbar\r baz\xa0 qux   z"), (13, "👩‍👩 ok ’s don't I'll"), (None, "a b"),
    (4, "a b"), (14, ";\r"), (15, "a \r b \r\r c\r"), (16, "foo\x0b\x0cbar \x85 baz"), (17, "﻿ x y"),
]


def test_against_whole_texts(spark):
    r = random.Random(1)
    parts = ["the", "of", "Straße", "naïve", "12345", "foo_bar();", "{\r\n", "ß", "́", "  ", "\n", "\t", "don't", "👍", "ab\xa0cd", "\r", "..."]
    rows = ODD + [(100 + i, r.choice(["", " ", "\n"]).join(r.choice(parts) for _ in range(r.randrange(60)))) for i in range(60)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert found(spark, rows, chunk_bytes=1, broadcast=-1) == want


def test_vocabulary_map(spark):
    rows = [(i, t) for i, t in ODD if t] + [(50, "the naïve the")]
    pairs = alignment.vocabulary_map(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    count = Counter(x for _, t in rows for x in plain(t)[3])
    assert {(p.a_id, p.b_id): p.links for p in pairs} == count
    assert all(p.best == (p.links == max(n for (_, b), n in count.items() if b == p.b_id)) for p in pairs)


def test_no_rows_long_text_and_other_columns(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    df = spark.createDataFrame([("x", "word " * 150_000, 9)], "chunk string, text string, doc_id int")
    row = alignment.align(df).first()
    assert (row["id"], row["n_groups"]) == (9, len(row["groups"].split(";"))) and row["n_a"] >= 150_000


def test_unfit_vocabularies_are_refused(tmp_path):
    rule = json.loads(A.to_str())
    rule["pre_tokenizer"] = None
    (tmp_path / "a.json").write_text(json.dumps(rule))
    with pytest.raises(ValueError, match="another rule"):
        alignment.Pair(str(tmp_path / "a.json"), alignment.PIECES_32K)
