import random

import public_tokenizers
import tiktoken

from cellweave.llm.bpe import MULTI_50K, codec, decode, decoded, encode, token_bytes


def library():
    own = codec(MULTI_50K)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts():
    r = random.Random(1)
    alphabet = "abcdefghij éüñßçàñ0123 \n\t.,!'“”日本語한국Жd\U0001f600‍\x1c\xa0"
    out = ["", " ", "don't we'll  x\n\n y <|endoftext|>", "a" * 5000, "ab" * 3000 + "é" * 999, "\x1c\x1d a  b 　", "123456789012345678901234567890" * 20]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 120))) for _ in range(400)]
    return out + ["".join(r.choice(["th", "er", "on", "ing", "sch", "ción", "eau"]) for _ in range(60)) for _ in range(60)]


def test_ids_are_the_librarys():
    own, them = codec(MULTI_50K), library()
    import numpy as np

    for t in texts():
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == them.encode_ordinary(t), t[:80]
        assert decoded(ids, token_bytes(MULTI_50K)) == t.encode()


def test_every_character_is_split_as_the_library_splits_it():
    import numpy as np

    own, them = codec(MULTI_50K), library()
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0xFE00, 0x10000, 3)) + list(range(0x1F000, 0x1FA00, 7))
    for k in range(0, len(points), 500):
        text = "".join(f"x{chr(c)}1 {chr(c)}{chr(c)} ." for c in points[k : k + 500])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == them.encode_ordinary(text)


def test_a_decoy_longest_match_is_taken_back():
    own = codec(MULTI_50K)
    r = random.Random(9)
    words = [t for t in own.ranks if 2 <= len(t) <= 4][:4000]
    for _ in range(300):
        raw = b"".join(r.choice(words) for _ in range(6))
        if raw not in own.ranks:
            assert own.encode_piece(raw) == own.merged(raw)


def test_rows(spark):
    rows = [(1, "hello"), (1, "hello"), (None, None), (3, "")]
    got = decode(encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((str(x.id), bytes(x.decoded)) for x in got) == [("1", b"hello"), ("1", b"hello"), ("3", b""), ("None", b"")]
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
