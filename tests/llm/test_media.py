import hashlib
import random

import numpy as np

from cellweave.llm import media


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            delta = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                delta += part if code & bit else 0
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
            out.append(value)
    return out


def test_laws():
    assert (media.MU_LAW_PCM[0x00], media.MU_LAW_PCM[0x80], media.MU_LAW_PCM[0xFF], media.MU_LAW_PCM[0x7F]) == (-32124, 32124, 0, 0)
    assert (media.A_LAW_PCM[0xD5], media.A_LAW_PCM[0x55], media.A_LAW_PCM[0xAA], media.A_LAW_PCM[0x2A]) == (8, -8, 32256, -32256)
    for table in (media.MU_LAW_PCM, media.A_LAW_PCM):
        assert sorted(table[:128].astype(int)) == sorted(-table[128:].astype(int))


def test_adpcm_across_blocks():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (50, 64), dtype=np.uint8)
    got = media.decode_adpcm(blocks)
    assert [x.tolist() for x in got] == [plain_adpcm(bytes(b)) for b in blocks]


def test_files_round_trip_and_resample():
    samples = np.array([0, 100, -100, 32767, -32768], "<i2")
    raw = bytes(range(256))
    assert media.wav_parts(media.wav(raw, media.A_LAW)) == (media.A_LAW, 8000, 1, raw)
    assert media.expand(media.wav(samples.tobytes(), media.PCM, block=2, bits=16))[1].tolist() == samples.tolist()
    assert media.expand(media.wav(raw, media.IMA_ADPCM, block=64, bits=4))[1].tolist() == sum((plain_adpcm(raw[i : i + 64]) for i in range(0, 256, 64)), [])
    assert media.resample(samples, 8000, 16000).tolist() == [0, 50, 100, 0, -100, 16333, 32767, -1, -32768, -32768]
    assert media.resample(samples, 8000, 4000).tolist() == [0, -100]
    assert media.expand(b"RIFFxxxx") is None and media.expand(None) is None


def test_payloads(spark):
    r = random.Random(1)
    texts = [None, "", "x", "y" * 64, "é" * 40, "".join(r.choice("abc d\n") for _ in range(5000)), "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.id: x for x in media.payload_features(media.store_payloads(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (got[i].n_bytes, bytes(got[i].payload)) == (len(raw), padded)
        assert bytes(media.wav_parts(bytes(got[i].media))[3]) == padded
        energy = int((media.MU_LAW_PCM[np.frombuffer(padded, np.uint8)].astype(np.int64) ** 2).sum())
        assert got[i].feature.startswith(f"mulaw={energy},")
    assert got[2].feature == got[6].feature and got[0].feature == got[1].feature
    pcm = media.pcm_column(media.store_payloads(df), "media", "id").collect()
    assert {x.id: len(x.pcm) for x in pcm} == {i: 4 * len(bytes(got[i].payload)) for i in got}
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (None, bytearray(media.wav(b"", media.A_LAW)))], "doc_id long, m binary")
    assert sorted((str(x.id), x.pcm and bytes(x.pcm)) for x in media.pcm_column(odd, "m").collect()) == [("1", None), ("2", None), ("None", bytearray())]
    assert media.store_payloads(df.limit(0)).count() == 0


def test_hash_of_the_stored_form(spark, tmp_path):
    from cellweave.llm.queries import queries

    spark.createDataFrame([(4, "abc")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = queries()["op8_media_payloads"](spark, str(tmp_path)).collect()
    stored = media.wav(b"abc" + b"\0" * 61, media.MU_LAW)
    assert (row.payload_bytes, row.media_bytes, row.media_sha256) == (64, len(stored), hashlib.sha256(stored).hexdigest())


def test_null_and_damaged_files_have_no_features(spark):
    good = media.wav(b"x" * 64, media.MU_LAW)
    rows = [(1, 3, good), (2, 0, None), (3, 0, b"RIFF"), (4, 0, good[:40]), (None, 0, media.wav(b"y" * 64, media.A_LAW))]
    df = spark.createDataFrame(rows, "id long, n_bytes long, media binary")
    got = {x.id: x for x in media.payload_features(df).collect()}
    assert bytes(got[1].payload) == b"x" * 64 and got[1].feature
    assert all(got[i].payload is None and got[i].tail_crc32 is None and got[i].feature is None for i in (2, 3, 4, None))
    assert media.payload_features(df.where("id = 2")).count() == 1 and media.payload_features(df.limit(0)).count() == 0
