"""Media columns: telephony audio in WAV form, expanded to PCM.

Mu-law and A-law bytes are expanded by lookup tables of 256 entries, which are built from the laws' rules. IMA ADPCM
is decoded sample by sample for all blocks of a batch at once: blocks do not depend on one another. PCM is resampled
by linear interpolation in integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import bounded, slices

#: WAV format tags.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17
#: Index changes of IMA ADPCM by the low three bits of a code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
#: Step sizes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
BLOCK = 64


def _mu_law() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int64) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype("<i2")


def _a_law() -> np.ndarray:
    code = np.arange(256, dtype=np.int64) ^ 0x55
    step, segment = (code & 0x0F) << 4, (code >> 4) & 7
    size = np.where(segment == 0, step + 8, step + 0x108 << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype("<i2")


MU_LAW_PCM, A_LAW_PCM = _mu_law(), _a_law()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, samples of a block) of IMA ADPCM blocks (blocks, bytes of a block), one channel.

    A header's step index beyond the table counts as its last.
    """
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(head[:, 2], len(STEPS) - 1)
    codes = np.empty((len(blocks), 2 * (blocks.shape[1] - 4)), np.uint8)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 0x0F, blocks[:, 4:] >> 4
    out = np.empty((codes.shape[1] + 1, len(blocks)), "<i2")
    out[0] = value
    steps, change = STEPS.astype(np.int32), INDEX_CHANGE.astype(np.int32)
    for k, code in enumerate(np.ascontiguousarray(codes.T).astype(np.int32), 1):
        step = steps[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
        index = np.clip(index + change[code & 7], 0, len(STEPS) - 1)
        out[k] = value
    return out.T


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate, between neighbours by linear interpolation, rounded down."""
    if rate == to or not len(samples):
        return samples
    at = np.arange(len(samples) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    wide = samples.astype(np.int64)
    right = np.minimum(left + 1, len(wide) - 1)
    return ((wide[left] * (to - part) + wide[right] * part) // to).astype("<i2")


def wav(data: bytes, kind: int, rate: int = 8000, block: int = 1, bits: int = 8) -> bytes:
    """A WAV file of one channel around sample bytes or blocks."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == IMA_ADPCM else struct.pack("<H", 0)
    samples = len(data) // block * (2 * (block - 4) + 1) if kind == IMA_ADPCM else len(data) // block
    per_second = rate * block // (2 * (block - 4) + 1) if kind == IMA_ADPCM else rate * block
    form = struct.pack("<HHIIHH", kind, 1, rate, per_second, block, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_parts(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, block, sample bytes) of a WAV file of one channel; None where it is none."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data" and form and form[1] == 1:
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def expand(media: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, 16-bit samples) of a telephony or PCM WAV file of one channel; None where it is none."""
    parts = wav_parts(media or b"")
    if parts is None:
        return None
    kind, rate, block, data = parts
    raw = np.frombuffer(data, np.uint8)
    if kind == MU_LAW:
        return rate, MU_LAW_PCM[raw]
    if kind == A_LAW:
        return rate, A_LAW_PCM[raw]
    if kind == IMA_ADPCM and block > 4:
        return rate, decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    return (rate, raw[: len(raw) // 2 * 2].view("<i2")) if kind == PCM and block == 2 else None


def pcm_column(df: DataFrame, media_col: str, id_col: str = "doc_id", rate: int = 16000) -> DataFrame:
    """``(id, rate, pcm)``: WAV files of a binary column as resampled 16-bit PCM, little-endian.

    Null, damaged or other media give a null ``pcm``; media without samples an empty one. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [expand(x) for x in batch.column(1).to_pylist()]
            pcm = [None if x is None else resample(x[1], x[0], rate).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rate] * len(pcm), pa.int32()), pa.array(pcm, pa.binary())], ["id", "rate", "pcm"])

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, "id long, rate int, pcm binary")


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each whole text's UTF-8 bytes as the mu-law samples of a WAV file.

    The bytes are followed by zeros up to a positive multiple of 64; a null text counts as empty. The samples are the
    bytes themselves, so nothing is lost. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [b"" if x is None else x.encode() for x in batch.column(1).to_pylist()]
            media = [wav(x + b"\0" * (BLOCK - len(x) if not x else -len(x) % BLOCK), MU_LAW) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return bounded(df).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def _figures(samples: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
    """(sum of squares, peak) of each run of samples."""
    wide = samples.astype(np.int64)
    return list(zip(np.add.reduceat(wide * wide, starts).tolist(), np.maximum.reduceat(np.abs(wide), starts).tolist()))


def payload_features(media: DataFrame, rate: int = 16000) -> DataFrame:
    """``(id, n_bytes, payload, media, tail_crc32, feature)``: what the stored files of ``store_payloads`` hold.

    The payload is read back from the file. ``feature`` has the energy and peak of its bytes taken as mu-law, as A-law and
    as ADPCM blocks of 64 bytes, and the number and CRC-32 of the samples, expanded by mu-law and resampled to ``rate``.
    Equal files have equal features. A null file, and one that is no whole WAVE file, has null in all that is read from it.
    An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "payload", "media", "tail_crc32", "feature"]
        for batch in slices(batches):
            files = batch.column(2).to_pylist()
            parts = [wav_parts(x or b"") for x in files]
            whole = [k for k, p in enumerate(parts) if p and p[0] == MU_LAW and p[3] and len(p[3]) % BLOCK == 0]
            payloads = [parts[k][3] for k in whole]
            raw = np.frombuffer(b"".join(payloads), np.uint8)
            starts = np.cumsum([0, *map(len, payloads)])[:-1]
            adpcm = decode_adpcm(raw.reshape(-1, BLOCK))
            views = [_figures(MU_LAW_PCM[raw], starts), _figures(A_LAW_PCM[raw], starts), _figures(adpcm.ravel(), starts // BLOCK * adpcm.shape[1])] if whole else []
            out: list[list] = [[None] * len(files) for _ in range(3)]
            for n, k in enumerate(whole):
                own_rate, samples = expand(files[k])
                pcm = resample(samples, own_rate, rate)
                figures = ";".join(f"{name}={v[n][0]},{v[n][1]}" for name, v in zip(("mulaw", "alaw", "adpcm"), views))
                out[0][k], out[1][k], out[2][k] = payloads[n], zlib.crc32(payloads[n][-BLOCK:]), f"{figures};pcm{rate}={len(pcm)},{zlib.crc32(pcm.tobytes()):08x}"
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.binary()), batch.column(2), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names)

    return bounded(media).select("id", "n_bytes", "media").mapInArrow(run, "id long, n_bytes long, payload binary, media binary, tail_crc32 long, feature string")
