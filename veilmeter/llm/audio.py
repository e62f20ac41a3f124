"""Media columns: telephony audio (mu-law, A-law and IMA ADPCM) kept as WAV bytes in a binary column.

A clip is one row. `pack_ulaw` turns a byte payload into a mu-law WAV file of 8 kHz mono, one byte a sample, so that
the data chunk is the payload itself. `decode_wav` reads a WAV file of format 6 (A-law), 7 (mu-law) or 17 (IMA ADPCM)
back into 16-bit PCM, and `store_resampled` keeps that PCM at twice the rate. G.711 codes are expanded by tables of 256
entries; ADPCM blocks are independent, so numpy steps through the nibbles of many blocks at once.

Defined cases: a null text counts as empty; an empty payload is padded to one frame; equal texts give equal values, so ties
and repeated rows need no rule, and each row has its result; clips of any length are decoded in slices of bounded size; an empty table gives an empty table; other columns of the
input are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmeter.llm.common import slices, text_or_empty, written

FRAME = 576
RATE = 8000
SLICE = 4096  # blocks decoded at once

# The IMA ADPCM step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
])
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _ulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype("<i2")


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(exponent == 0, low + 8, (low + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype("<i2")


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index * 16 + nibble: the change of the sample, and the next step index."""
    step, nibble = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_CHANGE[nibble & 7], 0, len(STEPS) - 1)
    return np.where(nibble & 8, -change, change).ravel().astype(np.int32), after.ravel().astype(np.int32)


ULAW, ALAW = _ulaw_table(), _alaw_table()
CHANGE, AFTER = _adpcm_tables()


def wav(data: bytes, tag: int, block: int = 1) -> bytes:
    """A WAV file of one mono channel around the data chunk; tag 1 is PCM, 6 A-law, 7 mu-law, 17 IMA ADPCM."""
    rate = RATE * 2 if tag == 1 else RATE
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * block, block, 16 if tag == 1 else 4 if tag == 17 else 8, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, memoryview]:
    """Format tag, block size and data chunk."""
    view, at, tag, block = memoryview(media), 12, 0, 1
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if kind == b"fmt ":
            tag, block = struct.unpack_from("<H", view, at + 8)[0], struct.unpack_from("<H", view, at + 20)[0]
        if kind == b"data":
            return tag, block, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks, one a row, to rows of 16-bit samples; a header's step index beyond the table counts as its last."""
    head = np.ascontiguousarray(blocks[:, :4])
    sample = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32)
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(columns), len(blocks)), dtype="<i2")
    out[0] = sample
    for k, column in enumerate(columns):
        for half, nibble in enumerate((column & 15, column >> 4)):
            key = (index << 4) + nibble
            sample = np.clip(sample + CHANGE[key], -32768, 32767)
            index = AFTER[key]
            out[1 + 2 * k + half] = sample
    return np.ascontiguousarray(out.T)


def resample2(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation in integers; the last sample is held."""
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[::2] = pcm
    if len(pcm):
        wide = pcm.astype(np.int32)
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
    return out


def decode_wav(media: bytes) -> np.ndarray:
    tag, block, data = parse_wav(media)
    codes = np.frombuffer(data, dtype=np.uint8)
    if tag in (6, 7):
        return (ULAW if tag == 7 else ALAW)[codes]
    if tag == 17:
        whole = codes[: len(codes) // block * block].reshape(-1, block)
        return np.concatenate([np.empty(0, "<i2"), *(decode_adpcm(whole[k : k + SLICE]).ravel() for k in range(0, len(whole), SLICE))])
    if tag == 1:
        return codes.view("<i2")
    raise ValueError(f"WAV format {tag} is not supported")


def store_resampled(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, pcm_wav: each clip as a PCM WAV file of twice the telephony rate; a null clip stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in slices(big, 1)):
            clips = [None if x is None else wav(resample2(decode_wav(x)).tobytes(), 1, 2) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(clips, pa.binary())], ["k", "pcm_wav"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(media)).mapInArrow(run, f"k {kind}, pcm_wav binary").withColumnRenamed("k", key)


def pack_ulaw(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: the text's UTF-8 bytes, padded by 255 (mu-law silence) to whole frames, as a mu-law WAV file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for big in batches for x in slices(big, 1)):
            raw = [x.encode() for x in b.column(1).to_pylist()]
            media = [wav(x + b"\xff" * (-len(x) % FRAME or FRAME * (not x)), 7) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["k", "n_bytes", "media"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(F.col(key).alias("k"), text_or_empty(text)).mapInArrow(run, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def _groups(clips: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of clips that hold about SLICE blocks together."""
    start = held = 0
    for k, x in enumerate(clips):
        held += len(x)
        if held >= SLICE:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(clips):
        yield start, len(clips)


def clip_features(payloads: list[memoryview]) -> list[str]:
    """Of each payload as mu-law, as A-law and as ADPCM blocks: checksum of the PCM, and level; of the first also the checksum of the PCM at twice the rate."""
    codes = [np.frombuffer(p, dtype=np.uint8) for p in payloads]
    blocks = [c.reshape(-1, FRAME) for c in codes]
    sums = []
    for a, b in _groups(blocks):
        crc = [0] * (b - a)
        owner = np.repeat(np.arange(b - a), [len(x) for x in blocks[a:b]])
        whole = np.concatenate(blocks[a:b])
        for k in range(0, len(whole), SLICE):
            pcm, mine = decode_adpcm(whole[k : k + SLICE]), owner[k : k + SLICE]
            cuts = np.flatnonzero(np.diff(mine, prepend=-1, append=-1))
            for x, y in zip(cuts[:-1], cuts[1:]):
                crc[mine[x]] = zlib.crc32(pcm[x:y], crc[mine[x]])
        sums += crc
    out = []
    for c, adpcm in zip(codes, sums):
        u, a = ULAW[c], ALAW[c]
        level = [np.sqrt(np.bincount(c, minlength=256) @ t.astype(np.float64) ** 2 / len(c)) for t in (ULAW, ALAW)]
        out.append(f"ulaw={zlib.crc32(u):08x}:{level[0]:.3f};alaw={zlib.crc32(a):08x}:{level[1]:.3f};adpcm={adpcm:08x};pcm16k={zlib.crc32(resample2(u)):08x}")
    return out


def media_digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored clips, from their bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, 2, 1000, 4 << 20):
                clips = b.column(2).to_pylist()
                data = [parse_wav(x)[2] for x in clips]
                columns = [
                    b.column(0), b.column(1), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()),
                    pa.array([zlib.crc32(x[-32:]) for x in data], pa.int64()), pa.array(map(len, clips), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in clips], pa.string()), pa.array(clip_features(data), pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.select(key).schema[0].dataType.simpleString()
    schema = f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col(key).alias("k"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("k", key)


def op3(docs: DataFrame) -> DataFrame:
    """Every document through a stored media table and back."""
    return media_digest(written(pack_ulaw(docs), "media", compression="zstd"))
