"""Media columns: telephony audio.

G.711 codes are expanded through 256-entry lookup tables, IMA ADPCM blocks are decoded with numpy
across blocks (one vector step per sample position, all blocks at once), and the PCM is resampled
by a windowed-sinc polyphase filter and stored as 16-bit WAV. Bytes are kept losslessly in a RIFF
container of 8-bit G.711 codes and read back from it.

Null, empty and odd input: a null payload counts as empty; ``telephony_column`` stores an empty
sound then. Repeated rows give repeated results; nothing is grouped, so there are no hot keys.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: WAVE format tags.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
#: Payload unit in bytes: a whole number of ADPCM blocks.
UNIT = 576


def mulaw_table() -> np.ndarray:
    """16-bit PCM of the 256 mu-law codes (G.711)."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of the 256 A-law codes (G.711)."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(step == 0, mantissa + 8, (mantissa + 264) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()

# The step sizes and index moves of the IMA ADPCM standard.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# End of fixed values.
_MAGNITUDES = np.array([[s // 8 + (s // 4 if c & 1 else 0) + (s // 2 if c & 2 else 0) + (s if c & 4 else 0) for c in range(8)] for s in IMA_STEPS.tolist()], np.int32)
#: By step index and 4-bit code: the change of the predictor, and the next step index.
_CHANGE = np.concatenate([_MAGNITUDES, -_MAGNITUDES], axis=1).ravel()
_NEXT = (np.clip(np.arange(89)[:, None] + np.concatenate([IMA_MOVES, IMA_MOVES])[None, :], 0, 88)).astype(np.int32).ravel()


def decode_ima_blocks(data: bytes | np.ndarray, block_bytes: int = UNIT, blocks_at_once: int = 8192) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks, an int16 array of shape (blocks, samples).

    A block is a 4-byte header (int16 predictor, step index, reserved; an index above 88 counts as
    88) and 4-bit codes, low nibble first. A last partial block is ignored.
    """
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    count, samples = len(raw) // block_bytes, 2 * (block_bytes - 4) + 1
    raw = raw[: count * block_bytes].reshape(count, block_bytes)
    out = np.empty((count, samples), np.int16)
    for at in range(0, count, blocks_at_once):
        part = raw[at : at + blocks_at_once]
        value = np.ascontiguousarray(part[:, :2]).view("<i2").ravel().astype(np.int32)
        index = np.minimum(part[:, 2], 88).astype(np.int32)
        codes = np.ascontiguousarray(part[:, 4:].T)
        pcm = np.empty((samples, len(part)), np.int16)
        pcm[0] = value
        for i in range(samples - 1):
            key = (index << 4) + ((codes[i >> 1] >> 4) if i & 1 else (codes[i >> 1] & 15))
            value = np.clip(value + _CHANGE[key], -32768, 32767)
            index = _NEXT[key]
            pcm[i + 1] = value
        out[at : at + len(part)] = pcm.T
    return out


def resample(pcm: np.ndarray, up: int, down: int, half_taps: int = 8) -> np.ndarray:
    """int16 PCM at ``up/down`` times the rate: Hann-windowed sinc, rounded and clipped.

    Output sample j stands at time j * down / up of the input; where that is an input sample and the
    rate isn't lowered, it is kept exactly. An empty input gives an empty output.
    """
    n = len(pcm)
    if not n:
        return np.zeros(0, np.int16)
    count = -(-n * up // down)
    x = np.concatenate([np.zeros(half_taps, np.float32), pcm.astype(np.float32), np.zeros(half_taps + 1, np.float32)])
    cutoff = min(1.0, up / down)
    out = np.empty(count, np.int16)
    for phase in range(up):  # outputs whose time has the same fraction share their taps
        if phase >= count:
            break
        at = phase * down // up
        shift = phase * down / up - at
        k = np.arange(-half_taps + 1, half_taps + 1)
        taps = cutoff * np.sinc(cutoff * (k - shift)) * (0.5 + 0.5 * np.cos(np.pi * np.clip((k - shift) / half_taps, -1, 1)))
        taps = (taps / taps.sum()).astype(np.float32)
        taken = len(range(phase, count, up))
        y = np.zeros(taken, np.float32)
        for j, t in zip(k.tolist(), taps.tolist(), strict=True):
            if abs(t) > 1e-7:
                first = at + j + half_taps
                y += t * x[first : first + (taken - 1) * down + 1 : down][:taken]
        out[phase::up] = np.clip(np.rint(y), -32768, 32767)
    return out


def wav(data: bytes, codec: str, rate: int) -> bytes:
    """A mono RIFF/WAVE file of ``data`` in one of FORMATS but ADPCM (8-bit codes, or 16-bit PCM)."""
    width = 2 if codec == "pcm" else 1
    fmt = struct.pack("<HHIIHHH", FORMATS[codec], 1, rate, rate * width, width, 8 * width, 0)
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad


def read_wav(stored: bytes) -> tuple[str, int, bytes]:
    """Codec, rate and sound bytes of a RIFF/WAVE file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return next(k for k, v in FORMATS.items() if v == tag), rate, stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def expand(codec: str, data: bytes) -> np.ndarray:
    """int16 PCM of stored sound bytes."""
    if codec == "pcm":
        return np.frombuffer(data, "<i2")
    if codec == "ima_adpcm":
        return decode_ima_blocks(data).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(data, np.uint8)]


def telephony_column(df: DataFrame, column: str, codec: str = "mulaw", rate: int = 8000, to_rate: int = 16000) -> DataFrame:
    """``df`` with ``media`` (the codes of binary ``column`` in a RIFF file; ADPCM: the bare blocks) and ``pcm`` (a WAV of 16-bit PCM at ``to_rate``)."""
    schema = df.drop("media", "pcm").withColumn("media", F.lit(b"")).withColumn("pcm", F.lit(b"")).schema
    divisor = int(np.gcd(rate, to_rate))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column):
                media, pcm = [], []
                for value in batch.column(column).to_pylist():
                    data = value or b""
                    stored = data if codec == "ima_adpcm" else wav(data, codec, rate)
                    back = (codec, rate, stored) if codec == "ima_adpcm" else read_wav(stored)
                    media.append(stored)
                    pcm.append(wav(resample(expand(back[0], back[2]), to_rate // divisor, rate // divisor).astype("<i2").tobytes(), "pcm", to_rate))
                kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("media", "pcm")]
                yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], [n for n, _ in kept] + ["media", "pcm"])

    return df.mapInArrow(convert, schema)


def _energy(pcm: np.ndarray) -> str:
    """Root mean square, rounded down, and sign changes; in whole numbers, so alike on every machine and at every length."""
    x = pcm.astype(np.int32)
    total = int(np.multiply(x, x, out=x).sum(dtype=np.int64)) if len(x) else 0  # a square has 31 bits at most
    turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{math.isqrt(total // max(1, len(x)))}/{turns}"


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_samples long, pcm_crc32 long"


def text_audio_digest(docs: DataFrame, rate: int = 8000, to_rate: int = 16000) -> DataFrame:
    """Each text's UTF-8 bytes as mu-law sound: stored, read back, decoded, resampled and measured.

    The payload is the text (null: empty) and bytes 255 up to a positive multiple of 576. ``media_*``
    describe the stored RIFF file of 8-bit codes. All else is computed from the bytes read back:
    ``feature`` joins root mean square and sign changes of the payload taken as mu-law, as A-law and
    as ADPCM blocks; ``pcm_*`` describe the resampled 16-bit sound. One pass, no shuffle.
    """
    divisor = int(np.gcd(rate, to_rate))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, loads = [], []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    data = (text or "").encode()
                    stored = wav(data + b"\xff" * (-len(data) % UNIT or UNIT * (not data)), "mulaw", rate)
                    codec, _, back = read_wav(stored)
                    loads.append(back)
                    pcm = expand(codec, back)
                    sound = resample(pcm, to_rate // divisor, rate // divisor)
                    rows.append([doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"mulaw:{_energy(pcm)} alaw:{_energy(expand('alaw', back))}", len(sound), zlib.crc32(sound.astype("<i2").tobytes())])
                blocks = decode_ima_blocks(np.frombuffer(b"".join(loads), np.uint8))
                at = 0
                for row, load in zip(rows, loads, strict=True):
                    n = len(load) // UNIT
                    row[7] += f" adpcm:{_energy(blocks[at : at + n].ravel())}"
                    at += n
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], DIGEST_SCHEMA.replace(" long", "").replace(" string", "").split(", "))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, DIGEST_SCHEMA)
