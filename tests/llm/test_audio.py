import hashlib
import zlib

import numpy as np
import pytest

from starledger.llm import audio

from .fixtures import frame


def mulaw(code):
    """The standard's formula."""
    code = ~code & 0xFF
    value = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return -value if code & 128 else value


def alaw(code):
    code ^= 0x55
    exponent, mantissa = code >> 4 & 7, code & 15
    value = (mantissa << 4) + 8 if not exponent else ((mantissa << 4) + 264) << exponent - 1
    return value if code & 128 else -value


def test_tables():
    assert audio.MULAW.tolist() == [mulaw(c) for c in range(256)] and audio.ALAW.tolist() == [alaw(c) for c in range(256)]
    assert (audio.MULAW[0], audio.MULAW[0x80], audio.MULAW[0xFF], audio.ALAW[0x2A], audio.ALAW[0xD5]) == (-32124, 32124, 0, -32256, 8)
    assert len(set(audio.ALAW.tolist())) == 256


def scalar_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for i in range(2 * (len(block) - 4)):
        code = block[4 + i // 2] >> 4 if i % 2 else block[4 + i // 2] & 15
        step = int(audio.IMA_STEPS[index])
        diff = step >> 3
        diff += (step >> 2 if code & 1 else 0) + (step >> 1 if code & 2 else 0) + (step if code & 4 else 0)
        value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
        index = max(0, min(88, index + int(audio.IMA_MOVES[code & 7])))
        out.append(value)
    return out


@pytest.mark.parametrize("size,at_once", [(36, 3), (576, 8192)])
def test_adpcm_equals_the_scalar_decoder(size, at_once):
    data = np.random.default_rng(2).integers(0, 256, size * 7 + 5).astype(np.uint8).tobytes()
    got = audio.decode_ima_blocks(data, size, at_once)
    assert got.tolist() == [scalar_ima(data[i * size : (i + 1) * size]) for i in range(7)]
    assert audio.decode_ima_blocks(b"", size).shape == (0, 2 * (size - 4) + 1)


def test_resampling():
    pcm = (8000 * np.sin(np.arange(4000) * 2 * np.pi * 440 / 8000)).astype(np.int16)
    up = audio.resample(pcm, 2, 1)
    assert np.array_equal(up[::2], pcm) and len(up) == 8000
    ideal = 8000 * np.sin(np.arange(8000) * 2 * np.pi * 440 / 16000)
    assert np.abs(up[100:-100] - ideal[100:-100]).max() < 60
    down = audio.resample(up, 1, 2)
    assert len(down) == 4000 and np.abs(down[100:-100].astype(int) - pcm[100:-100]).max() < 200
    assert len(audio.resample(pcm[:1], 441, 80)) == 6 and len(audio.resample(np.zeros(0, np.int16), 2, 1)) == 0


def test_files_round_trip():
    for codec in ("pcm", "alaw", "mulaw"):
        for data in (b"", b"abc" if codec != "pcm" else b"abcd", bytes(range(256))):
            assert audio.read_wav(audio.wav(data, codec, 8000)) == (codec, 8000, data)
    with pytest.raises(ValueError):
        audio.read_wav(b"nothing")


def test_digest_of_texts(spark):
    rows = [(1, "héllo"), (2, ""), (3, None), (4, "x" * 576), (5, "y" * 300_000), (6, "héllo"), (None, "z")]
    got = {r["doc_id"]: r for r in audio.text_audio_digest(frame(spark, rows)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        load = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        stored = audio.wav(load, "mulaw", 8000)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["pcm_samples"]) == (len(stored), hashlib.sha256(stored).hexdigest(), 2 * len(load))
    assert got[1]["feature"] == got[6]["feature"] != got[4]["feature"]
    assert audio.text_audio_digest(frame(spark, rows).limit(0)).count() == 0


def test_columns_of_sound(spark):
    df = spark.createDataFrame([(1, bytes(range(256)), "old"), (2, None, "old"), (3, b"", "old")], "id int, sound binary, media string")
    got = {r["id"]: r for r in audio.telephony_column(df, "sound", "alaw", 8000, 11025).collect()}
    codec, rate, pcm = audio.read_wav(bytes(got[1]["pcm"]))
    assert (codec, rate, len(pcm) // 2) == ("pcm", 11025, -(-256 * 441 // 320)) and audio.read_wav(bytes(got[1]["media"])) == ("alaw", 8000, bytes(range(256)))
    assert audio.read_wav(bytes(got[2]["pcm"]))[2] == b"" == audio.read_wav(bytes(got[3]["media"]))[2]
    blocks = spark.createDataFrame([(1, bytes(576 * 3))], "id int, sound binary")
    assert len(audio.read_wav(bytes(audio.telephony_column(blocks, "sound", "ima_adpcm").first()["pcm"]))[2]) == 3 * 1145 * 4
