import io
import wave
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa

from stowage.llm import media


def test_round_trip(spark):
    texts = [None, "", "a", "é" * 100, "x" * 192, "x" * 193, "long " * 40_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(99, "a", 5)], "doc_id long, text string, FEATURE int")
    stored = media.store_audio(df)
    rows = {r["doc_id"]: r for r in stored.collect()}
    out = {r["doc_id"]: r for r in media.audio_features(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        with wave.open(io.BytesIO(bytes(rows[i]["media"]))) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, media.RATE) and w.readframes(w.getnframes()) == payload
        assert (out[i]["payload_bytes"], out[i]["payload_sha256"], out[i]["tail_crc32"]) == (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        batch = pa.ipc.open_stream(bytes(out[i]["tensors"])).read_all()
        assert isinstance(batch.schema.field("mel").type, pa.FixedShapeTensorType) and batch.schema.field("mel").type.shape == [media.PATCH, media.MELS]
    assert out[2]["feature"] == out[99]["feature"] and bytes(out[2]["tensors"]) == bytes(out[99]["tensors"])


def test_bad_files(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"RIFF")), (3, bytearray(b"junk" * 20))], "id int, media binary")
    assert all(r["feature"] is None for r in media.audio_features(df).collect())
    assert media.audio_features(df.limit(0)).count() == 0


def test_resampling_keeps_a_tone_and_blocks_agree(monkeypatch):
    t = np.arange(60_000) / media.RATE
    x = np.sin(2 * np.pi * 400 * t).astype(np.float32)
    y = media.resample(x, 0, 40_000)
    peak = np.abs(np.fft.rfft(y[1000:39_000] * np.hanning(38_000))).argmax() * media.NEW_RATE / 38_000
    assert abs(peak - 400) < 1 and abs(np.abs(y[2000:38_000]).max() - 1) < 0.05
    assert np.allclose(media.resample(x, 12_000, 500), y[12_000:12_500], atol=1e-6)
    samples = (128 + 100 * x).astype(np.uint8).tobytes()
    whole = media.log_mel(samples)[0]
    monkeypatch.setattr(media, "BLOCK", 16)
    assert np.allclose(media.log_mel(samples)[0], whole, atol=1e-4)


def test_segments_have_hysteresis():
    e = np.array([0, 0, 1.2, 3, 1.2, 0, 1.2, 1.2, 0, 0], dtype=float)
    level = e - e.mean()
    assert (level[[2, 3, 4, 6, 7]] > media.LOW).all()
    got = media.active_segments(e)
    assert got.tolist()[0] == [2, 5] and len(got) == (2 if level[6] > media.HIGH else 1)


def test_features_against_the_formulas():
    """Resampling as zero stuffing, one convolution and decimation; mel energies by a plain Fourier sum; segments by a walk. Over several blocks of frames."""
    rng = np.random.default_rng(2)
    for size in (192, 192 * 7, 192 * (media.BLOCK + 3)):
        raw = bytes((128 + 60 * np.sin(np.arange(size) / 9) * (rng.random(size) > 0.3) * (np.arange(size) // 3000 % 2)).astype(np.uint8))
        mels, energy = media.log_mel(raw)
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
        stuffed = np.zeros(len(x) * media.UP)
        stuffed[:: media.UP] = x
        y = np.convolve(stuffed, media.FILTER.astype(np.float64))[media.UP * (media.TAPS - 1 - media.TAPS // 2) :: media.DOWN]
        length = -(-size * media.UP // media.DOWN)
        frames = max(1, -(-(length - media.FRAME) // media.HOP) + 1)
        assert mels.shape == (frames, media.MELS) and len(energy) == frames
        y = np.concatenate([y, np.zeros(frames * media.HOP + media.FRAME)])
        bins = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(media.FRAME // 2 + 1)) / media.FRAME)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / media.FRAME)
        for f in sorted({0, 1, frames // 2, frames - 2, frames - 1} & set(range(frames))):
            cut = y[f * media.HOP : f * media.HOP + media.FRAME]
            power = np.abs((cut * hann) @ bins) ** 2
            assert np.allclose(mels[f], np.log(power @ media.BANK + 1e-6), atol=2e-2) and abs(energy[f] - np.log((cut * cut).mean() + 1e-6)) < 1e-2
        level, walk, begun, loud = energy - energy.mean(), [], None, False
        for f in range(frames + 1):
            if f < frames and level[f] > media.LOW:
                begun, loud = f if begun is None else begun, loud or level[f] > media.HIGH
            elif begun is not None:
                walk += [[begun, f]] if loud else []
                begun, loud = None, False
        assert media.active_segments(energy).tolist() == walk


def test_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "abc", "x")], "doc_id long, text string, Tensors string")
    r = media.audio_features(media.store_audio(df)).first()
    assert r["doc_id"] is None and r["payload_bytes"] == 192 and len(r["tensors"]) > 0 and r["segments"] == []
