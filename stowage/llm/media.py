"""Media columns: audio stored losslessly, and its features as fixed-shape Arrow tensors with time spans.

A payload of bytes is stored as 8-bit mono samples in a WAV file, built by column functions. Features are computed from
the stored file: polyphase resampling by UP / DOWN, log-mel energies of overlapped windowed frames, and segments of high
energy with hysteresis (a segment is a run of frames above the low threshold with one above the high). Mel frames are
stored in patches of PATCH frames as an Arrow IPC stream with a fixed_shape_tensor column and each patch's time span.

Defined results: a null text is empty; an empty payload is one padded unit; a null file, or one that isn't 8-bit
mono WAV, has null features; long files are processed in blocks of frames; an empty table gives an empty result; columns with
an added name are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.llm.common import without

UNIT, RATE = 192, 8000
UP, DOWN, TAPS = 2, 3, 24
FRAME, HOP, MELS, PATCH = 256, 128, 24, 32
BLOCK = 4096
NEW_RATE = RATE * UP / DOWN
#: Hysteresis thresholds, in natural log units of frame energy relative to the file's mean.
HIGH, LOW = 0.5, 0.1
ADDED = ["payload_bytes", "payload_sha256", "tail_crc32", "tensors", "segments", "feature"]
SEGMENTS = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))


def little_endian(n: Column, size: int) -> Column:
    """A number's low bytes, lowest first, as binary."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)])


def wav_of(raw: Column) -> Column:
    """The WAV file of the bytes, padded by spaces to a positive multiple of UNIT."""
    n = F.octet_length(raw)
    padded = F.greatest(F.ceil(n / UNIT), F.lit(1)).cast("int") * UNIT
    payload = F.expr("rpad(`_raw`, `_padded`, X'20')")
    fixed = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    size = F.octet_length(payload)
    return padded, F.concat(F.lit(b"RIFF"), little_endian(size + 36, 4), F.lit(b"WAVE"), F.lit(fixed), F.lit(b"data"), little_endian(size, 4), payload)


def store_audio(df: DataFrame, *, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df with the text's bytes as a WAV file."""
    rows = without(df, [media_col, "_raw", "_padded"]).withColumn("_raw", F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")))
    padded, media = wav_of(F.col("_raw"))
    return rows.withColumn("_padded", padded).withColumn(media_col, media).drop("_raw", "_padded")


def read_wav(data: bytes) -> bytes | None:
    """The samples of an 8-bit mono WAV file, found by its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, sound = 12, False
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
            sound = (kind, channels, bits) == (1, 1, 8)
        elif name == b"data":
            return data[at + 8 : at + 8 + size] if sound and at + 8 + size <= len(data) else None
        at += 8 + size + size % 2
    return None


def low_pass() -> np.ndarray:
    """A Hann-windowed sinc of TAPS taps a phase, for the lower of the two rates, with gain UP."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    cutoff = 1 / max(UP, DOWN)
    return (np.sinc(n * cutoff) * cutoff * np.hanning(TAPS * UP + 2)[1:-1] * UP).astype(np.float32)


def mel_bank() -> np.ndarray:
    """(bins, MELS) triangles, evenly spaced on the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + NEW_RATE / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    hertz = np.arange(FRAME // 2 + 1) * NEW_RATE / FRAME
    rise = (hertz[:, None] - edge[None, :-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[None, 2:] - hertz[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


FILTER, BANK, WINDOW = low_pass(), mel_bank(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(x: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count of x resampled by UP / DOWN; first is a multiple of UP, and x is silent outside."""
    base = first // UP * DOWN
    rows = -(-count // UP)
    lead = TAPS // 2
    lo, hi = base - lead, base + rows * DOWN + TAPS
    part = np.zeros(hi - lo, np.float32)
    s, e = max(lo, 0), min(hi, len(x))
    if e > s:
        part[s - lo : e - lo] = x[s:e]
    out = np.empty((rows, UP), np.float32)
    for p in range(UP):
        shift, phase = p * DOWN // UP, p * DOWN % UP
        taps = FILTER[phase::UP][::-1]
        views = np.lib.stride_tricks.sliding_window_view(part, TAPS)[shift : shift + rows * DOWN : DOWN]
        out[:, p] = views @ taps
    return out.ravel()[:count]


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log-mel energies and each frame's log energy; frames overlap, the last is padded by silence."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    length = -(-len(x) * UP // DOWN)
    frames = max(1, -(-(length - FRAME) // HOP) + 1)
    mels, energy = [], []
    for f in range(0, frames, BLOCK):
        n = min(BLOCK, frames - f)
        y = resample(x, f * HOP, (n - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(cut * WINDOW, axis=1)) ** 2
        mels.append(np.log(power.astype(np.float32) @ BANK + 1e-6))
        energy.append(np.log((cut * cut).mean(1) + 1e-6))
    return np.concatenate(mels), np.concatenate(energy)


def active_segments(energy: np.ndarray) -> np.ndarray:
    """(segments, 2) first frame and end of the runs above LOW which somewhere are above HIGH."""
    level = energy - energy.mean()
    on = np.r_[False, level > LOW, False]
    edge = np.flatnonzero(on[1:] != on[:-1]).reshape(-1, 2)
    loud = np.concatenate([[0], np.cumsum(level > HIGH)])
    return edge[loud[edge[:, 1]] > loud[edge[:, 0]]]


def as_tensors(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream: mel fixed_shape_tensor<float32>[PATCH, MELS], start_s and end_s of each patch."""
    patches = -(-len(mels) // PATCH)
    full = np.zeros((patches * PATCH, MELS), np.float32)
    full[: len(mels)] = mels
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(patches, PATCH, MELS))
    start = np.arange(patches) * PATCH
    end = np.minimum(start + PATCH, len(mels)) - 1
    batch = pa.record_batch([tensor, pa.array(start * HOP / NEW_RATE), pa.array((end * HOP + FRAME) / NEW_RATE)], names=["mel", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def features_of(media: bytes | None) -> tuple:
    samples = read_wav(media) if media is not None else None
    if samples is None:
        return (None,) * len(ADDED)
    mels, energy = log_mel(samples)
    segments = active_segments(energy)
    spans = [{"start_s": s * HOP / NEW_RATE, "end_s": ((e - 1) * HOP + FRAME) / NEW_RATE} for s, e in segments.tolist()]
    mean = ",".join(str(int(v)) for v in np.round(mels.mean(0, dtype=np.float64) * 100))
    feature = f"frames={len(mels)};segments={len(segments)};active={int((segments[:, 1] - segments[:, 0]).sum())};mel={mean}"
    return len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), as_tensors(mels), spans, feature


def audio_features(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """df without media, with what is read back from it: digests of the samples, tensors, segments and a summary."""
    rows = without(df, ADDED)
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.BinaryType(), SEGMENTS, T.StringType()]
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), pa.string()]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, media = 0, b.column(media_col)
            rest = b.drop_columns([media_col])
            while at < len(media):
                got, size = [], 0
                while at + len(got) < len(media) and size < 8 << 20:
                    raw = media[at + len(got)].as_py()
                    size += len(raw or b"")
                    got.append(features_of(raw))
                out = rest.slice(at, len(got))
                for k, name in enumerate(ADDED):
                    out = out.append_column(name, pa.array([g[k] for g in got], arrow[k]))
                yield out
                at += len(got)

    kept = rows.drop(media_col)
    return rows.mapInArrow(go, T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))]))
