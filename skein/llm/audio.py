"""Audio features: polyphase resampling, log-mel filterbanks and hysteresis segmentation."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import body, slices

UNIT = 64
RATE_IN, RATE_OUT = 16_000, 8_000
WINDOW, HOP, MELS = 256, 128, 32
#: Frames in one tensor; the last tensor of a recording is filled up with zeros.
TENSOR_FRAMES = 64
TAPS = 16
#: Decibels over the noise floor at which speech starts, and below which it ends.
START_DB, STOP_DB = 6.0, 3.0
_BLOCK = 2048


# The stored form: 8-bit mono WAV, written by Spark SQL.

def _little_endian(n: Column, size: int) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))]))


def payload(text: str = "text", unit: int = UNIT) -> Column:
    """The text's UTF-8 bytes, then bytes 0 up to a positive multiple of unit."""
    data = body(text).cast("binary")
    n = F.octet_length(data)
    fill = F.when(n == 0, F.lit(unit)).otherwise(F.pmod(-n, F.lit(unit)))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), fill.cast("int"))))


def wav(data: Column, rate: int = RATE_IN) -> Column:
    """Bytes as a WAV file of unsigned 8-bit samples."""
    n = F.octet_length(data)
    tag = lambda x: F.lit(x).cast("binary")
    number = lambda x, size: _little_endian(F.lit(x), size)
    head = [tag("RIFF"), _little_endian(n + 36, 4), tag("WAVEfmt "), number(16, 4), number(1, 2), number(1, 2), number(rate, 4), number(rate, 4), number(1, 2), number(8, 2), tag("data"), _little_endian(n, 4)]
    return F.concat(*head, data)


def read_wav(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of an 8-bit mono PCM file; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            rate = int.from_bytes(media[at + 12 : at + 16], "little")
        elif name == b"data":
            return np.frombuffer(media, np.uint8, size, at + 8), rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


# Signal processing.

@lru_cache
def _filter(up: int, down: int) -> tuple[np.ndarray, int]:
    """A windowed-sinc low pass for a rate of up / down, split into its up phases."""
    half = TAPS * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(len(t) + 2)[1:-1]
    h *= up / h.sum()
    taps = -(-len(h) // up)
    phases = np.zeros((up, taps), np.float32)
    for p in range(up):
        own = h[p::up]
        phases[p, : len(own)] = own
    return phases, half


def resample(samples: np.ndarray, first: int, count: int, up: int, down: int) -> np.ndarray:
    """Outputs first ... first + count - 1 of the signal at up / down times its rate; silence around it.

    Polyphase: each output takes the one phase of the filter that meets input samples,
    so no zeros are inserted or multiplied.
    """
    phases, half = _filter(up, down)
    taps = phases.shape[1]
    out = np.zeros(count, np.float32)
    for r in range(min(up, count)):
        position = (first + r) * down + half  # in the input with up - 1 zeros after each sample
        phase, newest = position % up, position // up
        n = -(-(count - r) // up)  # outputs first + r, first + r + up, ...
        low, high = newest - taps + 1, newest + (n - 1) * down + 1
        x = np.zeros(high - low, np.float32)
        a, b = max(low, 0), min(high, len(samples))
        if a < b:
            x[a - low : b - low] = (samples[a:b].astype(np.float32) - 128) / 128
        out[r::up] = np.lib.stride_tricks.sliding_window_view(x, taps)[::down][:n] @ phases[phase][::-1]
    return out


@lru_cache
def _mel_bank(rate: int, window: int, mels: int) -> np.ndarray:
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)
    rise = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    fall = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(rise, fall)).T.astype(np.float32)


def log_mel(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (overlapping by half) and each frame's energy in dB, from blocks of bounded size."""
    g = gcd(rate, RATE_OUT)
    up, down = RATE_OUT // g, rate // g
    total = -(-len(samples) * up // down)
    frames = max(1, 1 + -(-max(0, total - WINDOW) // HOP))
    bank, taper = _mel_bank(RATE_OUT, WINDOW, MELS), np.hanning(WINDOW).astype(np.float32)
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for at in range(0, frames, _BLOCK):
        n = min(_BLOCK, frames - at)
        y = resample(samples, at * HOP, (n - 1) * HOP + WINDOW, up, down)
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(cut * taper, axis=1)).astype(np.float32) ** 2
        mel[at : at + n] = np.log(power @ bank + 1e-6)
        energy[at : at + n] = 10 * np.log10(np.mean(cut * cut, axis=1) + 1e-10)
    return np.round(mel, 3), np.round(energy, 3)


def segments(energy: np.ndarray, start_db: float = START_DB, stop_db: float = STOP_DB) -> list[tuple[float, float]]:
    """Spans in seconds: from a frame start_db over the noise floor (20th percentile) until one falls below stop_db over it."""
    floor = np.percentile(energy, 20)
    mark = np.where(energy >= floor + start_db, 1, np.where(energy < floor + stop_db, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[last] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).view(np.int8)))
    return [(float(a * HOP / RATE_OUT), float(((b - 1) * HOP + WINDOW) / RATE_OUT)) for a, b in edge.reshape(-1, 2)]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors of TENSOR_FRAMES x MELS, each with its span in seconds and its real frames."""
    n = -(-len(mel) // TENSOR_FRAMES)
    whole = np.zeros((n * TENSOR_FRAMES, MELS), np.float32)
    whole[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS))
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), TENSOR_FRAMES * MELS))
    first = np.arange(n) * TENSOR_FRAMES
    real = np.minimum(TENSOR_FRAMES, len(mel) - first)
    batch = pa.record_batch({"log_mel": column, "start_s": first * HOP / RATE_OUT, "end_s": ((first + real - 1) * HOP + WINDOW) / RATE_OUT, "frames": real})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


_FEATURES = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("speech", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("mean_db", pa.float64()), ("tensors", pa.binary())]


def audio_features(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """keep and what each stored recording gives when read back.

    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, n_frames, speech (spans in seconds), mean_db, tensors (an Arrow stream of
    fixed-shape log-mel tensors with their spans). Each recording is worked on alone and in
    blocks, so equal ones give equal values and long ones take no more memory than their
    frames. Recordings must not be null. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = []
            for data in batch.column(column).to_pylist():
                samples, rate = read_wav(data)
                mel, energy = log_mel(samples, rate)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), len(mel), [{"start_s": a, "end_s": b} for a, b in segments(energy)], float(np.mean(energy, dtype=np.float64)), tensors(mel)))
            made = {name: pa.array(x, kind) for (name, kind), x in zip(_FEATURES, zip(*rows))}
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in keep}, **made})

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, speech array<struct<start_s: double, end_s: double>>, mean_db double, tensors binary")


def as_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: every whole text stored as a recording; a null text is an empty one."""
    return docs.select("doc_id", F.octet_length(body()).cast("long").alias("n_bytes"), wav(payload()).alias("media"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = as_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    made = audio_features(media, ["doc_id", "n_bytes"])
    spans = F.size("speech")
    seconds = F.aggregate("speech", F.lit(0.0), lambda s, x: s + x.end_s - x.start_s)
    feature = F.format_string("frames=%d segments=%d speech_s=%.3f mean_db=%.3f log_mel=%s", "n_frames", spans, seconds, "mean_db", F.substring(F.sha2("tensors", 256), 1, 16))
    return made.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
