"""Prosody of PCM16 recordings: loudness, pitch, and how much like a question the end sounds."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_S, HOP_S, TAIL_S = 0.04, 0.01, 0.8
LOW_HZ, HIGH_HZ = 70.0, 400.0
FEATURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("seconds", "rms", "voiced_share", "median_hz", "rise_semitones", "tail_slope", "longest_silence_s")])


def samples_of(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
        return x.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()


def _pitch(frame: np.ndarray, rate: int) -> float:
    """The frame's fundamental by its autocorrelation, 0 if it has no clear one."""
    frame = frame - frame.mean()
    power = np.fft.rfft(frame, 2 * len(frame))
    auto = np.fft.irfft(np.abs(power) ** 2)[: len(frame)]
    low, high = int(rate / HIGH_HZ), min(len(frame) - 1, int(rate / LOW_HZ))
    if auto[0] <= 0 or high <= low:
        return 0.0
    lag = low + int(np.argmax(auto[low:high]))
    return rate / lag if auto[lag] > 0.4 * auto[0] else 0.0


def _features(data: bytes | None) -> tuple[float | None, ...]:
    if data is None:
        return (None,) * len(FEATURES)
    x, rate = samples_of(data)
    size, hop = int(FRAME_S * rate), int(HOP_S * rate)
    if len(x) < size:
        return (len(x) / rate, 0.0, 0.0, None, None, None, len(x) / rate)
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    rms = np.sqrt(np.mean(frames**2, axis=1))
    loud = rms > max(0.01, 0.25 * float(np.percentile(rms, 90)))
    hz = np.array([_pitch(f, rate) if on else 0.0 for f, on in zip(frames, loud)])
    voiced = hz > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~loud, [False]]).view(np.int8))).reshape(-1, 2)
    silence = float(np.max(edge[:, 1] - edge[:, 0], initial=0) * hop / rate)
    share = float(voiced.mean())
    if voiced.sum() < 4:
        return (len(x) / rate, float(np.sqrt(np.mean(x**2))), share, None, None, None, silence)
    at = np.flatnonzero(voiced) * hop / rate
    tones = 12 * np.log2(hz[voiced] / np.median(hz[voiced]))
    tail_at, tail = at[at >= at[-1] - TAIL_S], tones[at >= at[-1] - TAIL_S]
    # A line through the tail: what it gains in a second, and from the tail's first frame to its last.
    slope = float(np.polyfit(tail_at, tail, 1)[0]) if len(tail) > 2 else 0.0
    rise = slope * float(tail_at[-1] - tail_at[0])
    return (len(x) / rate, float(np.sqrt(np.mean(x**2))), share, float(np.median(hz[voiced])), rise, slope, silence)


@F.pandas_udf(FEATURES)
def prosody(recording: pd.Series) -> pd.DataFrame:
    """Loudness, pitch and its movement over the last 0.8 s, the longest silence; a recording at a time."""
    return pd.DataFrame([_features(x) for x in recording], columns=FEATURES.names, dtype="float64")


def question_score(features: Column, confidence: Column) -> Column:
    """A logistic of rise and slope, weighted by confidence; null where there is no pitch."""
    return confidence / (1 + F.exp(-(0.9 * features["rise_semitones"] + 0.25 * features["tail_slope"] - 1.5)))
