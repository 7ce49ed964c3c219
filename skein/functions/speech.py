"""Where somebody speaks in a recording, by its energy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import functions as F

from skein.functions.prosody import samples_of

FRAME_S, LEAST_S, MOST_S, GAP_S, PAD_S = 0.03, 0.45, 25.0, 0.55, 0.15
#: A frame is loud over the largest of these: times the noise, times the peak, and as such (16-bit units).
OVER_NOISE, OVER_PEAK, OVER_ZERO = 2.5, 0.08, 100.0


def segments(x: np.ndarray, rate: int) -> list[tuple[float, float]]:
    """(start, end) in seconds of each stretch of speech in 16-bit samples.

    The noise is the 20th percentile of the frames' energies. Loud frames with up to GAP_S of quiet
    between them are one stretch; PAD_S goes on either side, what is then shorter than LEAST_S goes, and what is
    longer than MOST_S is cut.
    """
    size = max(1, round(rate * FRAME_S))
    if not len(x):
        return []
    starts = np.arange(0, len(x), size)
    lengths = np.minimum(size, len(x) - starts)
    energy = np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts) / lengths)
    noise = np.sort(energy)[max(0, int(len(energy) * 0.2) - 1)]
    loud = np.flatnonzero(energy >= max(noise * OVER_NOISE, energy.max() * OVER_PEAK, OVER_ZERO))
    if not len(loud):
        return []
    apart = np.flatnonzero(np.diff(loud) > max(1, round(GAP_S / FRAME_S)))
    found = []
    for first, last in zip(loud[np.r_[0, apart + 1]], loud[np.r_[apart, len(loud) - 1]]):
        start, end = max(0.0, first * FRAME_S - PAD_S), min(len(x) / rate, (last + 1) * FRAME_S + PAD_S)
        cuts = int(max(0.0, np.ceil((end - start) / MOST_S) - 1))
        found += [(start + i * MOST_S, start + (i + 1) * MOST_S) for i in range(cuts)]
        if end - start - cuts * MOST_S >= LEAST_S:
            found.append((float(start + cuts * MOST_S), float(end)))
    return found


def parts_of(recording: bytes) -> list[tuple[int, float, float]]:
    """(part, start, end) of each stretch of speech of a PCM16 recording (WAV)."""
    x, rate = samples_of(recording)
    return [(part, start, end) for part, (start, end) in enumerate(segments(x * 32768.0, rate))]


@F.udtf(returnType="part: int, start_s: double, end_s: double", useArrow=True)
class SpeechSegments:
    """A row for each stretch of speech of a PCM16 recording (WAV); none of a null."""

    def eval(self, recording: bytes) -> Iterator[tuple[int, float, float]]:
        if recording is None:
            return
        yield from parts_of(bytes(recording))
