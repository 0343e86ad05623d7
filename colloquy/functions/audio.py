"""Numeric operators on PCM samples (arrays of float), as numpy functions and Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType

TARGET_RMS, MAX_GAIN = 0.1, 10.0


def rms(a: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(a, dtype=np.float64)))) if len(a) else 0.0


def normalized(a: np.ndarray, target: float = TARGET_RMS, most: float = MAX_GAIN) -> np.ndarray:
    """Boosts quiet audio to the target, never lowers; clipped to -1..1."""
    level = rms(a)
    gain = min(target / level, most) if level > 0 else 1.0
    return a if gain <= 1 else np.clip(a * gain, -1, 1)


def frames(a: np.ndarray, rate: int, ms: int) -> np.ndarray:
    n = max(1, rate * ms // 1000)
    return a[: len(a) // n * n].reshape(-1, n)


def locally_normalized(a: np.ndarray, rate: int, window_ms: int = 500, hop_ms: int = 100, target: float = TARGET_RMS, most: float = MAX_GAIN) -> np.ndarray:
    """Gain by sliding windows, interpolated between their centres."""
    w, hop = rate * window_ms // 1000, rate * hop_ms // 1000
    if len(a) < w:
        return normalized(a, target, most)
    at = np.arange(0, len(a) - w + 1, hop)
    power = np.r_[0, np.cumsum(np.square(a, dtype=np.float64))]
    level = np.sqrt(np.maximum(power[at + w] - power[at], 0) / w)
    gain = np.clip(target / np.maximum(level, 1e-8), 1.0, most)
    return np.clip(a * np.interp(np.arange(len(a)), at + w / 2, gain), -1, 1)


def silence_compressed(a: np.ndarray, rate: int, threshold: float = 0.005, longest: float = 1.0, kept: float = 0.5, ms: int = 20) -> np.ndarray:
    """Silences longer than `longest` seconds are cut to `kept`."""
    f = frames(a, rate, ms)
    if not len(f):
        return a
    quiet = np.sqrt(np.mean(np.square(f, dtype=np.float64), 1)) < threshold
    edges = np.flatnonzero(np.r_[True, quiet[1:] != quiet[:-1], True])
    keep = np.ones(len(f), bool)
    for b, e in zip(edges, edges[1:]):
        if quiet[b] and (e - b) * ms / 1000 > longest:
            keep[b + int(kept * 1000 / ms) : e] = False
    return np.concatenate([f[keep].reshape(-1), a[len(f) * f.shape[1] :]])


def segmental_snr(a: np.ndarray, rate: int = 16000, ms: int = 20) -> float | None:
    """Speech (frames from the 60th percentile) over noise (10th percentile) in dB."""
    f = frames(a, rate, ms)
    if not len(f):
        return None
    level = np.sqrt(np.mean(np.square(f, dtype=np.float64), 1))
    noise, speech = np.percentile(level, 10), level[level >= np.percentile(level, 60)].mean()
    return float(20 * np.log10(max(speech, 1e-10) / max(noise, 1e-10)))


def masked(a: np.ndarray, ranges: list[tuple[float, float]], rate: int, beep: bool = True, hz: float = 1000.0, fade_ms: int = 10) -> np.ndarray:
    """Ranges in seconds replaced by a tone with fades, or by silence."""
    out = np.array(a, np.float32)
    for s, e in ranges:
        i, j = max(0, int(s * rate)), min(len(out), int(e * rate))
        if j > i:
            n = j - i
            tone = 0.3 * np.sin(2 * np.pi * hz * np.arange(n) / rate) if beep else np.zeros(n)
            k = min(fade_ms * rate // 1000, n // 2)
            if beep and k:
                ramp = np.linspace(0, 1, k)
                tone[:k] *= ramp
                tone[-k:] *= ramp[::-1]
            out[i:j] = tone
    return out


def only_speaker(a: np.ndarray, turns: list[tuple[float, float, str]], keep: str, rate: int) -> np.ndarray:
    """Silence over the other speakers' turns."""
    return masked(a, [(s, e) for s, e, who in turns if who != keep], rate, beep=False)


@pandas_udf(ArrayType(FloatType()))
def normalize_gain(samples: pd.Series) -> pd.Series:
    return samples.map(lambda a: normalized(np.asarray(a, np.float32)).astype(np.float32))


@pandas_udf(DoubleType())
def snr(samples: pd.Series) -> pd.Series:
    return samples.map(lambda a: segmental_snr(np.asarray(a, np.float32)))


def spans_of(a: np.ndarray, spans: list[tuple[float, float]], rate: int) -> np.ndarray:
    """The samples of spans in seconds, merged where they touch, in order; cut to the audio."""
    at = sorted((max(0, min(int(b * rate), len(a))), max(0, min(int(e * rate), len(a)))) for b, e in spans)
    keep = np.zeros(len(a) + 1, np.int64)
    for b, e in at:
        if e > b:
            keep[b] += 1
            keep[e] -= 1
    return a[np.cumsum(keep)[:-1] > 0]


def speaker_audio(a: np.ndarray, spans: list[tuple[float, float]], rate: int, least: float = 0.5) -> np.ndarray | None:
    """A speaker's audio, None under `least` seconds."""
    out = spans_of(a, spans, rate)
    return out if len(out) >= int(least * rate) else None


def without_duplicates(a: np.ndarray, rate: int, seconds: float = 2.5, ahead: int = 3, alike: float = 0.95, quiet: float = 0.005) -> np.ndarray:
    """Windows that repeat one of the few before them are cut out: their cross-correlation at the best shift, over both norms, is above `alike`.
    Quiet windows neither repeat nor are repeated, nor does one that is cut out itself."""
    n = int(seconds * rate)
    if len(a) < 2 * n:
        return a
    w = a[: len(a) // n * n].reshape(-1, n).astype(np.float64)
    norm = np.linalg.norm(w, axis=1)
    loud = (norm / np.sqrt(n) >= quiet) & (norm >= 1e-10)
    size = 1 << (2 * n - 1).bit_length()
    waves = np.fft.rfft(w, size, axis=1)
    gone = np.zeros(len(w), bool)
    for i in np.flatnonzero(loud):
        for j in range(i + 1, min(i + ahead + 1, len(w))) if not gone[i] else ():
            if loud[j] and not gone[j]:
                best = np.fft.irfft(waves[i] * np.conj(waves[j]), size).max() / (norm[i] * norm[j])
                gone[j] = best > alike
    return np.concatenate([w_ for w_, g in zip(a[: len(gone) * n].reshape(-1, n), gone) if not g] + [a[len(gone) * n :]])


def reassembled(pieces: list[tuple[float, np.ndarray]], seconds: float, rate: int) -> np.ndarray:
    """Pieces on a silent timeline at their starts in seconds; later ones lie over earlier ones, what reaches beyond the end is cut."""
    out = np.zeros(int(seconds * rate), np.float32)
    for start, p in pieces:
        b = max(0, int(start * rate))
        out[b : b + len(p)] = p[: max(0, len(out) - b)]
    return out
