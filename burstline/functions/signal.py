"""Functions of sample arrays, as higher-order functions, and spectra as Arrow-batched numpy kernels."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rms(x: Column) -> Column:
    """Root of the mean square; 0 for no samples."""
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x))).otherwise(0.0)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def from_pcm(x: Column, bits: int = 16) -> Column:
    """Integer samples brought to [-1, 1]: divided by the largest positive one; the lowest integer is held at -1."""
    top = float((1 << (bits - 1)) - 1)
    return F.transform(x, lambda v: F.greatest(v / F.lit(top), F.lit(-1.0)))


def blended_peak(x: Column) -> Column:
    """A level between noise and transients: six tenths of the root mean square, four of the peak."""
    return 0.6 * rms(x) + 0.4 * peak(x)


def crest(amplitude: Column, level: Column) -> Column:
    return amplitude / (level + 0.001)


def energy_concentration(x: Column) -> Column:
    """The share of all energy in the tenth (one sample at least) of largest magnitude."""
    squares = F.reverse(F.array_sort(F.transform(x, lambda v: v * v)))
    total = F.aggregate(squares, F.lit(0.0), lambda a, v: a + v)
    k = F.greatest(F.floor(F.size(x) / 10), F.lit(1)).cast("int")
    return F.when(total > 0, F.aggregate(F.slice(squares, F.lit(1), k), F.lit(0.0), lambda a, v: a + v) / total).otherwise(0.0)


def zero_crossing_rate(x: Column) -> Column:
    """Sign changes between neighbours, by the number of samples."""
    pairs = F.zip_with(F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, 2, F.greatest(F.size(x), F.lit(1))), lambda a, b: (a >= 0) != (b >= 0))
    return F.when(F.size(x) > 0, F.size(F.filter(pairs, lambda c: c)) / F.size(x)).otherwise(0.0)


def _argmax(x: Column) -> Column:
    """Index, from 0, of the first largest magnitude."""
    size = F.transform(x, lambda v: F.abs(v))
    return (F.array_position(size, F.array_max(size)) - 1).cast("int")


def attack_time(x: Column, rate: float) -> Column:
    """Seconds from the first sample of a tenth of the peak, in the 100 before it, to the peak; 1 for ten samples or fewer."""
    at = _argmax(x)
    limit = 0.1 * F.array_max(F.transform(x, lambda v: F.abs(v)))
    begin = F.greatest(at - 100, F.lit(0))
    marks = F.filter(F.transform(x, lambda v, i: F.when((i >= begin) & (i < at) & (F.abs(v) >= limit), i)), lambda i: i.isNotNull())
    return F.when(F.size(x) <= 10, F.lit(1.0)).otherwise((at - F.coalesce(F.try_element_at(marks, F.lit(1)), F.lit(0))) / F.lit(float(rate)))


def event_duration(x: Column, rate: float) -> Column:
    """Seconds from where the sound exceeds a tenth of its peak, going back, to where it falls under a twentieth; 0 for ten samples or fewer."""
    at = _argmax(x)
    top = F.array_max(F.transform(x, lambda v: F.abs(v)))
    quiet = F.array_max(F.transform(x, lambda v, i: F.when((i < at) & (F.abs(v) < 0.1 * top), i)))
    still = F.array_min(F.transform(x, lambda v, i: F.when((i > at) & (F.abs(v) < 0.05 * top), i)))
    begin = F.coalesce(quiet, F.lit(0))
    end = F.coalesce(still, F.size(x) - 1)
    return F.when(F.size(x) <= 10, F.lit(0.0)).otherwise((end - begin) / F.lit(float(rate)))


def parabolic_offset(x: Column) -> Column:
    """Where between samples the peak lies, in samples from the largest: a parabola through it and its neighbours."""
    at = _argmax(x)
    y = lambda d: F.abs(F.try_element_at(x, at + 1 + d))
    inner = (at > 0) & (at < F.size(x) - 1)
    return at + F.when(inner, (y(-1) - y(1)) / (2 * (y(-1) - 2 * y(0) + y(1)) + 1e-4)).otherwise(0.0)


def sub_window_max(x: Column) -> Column:
    """The largest 0.8 * peak + 0.2 * rms over windows of min(256, n / 8) samples, each a quarter on; the peak if that is under 0.1."""
    width = F.greatest(F.least(F.lit(256), F.floor(F.size(x) / 8).cast("int")), F.lit(1))
    step = F.greatest(F.floor(width / 4).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(F.size(x) - width, F.lit(0)), step)
    best = F.array_max(F.transform(starts, lambda i: 0.8 * peak(F.slice(x, i + 1, width)) + 0.2 * rms(F.slice(x, i + 1, width))))
    return F.when(best < 0.1, peak(x)).otherwise(best)


def sliding_windows(x: Column, width: int, hop: int) -> Column:
    """All whole windows of ``width`` samples, each ``hop`` on."""
    starts = F.when(F.size(x) >= width, F.sequence(F.lit(0), F.size(x) - width, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(x, i + 1, width))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def log_gaussian(x: Column, mean: Column, variance: Column) -> Column:
    """Log-density of a Gaussian with a diagonal covariance."""
    terms = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), variance, lambda d, v: -0.5 * (F.log(2 * np.pi * v) + d / v))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mel(hz: Column) -> Column:
    """The mel scale's pitch of a frequency."""
    return 2595 * F.log10(1 + hz / 700)


def hz_of_mel(pitch: Column) -> Column:
    """The frequency of a pitch on the mel scale."""
    return 700 * (F.pow(F.lit(10.0), pitch / 2595) - 1)


@lru_cache(maxsize=16)
def mel_filters(bins: int, rate: float, count: int = 26) -> np.ndarray:
    """Triangles over spectrum bins, evenly spaced in mel between 0 and half the rate."""
    to_hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), count + 2))
    at = np.floor((2 * bins + 1) * edges / rate).astype(int)
    k = np.arange(bins)
    out = np.zeros((count, bins))
    for i in range(count):
        a, b, c = at[i : i + 3]
        up = (k - a) / max(b - a, 1)
        down = (c - k) / max(c - b, 1)
        out[i] = np.where((k >= a) & (k < b), up, np.where((k >= b) & (k < c), down, 0.0))
    return out


SPECTRUM = "struct<dominant:double,centroid:double,rolloff:double,energy_primary:double,energy_wide:double,energy_low:double,contrast:double,flux:double,ratio:double,mfcc:array<double>,mfcc_variance:double>"
#: Samples that a spectrum reads at most, and needs at least.
MOST_SAMPLES = 2048
LEAST_SAMPLES = 256
#: Height of the normalised Hann window. Fixed value.
HANN_NORM = 0.8165


def next_power_of_two(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def spectra(samples: np.ndarray, rate: float, strict: bool = True) -> pd.DataFrame:
    """``SPECTRUM`` fields of each row of equally long samples.

    A spectrum has min(2048, next power of two) points: longer samples are cut, shorter ones padded
    with zeros. Bins hold magnitudes under a normalised Hann window; bands are half-open ranges of
    bins. With ``strict``, samples are spaced by zeros before the transform, and its first bin holds
    the highest frequency too, so frequencies read half of true.
    """
    rows, count = samples.shape
    if count < LEAST_SAMPLES:
        zero = {c.split(":")[0]: 0.0 for c in SPECTRUM[7:-1].split(",") if "mfcc" not in c}
        return pd.DataFrame([{**zero, "mfcc": [0.0] * 13, "mfcc_variance": 0.0}] * rows)
    n = min(MOST_SAMPLES, next_power_of_two(count))
    half = n // 2
    padded = np.zeros((rows, n))
    padded[:, : min(count, n)] = samples[:, :n]
    windowed = padded * (HANN_NORM * (1 - np.cos(2 * np.pi * np.arange(n) / n)))
    if strict:
        spaced = np.zeros((rows, n))
        spaced[:, ::2] = windowed[:, :half]
        windowed = spaced
    found = np.abs(np.fft.rfft(windowed, axis=1))
    power = 2 * found[:, :half]
    if strict:
        power[:, 0] = 2 * np.hypot(found[:, 0], found[:, half])

    def band(low: float, high: float) -> np.ndarray:
        return power[:, min(half, int(low * n / rate)) : min(half, int(high * n / rate))]

    mean = lambda p: p.mean(axis=1) if p.shape[1] else np.zeros(rows)
    main, wide, low = band(1000, 3000), band(300, 5000), band(200, 500)
    total = power.sum(axis=1)
    some = np.where(total > 0, total, 1.0)
    place = lambda p, start: np.where(p.max(axis=1, initial=0) > 0, (p.argmax(axis=1) if p.shape[1] else 0) + min(half, int(start * n / rate)), 0)
    dominant = np.where(main.max(axis=1, initial=0) > 0, place(main, 1000), place(wide, 300))
    hz = np.arange(half) * rate / n
    reached = np.cumsum(power, axis=1) >= 0.85 * total[:, None]
    logs = np.log(np.maximum(power @ mel_filters(half, rate).T, 1e-10))
    m = logs.shape[1]
    mfcc = logs @ np.cos(np.pi * np.outer(np.arange(m) + 0.5, np.arange(13)) / m)
    return pd.DataFrame(
        {
            "dominant": dominant * rate / n,
            "centroid": (power @ hz) / some,
            "rolloff": np.where(reached.any(axis=1), hz[reached.argmax(axis=1)], 0.0),
            "energy_primary": mean(main),
            "energy_wide": mean(wide),
            "energy_low": mean(low),
            "contrast": np.maximum(0.0, mean(main) - mean(low)),
            "flux": np.sqrt((np.diff(power, axis=1) ** 2).sum(axis=1)) / half,
            "ratio": main.sum(axis=1) / some,
            "mfcc": list(mfcc),
            "mfcc_variance": mfcc.var(axis=1),
        }
    )


def spectrum(rate: float, strict: bool = True):
    """An Arrow-batched function of a sample array to its spectral features (``SPECTRUM``); fewer than 256 samples, or null, give zeros.

    Samples of equal length are transformed together.
    """

    @F.pandas_udf(SPECTRUM)
    def run(samples: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(x if x is not None else [], dtype=float)[:MOST_SAMPLES] for x in samples]
        lengths = np.array([len(x) for x in arrays], dtype=int)
        parts = []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            part = spectra(np.stack([arrays[i] for i in at]), rate, strict)
            parts.append(part.set_axis(at, axis=0))
        return pd.concat(parts).sort_index() if parts else spectra(np.zeros((0, 0)), rate, strict).reindex(columns=[c.split(":")[0] for c in SPECTRUM[7:-1].split(",")])

    return run


def feature_vector(spectrum: Column, attack: Column, duration: Column, crest_factor: Column) -> Column:
    """The 23 numbers that a classifier reads: 13 coefficients, then centroid, rolloff, contrast, flux, zero crossings (0), ratio, dominant, attack, duration, crest."""
    rest = [spectrum[c] for c in ("centroid", "rolloff", "contrast", "flux")] + [F.lit(0.0)] + [spectrum[c] for c in ("ratio", "dominant")] + [attack, duration, crest_factor]
    return F.concat(spectrum["mfcc"], F.array(*(x.cast("double") for x in rest)))


def band_powers(samples: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Of each row of equally long samples: root mean square magnitude of its Hann spectrum from ``low`` to ``high``, by 100, 1 at most."""
    rows, count = samples.shape
    if not count:
        return np.zeros(rows)
    hz = np.arange(count // 2 + 1) * rate / count
    inside = np.abs(np.fft.rfft(samples * np.hanning(count), axis=1))[:, (hz >= low) & (hz <= high)]
    return np.minimum(np.sqrt((inside**2).mean(axis=1)) / 100, 1.0) if inside.shape[1] else np.zeros(rows)


def band_power(rate: float, low: float = 500.0, high: float = 4000.0):
    """An Arrow-batched function of a sample array to its ``band_powers``; null or no samples give 0. Equal lengths are transformed together."""

    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        arrays = [np.asarray(x if x is not None else [], dtype=float) for x in samples]
        lengths = np.array([len(x) for x in arrays], dtype=int)
        out = np.zeros(len(arrays))
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            out[at] = band_powers(np.stack([arrays[i] for i in at]), rate, low, high)
        return pd.Series(out)

    return run
