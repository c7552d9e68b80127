"""Signal processing that is recursive or spectral: Arrow functions over arrays of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import arrow
from colloquy.functions.loudness import Biquad


@arrow("binary")
def to_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda a: None if a is None else np.asarray(a, "<f4").tobytes())


@arrow("array<float>")
def from_blob(v: pd.Series) -> pd.Series:
    return v.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


@arrow("array<double>")
def high_pass(v: pd.Series) -> pd.Series:
    """One-pole high pass at 80 Hz of 16 kHz samples."""
    rc, dt = 1 / (2 * np.pi * 80), 1 / 16000
    alpha = rc / (rc + dt)
    return v.map(lambda a: np.round(Biquad((alpha, -alpha, 0.0), (-alpha, 0.0)).run(np.asarray(a, float)), 6))


@arrow("array<double>")
def normalise(v: pd.Series) -> pd.Series:
    """Gain to 0.9 RMS or 0.95 peak, at least 1.5, with a soft limit above 0.95."""

    def one(a):
        x = np.asarray(a, float)
        r, p = np.sqrt((x**2).mean()) if len(x) else 0, np.abs(x).max(initial=0)
        if not r or not p:
            return x
        y = x * max(1.5, min(0.9 / r, 0.95 / p))
        return np.round(np.where(np.abs(y) > 0.95, np.sign(y) * (0.95 + 0.05 * np.tanh((np.abs(y) - 0.95) / 0.05)), y), 6)

    return v.map(one)


@arrow("array<double>")
def spectral_subtraction(v: pd.Series) -> pd.Series:
    """Gain sqrt(max(0, 1 - d / |Y|**2)) with the mean power d of the quietest tenth of the bins as noise."""

    def one(a):
        y = np.fft.rfft(np.asarray(a, float))
        power = np.abs(y) ** 2
        noise = np.sort(power)[: max(1, len(power) // 10)].mean()
        return np.round(np.fft.irfft(y * np.sqrt(np.maximum(0, 1 - noise / np.maximum(power, 1e-12))), len(a)), 6)

    return v.map(one)


def mel(f):
    return 1127.0 * np.log1p(np.asarray(f, float) / 700.0)


@arrow("array<array<double>>")
def filterbank(v: pd.Series) -> pd.Series:
    """80 log-mel bands of 25 ms frames every 10 ms at 16 kHz: samples of -1 to 1 scaled to 16 bits, so that quiet bands stay
    above the least energy that is told apart, pre-emphasis 0.97, Hamming window, mean removed. Null stays null."""
    edges = np.linspace(mel(20), mel(8000), 82)
    bins = mel(np.arange(257) * 16000 / 512)
    up, down = (bins[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - bins[None]) / (edges[2:] - edges[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))

    def one(a):
        if a is None:
            return None
        x = np.asarray(a, float) * 32768
        n = 1 + (len(x) - 400) // 160 if len(x) >= 400 else 0
        if not n:
            return []
        frames = np.stack([x[i * 160 : i * 160 + 400] for i in range(n)])
        frames = frames - frames.mean(1, keepdims=True)
        frames = np.concatenate([frames[:, :1] * 0.03, frames[:, 1:] - 0.97 * frames[:, :-1]], 1) * np.hamming(400)
        out = np.log(np.maximum(np.abs(np.fft.rfft(frames, 512)) ** 2 @ bank.T, 1.1920929e-07))
        return list(out - out.mean(0))

    return v.map(one)


@arrow("array<double>")
def resample(v: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """Windowed-sinc resampling from one rate to another."""

    def one(a, s, t):
        x = np.asarray(a, float)
        n = int(np.ceil(len(x) * t / s))
        if not len(x) or s == t:
            return x
        cut = min(1.0, t / s)
        at = np.arange(n)[:, None] * s / t
        k = np.arange(len(x))[None] - at
        w = np.where(np.abs(k) <= 16 / cut, 0.5 + 0.5 * np.cos(np.pi * k * cut / 16), 0)
        return (np.sinc(k * cut) * cut * w) @ x

    return pd.Series([one(*r) for r in zip(v, source, target)])


def quiet_cuts(x: np.ndarray, rate: int, most_s: float, around_s: float, loud: float = 0.02) -> list[int]:
    """Where to cut: the quietest tenth of a second within ``around_s`` of each ``most_s``; a second later if it is loud."""
    cuts, start, most, frame, hop = [], 0, int(most_s * rate), max(1, rate // 10), max(1, rate // 100)
    while len(x) - start > most:
        low, high = max(start + frame, start + most - int(around_s * rate)), min(len(x) - frame, start + most + int(around_s * rate))
        places = np.arange(low, max(low + 1, high), hop)
        level = np.array([np.sqrt((x[p : p + frame] ** 2).mean()) for p in places])
        best = int(level.argmin())
        cut = int(places[best]) + frame // 2
        if level[best] > loud:
            cut = min(cut + rate, len(x))
        if cut >= len(x):
            break
        cuts.append(cut)
        start = cut
    return cuts


def split_at_silence(rows: DataFrame, key: str, column: str, sample_rate: int, most_s: float, around_s: float = 3.0) -> DataFrame:
    def run(parts):
        for pdf in parts:
            out = []
            for k, a in zip(pdf[key], pdf[column]):
                x = np.asarray(a, float)
                edges = [0, *quiet_cuts(x, sample_rate, most_s, around_s), len(x)]
                out += [(k, i, s, e) for i, (s, e) in enumerate(zip(edges, edges[1:]))]
            yield pd.DataFrame(out, columns=[key, "part", "first_sample", "end_sample"])

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, part int, first_sample int, end_sample int")
