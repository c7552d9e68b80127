"""Loudness after ITU-R BS.1770: K-weighting, gated blocks, and a gain to a target that follows what has been heard so far.

A filter of two poles is a linear recurrence: blocks of a stretch of samples run through it side by side from a state of
zero, and the state that each block begins with, carried on by a power of the recurrence's matrix, is added afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import arrow, fold_in_order

TARGET, PEAK_DB, LOOK_AHEAD_MS, STEP = -23.0, -1.0, 10, 512
BLOCK = 256


class Biquad:
    """y = b0 x + b1 x' + b2 x'' - a1 y' - a2 y''; the state is kept from one stretch to the next."""

    def __init__(self, b: tuple[float, float, float], a: tuple[float, float]):
        self.b, self.a = np.array(b), np.array(a)
        self.x, self.y = np.zeros(2), np.zeros(2)  # the last one first
        # what a state (y', y'') turns into after 1..BLOCK samples of silence
        step, powers = np.array([[-a[0], -a[1]], [1.0, 0.0]]), [np.eye(2)]
        for _ in range(BLOCK):
            powers.append(step @ powers[-1])
        self.powers = np.array(powers)

    def run(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        if not n:
            return x
        full = np.concatenate([self.x[::-1], x])
        drive = self.b[0] * full[2:] + self.b[1] * full[1:-1] + self.b[2] * full[:-2]
        blocks = -(-n // BLOCK)
        grid = np.zeros((blocks, BLOCK))
        grid.ravel()[:n] = drive
        last, before = np.zeros(blocks), np.zeros(blocks)
        for k in range(BLOCK):
            grid[:, k] -= self.a[0] * last + self.a[1] * before
            last, before = grid[:, k].copy(), last
        state, states = self.y, np.empty((blocks, 2))
        for k in range(blocks):
            states[k] = state
            state = self.powers[BLOCK] @ state + grid[k, : -3 : -1]
        out = (grid + states @ self.powers[1:, 0].T).ravel()[:n]
        self.x = full[: -3 : -1].copy()
        self.y = np.concatenate([self.y[::-1], out])[: -3 : -1].copy()
        return out


def k_weighting(rate: int) -> tuple[Biquad, Biquad]:
    """The high shelf of a head and the high pass below 38 Hz, for any rate."""
    k = np.tan(np.pi * 1681.974450955533 / rate)
    q, gain = 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    band = gain**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = Biquad(((gain + band * k / q + k * k) / a0, 2 * (k * k - gain) / a0, (gain - band * k / q + k * k) / a0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    return shelf, Biquad((1.0, -2.0, 1.0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0))


def gated(energies: np.ndarray) -> float:
    """Loudness of 400 ms blocks' mean squares: those over -70, then those within 10 of these; -inf if none is left."""
    loud = energies[energies >= 10 ** ((-70 + 0.691) / 10)]
    if len(loud):
        loud = loud[loud >= 0.1 * loud.mean()]
    return float(-0.691 + 10 * np.log10(loud.mean())) if len(loud) else -np.inf


class Meter:
    """Mean squares of K-weighted blocks of four tenths of a second, one each tenth, of samples that come in stretches."""

    def __init__(self, rate: int):
        self.filters, self.hop = k_weighting(rate), rate // 10
        self.rest, self.tenths = np.zeros(0), np.zeros(0)

    def add(self, samples: np.ndarray) -> np.ndarray:
        """The blocks that the samples complete."""
        for f in self.filters:
            samples = f.run(samples)
        full = np.concatenate([self.rest, samples])
        whole = len(full) // self.hop
        self.rest = full[whole * self.hop :]
        tenths = np.concatenate([self.tenths, (full[: whole * self.hop].reshape(whole, self.hop) ** 2).mean(1)])
        self.tenths = tenths[-3:]
        return np.lib.stride_tricks.sliding_window_view(tenths, 4).mean(1) if len(tenths) > 3 else np.zeros(0)


class Normaliser:
    """Samples of one recording, chunk by chunk; the result does not depend on where chunks end.

    Every 512 samples the gain follows the loudness of all samples so far; before the first whole block, and where it is not
    under 0, the gain stays. What is louder than -1 dB then is held there, 10 ms late.
    """

    def __init__(self, rate: int):
        self.meter, self.hop = Meter(rate), rate // 10
        self.blocks, self.used = np.zeros(0), 0
        self.seen, self.gain = 0, 1.0
        self.late = np.zeros(max(1, rate * LOOK_AHEAD_MS // 1000) - 1)

    def push(self, samples: np.ndarray) -> np.ndarray:
        x = np.asarray(samples, float)
        self.blocks = np.concatenate([self.blocks, self.meter.add(x)])
        # a block is heard at the end of the step that completes it, and counts from the step's last sample on
        heard = -(-((np.arange(self.used, len(self.blocks)) + 4) * self.hop) // STEP) * STEP - 1 - self.seen
        gains, at = np.full(len(x), self.gain), 0
        for place in np.unique(heard[heard < len(x)]).tolist():
            gains[at:place], at = self.gain, place
            self.used += int((heard == place).sum())
            loudness = gated(self.blocks[: self.used])
            if np.isfinite(loudness) and loudness < 0:
                self.gain = 10 ** ((TARGET - loudness) / 20)
        gains[at:] = self.gain
        self.seen += len(x)
        limit = 10 ** (PEAK_DB / 20)
        held = np.concatenate([self.late, np.clip(x * gains, -limit, limit)])
        self.late = held[len(x) :]
        return held[: len(x)]


def loudness_of(samples: np.ndarray, rate: int) -> float:
    """Integrated loudness of a mono recording in LUFS."""
    return gated(Meter(rate).add(np.asarray(samples, float)))


@arrow("array<double>")
def normalise_loudness(v: pd.Series, rate: pd.Series) -> pd.Series:
    """Each array of samples as a recording of its own. Null stays null."""
    return pd.Series([None if a is None else Normaliser(int(r)).push(a) for a, r in zip(v, rate)])


@arrow("double")
def integrated_loudness(v: pd.Series, rate: pd.Series) -> pd.Series:
    """LUFS of each array; null where no block is loud enough."""
    found = [None if a is None else loudness_of(a, int(r)) for a, r in zip(v, rate)]
    return pd.Series([x if x is not None and np.isfinite(x) else None for x in found], dtype="float64")


def normalise_chunks(chunks: DataFrame, rate: int, key: str = "recording", order: str = "chunk", samples: str = "samples") -> DataFrame:
    """(key, chunk, samples): the chunks of each recording as ``Normaliser`` gives them, one after the other.

    A recording is read in order by one task, which keeps the filters' state and the blocks' energies, ten a second.
    """
    rows = chunks.select(key, F.col(order).cast("bigint").alias("chunk"), F.col(samples).cast("array<double>").alias("samples")).where("samples is not null and chunk is not null")

    def step(state, row):
        state = state or Normaliser(rate)
        return state, [(row["chunk"], state.push(row["samples"]).tolist())]

    return fold_in_order(rows, [key], ["chunk"], ["chunk", "samples"], step, lambda state: [], "chunk bigint, samples array<double>")
