"""Resampling by a polyphase filter bank: of whole arrays, and of long audio in chunks that know their neighbours' edges.

An output lies between input samples at one of ``target / gcd`` phases; each phase has its own windowed-sinc filter. An
output needs only the samples within ``half`` filter widths, so chunks that carry so many of their neighbours' samples give
the very outputs that the whole gives, in bounded memory and without a seam.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.arrow import arrow

#: Most phases whose filters are held as a table, and outputs that are worked out at once.
MOST_PHASES, OUTPUTS = 2048, 4096


def quality(source: int, target: int) -> int:
    """Filter length by ratio: longer for large steps up and down, which alias more."""
    ratio = target / source
    return 512 if ratio >= 2 or ratio <= 0.5 else 256 if 1 < ratio < 1.5 else 384


def bell(kind: str, x: np.ndarray) -> np.ndarray:
    """A window over -1..1, zero outside."""
    if kind == "hann":
        w = 0.5 + 0.5 * np.cos(np.pi * x)
    else:  # Blackman-Harris, squared
        w = (0.35875 + 0.48829 * np.cos(np.pi * x) + 0.14128 * np.cos(2 * np.pi * x) + 0.01168 * np.cos(3 * np.pi * x)) ** 2
    return np.where(np.abs(x) <= 1, w, 0)


class Filter:
    """From one rate to another. ``half`` is the reach of the filter to either side in samples of the lower rate."""

    def __init__(self, source: int, target: int, half: float, cutoff: float, kind: str):
        if source <= 0 or target <= 0:
            raise ValueError("rates are above 0")
        common = math.gcd(source, target)
        self.up, self.down = target // common, source // common
        self.cut = min(1.0, target / source) * cutoff
        self.width = half / min(1.0, target / source)
        self.kind, self.reach = kind, math.ceil(self.width) + 1
        self.table = self.weights(np.arange(self.up) / self.up) if self.up <= MOST_PHASES else None

    def weights(self, offset: np.ndarray) -> np.ndarray:
        """Filters for outputs that lie ``offset`` (below 1) behind an input sample."""
        k = np.arange(-self.reach + 1, self.reach + 1)[None] - offset[:, None]
        return np.sinc(k * self.cut) * self.cut * bell(self.kind, k / self.width)

    def count(self, samples: int) -> int:
        """Outputs that belong to the first ``samples`` inputs."""
        return -(-samples * self.up // self.down)

    def outputs(self, x: np.ndarray, start: int, first: int, end: int) -> np.ndarray:
        """Outputs first..end, from the samples ``x`` of which the first is number ``start``; others count as 0."""
        out = np.empty(end - first)
        padded = np.concatenate([np.zeros(2 * self.reach), x, np.zeros(2 * self.reach)])
        view = np.lib.stride_tricks.sliding_window_view(padded, 2 * self.reach)
        for a in range(first, end, OUTPUTS):
            i = np.arange(a, min(a + OUTPUTS, end), dtype=np.int64)
            at, phase = np.divmod(i * self.down, self.up)
            filters = self.table[phase] if self.table is not None else self.weights(phase / self.up)
            out[a - first : a - first + len(i)] = np.einsum("ij,ij->i", view[at - start + self.reach + 1], filters)
        return out


@functools.lru_cache(8)
def filter_of(source: int, target: int, half: float | None = None, cutoff: float = 0.95, kind: str = "blackman") -> Filter:
    return Filter(source, target, quality(source, target) / 2 if half is None else half, cutoff, kind)


def whole(a, source: int, target: int, **how) -> np.ndarray:
    x = np.asarray(a, float)
    if not len(x) or source == target:
        return x
    f = filter_of(int(source), int(target), **how)
    return f.outputs(x, 0, 0, f.count(len(x)))


@arrow("array<double>")
def resample_best(v: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    """Arrays of samples from one rate to another, with a filter as long as the ratio asks for. Null stays null."""
    return pd.Series([None if a is None else whole(a, s, t) for a, s, t in zip(v, source, target)])


def resample_chunks(chunks: DataFrame, source: int, target: int, key: str = "recording", order: str = "chunk", samples: str = "samples") -> DataFrame:
    """(key, order, first, samples): each chunk's outputs, and the number of its first output in the recording.

    The result is the resampled whole, cut where the chunks are. Chunks but a recording's last hold at least as many
    samples as the filter reaches, else the query stops; a null chunk counts as empty.
    """
    reach = 0 if source == target else 2 * filter_of(source, target).reach
    by = Window.partitionBy(key).orderBy(order)
    rows = chunks.select(key, order, F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")).alias("x")).withColumn("n", F.size("x").cast("bigint"))
    start = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nothing = F.array().cast("array<double>")
    tail: Column = F.slice("x", F.greatest(F.lit(1), F.size("x") - reach + 1), F.lit(max(reach, 1)))
    near = rows.select(key, order, "x", "n", start.alias("start"), F.coalesce(F.lag(tail).over(by), nothing).alias("before"), F.coalesce(F.lead(F.slice("x", F.lit(1), F.lit(max(reach, 1)))).over(by), nothing).alias("after"), F.lead("n").over(by).isNull().alias("last"))
    checked = F.when(~F.col("last") & (F.col("n") < reach), F.raise_error(F.lit(f"a chunk of fewer than {reach} samples")).cast("array<double>")).otherwise(F.col("x"))

    @arrow("struct<first:bigint,samples:array<double>>")
    def one(x: pd.Series, start: pd.Series, before: pd.Series, after: pd.Series) -> pd.DataFrame:
        if source == target:
            return pd.DataFrame({"first": start, "samples": x})
        f, firsts, outs = filter_of(source, target), [], []
        for a, s, b, c in zip(x, start, before, after):
            first, end = f.count(s), f.count(s + len(a))
            firsts.append(first)
            outs.append(f.outputs(np.concatenate([b, a, c]), s - len(b), first, end))
        return pd.DataFrame({"first": firsts, "samples": outs})

    return near.select(key, order, one(checked, "start", "before", "after").alias("r")).select(key, order, "r.first", "r.samples")
