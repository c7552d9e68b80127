"""Array arithmetic on samples with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """Halves away from zero of the number times a power of ten, as SQL engines and C do it; a
    negative number that rounds to nothing is -0.0. ``F.round`` rounds the digits that are printed instead, to 0.0 there."""
    scaled = x * float(10**places)
    out = F.round(F.abs(scaled)) * F.signum(scaled) / float(10**places)
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rms(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(F.sqrt(total(F.transform(a, lambda x: x * x)) / F.size(a)))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def mono(a: Column, channels: int) -> Column:
    """Mean of the first two channels of interleaved samples."""
    used = min(2, channels)
    frames = F.sequence(F.lit(0), (F.size(a) / channels).cast("int") - 1)
    return F.transform(frames, lambda i: sum((F.element_at(a, (i * channels + c + 1).cast("int")) for c in range(1, used)), F.element_at(a, (i * channels + 1).cast("int"))) / used)


def mix(a: Column, b: Column) -> Column:
    """Sums by position, what is missing is silence; beyond full scale, full scale."""
    return F.transform(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))), lambda x: F.when(F.abs(x) > 1, F.signum(x)).otherwise(x))


def duck(voice: Column, system: Column, threshold: float = 0.01, gain: float = 0.3) -> Column:
    factor = F.when(rms(voice) > threshold, gain).otherwise(1.0)
    return F.zip_with(voice, system, lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * factor)))


def dynamic_mix(a: Column, b: Column) -> Column:
    """Weights by loudness, between a tenth and nine tenths."""
    share = F.least(F.lit(0.9), F.greatest(F.lit(0.1), rms(a) / (rms(a) + rms(b))))
    return F.zip_with(a, b, lambda x, y: x * share + y * (1 - share))


def peak_normalise(a: Column, limit: float = 1.0) -> Column:
    finite = F.transform(a, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return F.when(peak(finite) > limit, F.transform(finite, lambda x: x / peak(finite))).otherwise(finite)


def louder_channel(a: Column, b: Column) -> Column:
    e, f = total(F.transform(a, F.abs)), total(F.transform(b, F.abs))
    return F.when(e > 1.1 * f, "0").when(f > 1.1 * e, "1").otherwise("?")


def any_time(text: Column) -> Column:
    """A time in any of the known text formats; null for others."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")])
