"""Values of the signal functions: loudness, resampling, filters, denoising, filterbank, cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import loudness as L
from colloquy.functions import resampling as R
from colloquy.functions import signal as S

RATE = 48_000


def sine(hz, db, seconds, rate=RATE):
    return 10 ** (db / 20) * np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate)


@pytest.mark.parametrize("rate, db", [(48_000, -20), (44_100, -20), (16_000, -30), (48_000, -40)])
def test_loudness_of_a_tone(rate, db):
    """A mono tone of 997 Hz has its level less 3.01 LU."""
    assert abs(L.loudness_of(sine(997, db, 5, rate), rate) - (db - 3.01)) < 0.06


def test_gates():
    tone = sine(997, -20, 10)
    quiet = L.loudness_of(np.concatenate([tone, np.zeros(RATE * 20)]), RATE)
    assert abs(quiet + 23.01) < 0.2  # silence is gated away
    assert abs(L.loudness_of(np.concatenate([tone, sine(997, -45, 20)]), RATE) + 23.01) < 0.2  # so is what is 10 LU below
    assert L.loudness_of(np.zeros(RATE), RATE) == L.loudness_of(tone[:1000], RATE) == -np.inf


@pytest.mark.parametrize("db", [-35, -12])
def test_reaches_the_target(db):
    out = L.Normaliser(RATE).push(sine(997, db, 10))
    assert abs(L.loudness_of(out[RATE:], RATE) + 23) < 0.1


def test_chunks_do_not_matter_and_peaks_are_held():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.01, RATE * 2), rng.normal(0, 0.3, RATE), np.zeros(700), rng.normal(0, 0.02, RATE)])
    whole = L.Normaliser(RATE).push(x)
    for most in (1, 600, 50_000):
        n, parts, at = L.Normaliser(RATE), [], 0
        cut = x if most > 1 else x[: RATE // 2 + 40]
        while at < len(cut):
            size = int(rng.integers(1, most + 1)) if most > 1 else 97
            parts.append(n.push(cut[at : at + size]))
            at += size
        assert np.abs(np.concatenate(parts) - whole[: len(cut)]).max() < 1e-12
    limit = 10 ** (-1 / 20)
    assert np.abs(whole).max() == pytest.approx(limit) and (whole[:479] == 0).all()


def by_step(x, rate):
    """The gain's rule sample by sample, measured anew at every step."""
    gain, out, late = 1.0, [], [0.0] * (rate // 100 - 1)
    for i, s in enumerate(x):
        if (i + 1) % 512 == 0:
            loud = L.loudness_of(x[: i + 1], rate)
            if np.isfinite(loud) and loud < 0:
                gain = 10 ** ((-23 - loud) / 20)
        late.append(float(np.clip(s * gain, -(10**-0.05), 10**-0.05)))
        out.append(late.pop(0))
    return np.array(out)


def test_gain_follows_each_step():
    x = np.random.default_rng(3).normal(0, 0.05, 9_000) * np.linspace(0.1, 2, 9_000)
    assert np.abs(L.Normaliser(8_000).push(x) - by_step(x, 8_000)).max() < 1e-9


def test_biquad_is_the_recurrence():
    x = np.random.default_rng(0).normal(size=1000)
    b, want, p, q = L.Biquad((1, 0.5, 0.2), (-1.2, 0.5)), [], (0, 0), (0, 0)
    for v in x:
        o = v + 0.5 * q[0] + 0.2 * q[1] + 1.2 * p[0] - 0.5 * p[1]
        p, q = (o, p[0]), (v, q[0])
        want.append(o)
    assert np.abs(np.concatenate([b.run(x[:1]), b.run(x[1:300]), b.run(x[:0]), b.run(x[300:])]) - want).max() < 1e-12


def test_loudness_columns(spark):
    rows = spark.createDataFrame([(1, sine(997, -30, 2, 16_000).tolist(), 16_000), (2, None, 16_000), (3, [], 16_000)], "k int, x array<double>, r int")
    got = {r["k"]: (r["l"], r["n"]) for r in rows.select("k", L.integrated_loudness("x", "r").alias("l"), L.normalise_loudness("x", "r").alias("n")).collect()}
    assert abs(got[1][0] + 33.0) < 0.1 and got[2] == (None, None) and got[3] == (None, [])
    x = sine(300, -30, 3, 16_000)
    chunks = spark.createDataFrame([("a", k, x[k * 7000 : (k + 1) * 7000].tolist()) for k in range(7)], "recording string, chunk int, samples array<double>")
    out = L.normalise_chunks(chunks, 16_000).orderBy("chunk").collect()
    assert np.abs(np.concatenate([r["samples"] for r in out]) - L.Normaliser(16_000).push(x)).max() < 1e-12


@pytest.mark.parametrize("source, target", [(48_000, 16_000), (44_100, 48_000), (8_000, 16_000), (16_000, 44_100), (16_000, 15_999), (24_000, 32_000)])
def test_tones_pass_and_do_not_alias(source, target):
    n = source if target != 15_999 else source // 4
    y = R.whole(np.sin(2 * np.pi * 440 * np.arange(n) / source), source, target)
    want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / target)
    edge = 600
    assert len(y) == -(-n * target // source) and np.abs((y - want)[edge:-edge]).max() < 1e-6
    if target < source * 0.6:
        assert np.abs(R.whole(np.sin(2 * np.pi * 0.45 * source * np.arange(n) / source), source, target)[edge:-edge]).max() < 1e-6


def test_quality_by_ratio():
    assert [R.quality(*r) for r in ((8, 16), (10, 16), (10, 12), (16, 12), (48, 16), (16, 8))] == [512, 384, 256, 384, 512, 512]


@pytest.mark.parametrize("source, target", [(48_000, 16_000), (16_000, 44_100), (8_000, 8_000)])
def test_chunks_join_without_a_seam(spark, source, target):
    x = np.random.default_rng(2).normal(size=12_345)
    cuts = [0, 2_500, 5_000, 9_000, 12_300, 12_345]
    rows = [("a", k, x[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [("b", 0, [1.0, 2.0]), ("c", 0, None)]
    out = R.resample_chunks(spark.createDataFrame(rows, "recording string, chunk int, samples array<double>"), source, target).orderBy("recording", "chunk").collect()
    a = [r for r in out if r["recording"] == "a"]
    assert np.abs(np.concatenate([r["samples"] for r in a]) - R.whole(x, source, target)).max() < 1e-12
    assert [len(r["samples"]) for r in out if r["recording"] != "a"] == [-(-2 * target // source), 0]
    if source != target:
        assert [r["first"] for r in a] == [-(-c * target // source) for c in cuts[:-1]]
        with pytest.raises(Exception, match="a chunk of fewer than"):
            R.resample_chunks(spark.createDataFrame([("a", k, [1.0]) for k in range(3)], "recording string, chunk int, samples array<double>"), source, target).collect()


def column(spark, f, *arrays):
    rows = spark.createDataFrame([(k, [float(v) for v in a]) for k, a in enumerate(arrays)], "k int, x array<double>")
    return [r["y"] for r in rows.select("k", f("x").alias("y")).orderBy("k").collect()]


def test_high_pass(spark):
    x = np.random.default_rng(1).normal(size=3000)
    alpha, want, last, before = 1 / (2 * np.pi * 80) / (1 / (2 * np.pi * 80) + 1 / 16_000), [], 0.0, 0.0
    for s in x:
        last = alpha * (last + s - before)
        before = s
        want.append(last)
    got, still, none = column(spark, S.high_pass, x, np.ones(4000), [])
    assert np.abs(np.array(got) - want).max() < 1e-6 and abs(still[-1]) < 1e-3 and none == []


def test_denoising_and_gain(spark):
    rng = np.random.default_rng(4)
    tone = np.sin(2 * np.pi * 50 * np.arange(1024) / 1024)
    noisy = tone + rng.normal(0, 0.01, 1024)
    (clean,) = column(spark, S.spectral_subtraction, noisy)
    assert np.abs(np.array(clean) - tone).max() < np.abs(noisy - tone).max() + 1e-9 and abs(np.dot(clean, tone) / np.dot(tone, tone) - 1) < 0.01
    quiet, loud, silent = column(spark, S.normalise, tone * 0.01, tone * 0.9, np.zeros(8))
    assert np.abs(quiet).max() == pytest.approx(0.95, abs=1e-3) and 0.95 < np.abs(loud).max() <= 1.0 and silent == [0.0] * 8


def test_filterbank(spark):
    tone = np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000) * np.repeat([1.0, 0.01], 8_000)
    (bank, short) = column(spark, S.filterbank, tone, np.zeros(399))
    bank = np.array(bank)
    edges = np.linspace(S.mel(20), S.mel(8000), 82)
    band = int(np.argmin(np.abs(edges[1:-1] - S.mel(1000))))
    assert bank.shape == (98, 80) and short == [] and np.abs(bank.mean(0)).max() < 1e-6
    assert abs((bank[:40].mean(0) - bank[55:].mean(0))[band] - 2 * np.log(100)) < 0.2


def test_filterbank_tells_quiet_sounds_apart(spark):
    """Samples count as 16-bit ones: a quiet tone's bands are those of a loud one, not all at the least energy."""
    tone = np.sin(2 * np.pi * 1000 * np.arange(3_200) / 16_000) * np.linspace(0.5, 1, 3_200)
    loud, quiet = (np.array(b) for b in column(spark, S.filterbank, tone, tone * 1e-4))
    band = int(np.argmin(np.abs(np.linspace(S.mel(20), S.mel(8000), 82)[1:-1] - S.mel(1000))))
    assert np.abs(loud).max() > 0.1 and np.abs(loud - quiet)[:, band - 5 : band + 6].max() < 1e-6
    rng = np.random.default_rng(7).normal(0, 1e-7, 2_000)  # below the least energy unless scaled
    (noise,) = column(spark, S.filterbank, rng)
    assert np.abs(noise).max() > 0.1


def test_signal_query_gives_the_bands(spark, small):
    """Every band of every frame is in the result, not only how many frames there are."""
    from colloquy.plans import registry

    rows = registry.queries()["m9_m11_m12_m14_m16_signal"](spark, small).select("vec_id", "bank_frames", "bank").collect()
    vector = dict(spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect())
    for r in rows[:20]:
        (want,) = column(spark, S.filterbank, list(vector[r["vec_id"]]) * 20)
        assert r["bank_frames"] == len(r["bank"]) == len(want) == 6 and np.abs(np.array(r["bank"]) - np.array(want)).max() < 1e-6
    assert len(rows) == len(vector) and all(len(b) == 80 for r in rows for b in r["bank"])


def test_cuts_at_silence(spark):
    x = np.ones(4000)
    x[1400:1420] = 0  # between 12 and 18 s
    rows = spark.createDataFrame([("a", x.tolist()), ("b", [0.5] * 100), ("c", [])], "k string, x array<double>")
    got = {(r["k"], r["part"]): (r["first_sample"], r["end_sample"]) for r in S.split_at_silence(rows, "k", "x", 100, 15).collect()}
    assert 1400 <= got["a", 0][1] <= 1420 and got["b", 0] == (0, 100) and got["c", 0] == (0, 0)
    parts = sorted(v for (k, _), v in got.items() if k == "a")
    assert parts[0][0] == 0 and parts[-1][1] == 4000 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
