"""Jobs, votes, turns and the error rate against loops over frames; nearest-neighbour chains against merging the closest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import diarize as D
from colloquy.operators import vectors as V


def frames_table(spark, rows):
    return spark.createDataFrame(rows, "recording string, window int, activity array<int>")


def random_windows(seed, recordings=3, count=6, frames=120):
    rng = random.Random(seed)
    rows = []
    for r in range(recordings):
        for w in range(count):
            mask, activity = 0, []
            for _ in range(frames):
                if rng.random() < 0.08:
                    mask = rng.choice([0, 1, 2, 4, 3, 5, 6, 7, 1, 2])
                activity.append(mask)
            rows.append((f"r{r}", w, activity))
    return rows


HOW = D.Frames(window=120 * 270, step=31 * 270 + 100)


def jobs_by_hand(rows):
    out = {}
    for recording, window, activity in rows:
        to_sample = lambda k: int(k / len(activity) * HOW.window) + window * HOW.step  # noqa: E731, B023
        for local in range(3):
            alone = [m == 1 << local for m in activity]
            if sum(alone) < 10:
                continue
            ranges, start = [], None
            for k, on in enumerate([*alone, False]):
                if on and start is None:
                    start = k
                elif not on and start is not None:
                    ranges.append((to_sample(start), to_sample(min(k, len(activity) - 1))))
                    start = None
            out[recording, window, local] = (sum(alone), ranges)
    return out


def test_jobs(spark):
    rows = [*random_windows(1), ("one", 0, [1] * 120), ("none", 0, []), ("null", 0, None)]
    got = {(r["recording"], r["window"], r["local"]): (r["clean"], [tuple(x) for x in r["ranges"]]) for r in D.embed_jobs(frames_table(spark, rows), HOW).collect()}
    assert got == jobs_by_hand([r for r in rows if r[2]])


def active_by_hand(rows, mapping, samples):
    """{(recording, frame, speaker)} by a loop over frames."""
    out = set()
    for recording in {r[0] for r in rows}:
        count, covered, votes = {}, {}, {}
        for _, w, activity in (r for r in rows if r[0] == recording):
            first = int(w * HOW.step / HOW.shift + 0.5)
            for f, mask in enumerate(activity):
                g = first + f
                count[g] = count.get(g, 0) + bin(mask).count("1")
                covered[g] = covered.get(g, 0) + 1
                for local in range(3):
                    if mask >> local & 1 and (speaker := mapping.get((recording, w, local))) is not None:
                        votes.setdefault(g, {}).setdefault(speaker, 0)
                        votes[g][speaker] += 1
        for g in votes:
            many = int(count[g] / covered[g] + 0.5)
            if g <= samples // HOW.shift:
                out |= {(recording, g, s) for s in sorted(votes[g], key=lambda s: (-votes[g][s], s))[:many]}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_votes_and_turns(spark, seed):
    """Thirteen hundred frames: three tiles."""
    rows = random_windows(seed, count=40)
    rng = random.Random(seed)
    mapping = {(r, w, k): rng.randrange(4) for r, w, _ in rows for k in range(3) if rng.random() < 0.8}
    samples = 31 * 270 * 40
    table = spark.createDataFrame([(*k, v) for k, v in mapping.items()], "recording string, window int, local int, speaker int")
    lengths = spark.createDataFrame([(f"r{k}", samples) for k in range(3)], "recording string, samples bigint")
    runs = D.speaker_runs(frames_table(spark, rows), table, lengths, HOW)
    got = {(r["recording"], f, r["speaker"]) for r in runs.collect() for f in range(r["first"], r["end"])}
    want = active_by_hand(rows, mapping, samples)
    assert got == want and len(got) > 500
    turns = {}
    for r in D.speaker_turns(runs, HOW).collect():
        turns.setdefault(r["recording"], []).append((r["start_ms"], r["end_ms"], r["speaker"]))
    for recording in turns:
        expect = []
        for s in range(4):
            on = sorted(g for rec, g, k in want if rec == recording and k == s)
            spans = []
            for g in on:
                if spans and (g - spans[-1][1]) * HOW.shift < 8000:
                    spans[-1][1] = g + 1
                else:
                    spans.append([g, g + 1])
            expect += [(a, b, s) for a, b in spans if (b - a) * HOW.shift > 1600]
        expect.sort(key=lambda x: (x[0], x[2]))
        names = {}
        millis = lambda f: int((f * HOW.shift + HOW.field / 2) * 1000 / HOW.rate)
        assert sorted(turns[recording]) == sorted((millis(a), millis(b), names.setdefault(s, len(names))) for a, b, s in expect)


def test_frames_as_bytes(spark):
    """Frames as a byte each give the jobs and runs that arrays give."""
    rows = [*random_windows(3, count=40), ("one", 0, [1] * 120), ("none", 0, []), ("null", 0, None)]
    table = frames_table(spark, rows)
    packed = spark.createDataFrame([(r, w, None if a is None else bytes(a)) for r, w, a in rows], "recording string, window int, activity binary")
    jobs, other = (sorted(D.embed_jobs(t, HOW).collect()) for t in (table, packed))
    assert jobs == other and len(jobs) > 50
    mapping = spark.createDataFrame([(r, w, k, (k + w) % 3) for r, w, _ in rows for k in range(3)], "recording string, window int, local int, speaker int")
    lengths = spark.createDataFrame([(r, 31 * 270 * 40) for r in {r for r, _, _ in rows}], "recording string, samples bigint")
    runs, other = (sorted(D.speaker_runs(t, mapping, lengths, HOW).collect()) for t in (table, packed))
    assert runs == other and len(runs) > 50


@pytest.mark.parametrize("least", [1, 4, 100])
def test_voices_are_the_operators_clusters(spark, least):
    """Clusters, folded, and their centroids as the operators over tables give them."""
    rng = np.random.default_rng(least)
    rows = [("r", k, 10 + int(rng.integers(50)), [float(x) for x in np.eye(5)[min(k % 7, 4) if k % 11 else 3] + rng.normal(0, 0.1, 5)]) for k in range(60)] + [("r", 60, 20, [0.2, -1.0, -1.0, 0.1, 0.3])]
    items = spark.createDataFrame(rows, "g string, item int, clean int, e array<double>")
    labels = V.cluster(items, "g", "item", "e", 0.6)
    folded = V.fold_small(items.join(labels, ["g", "item"]), "g", "item", "e", "label", "clean", least, 0.02)
    units = items.withColumn("u", V.unit(F.col("e"))).join(folded, ["g", "item"])
    want = {r["label"]: r["centroid"] for r in V.mean_vector(units, "label", "u").collect()}
    got = dict(V.voices(np.array([r[3] for r in rows]), np.array([r[2] for r in rows], float), 0.6, least, 0.02))
    assert got.keys() == want.keys() and all(np.abs(np.array(got[k]) - want[k]).max() < 1e-9 for k in want)


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.8])
def test_clusters_of_any_number_without_a_matrix(monkeypatch, threshold):
    """Recordings with more jobs than distances can be held for; the same clusters, copies among the vectors too."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 6)) + 0.4
    vectors[200:] = np.repeat(vectors[:10], 10, axis=0)
    want = V.voices(vectors, np.ones(300), threshold, 3, 0.0)
    monkeypatch.setattr(V, "MOST_VECTORS", 100)
    got = V.voices(vectors, np.ones(300), threshold, 3, 0.0)
    assert [k for k, _ in got] == [k for k, _ in want] and np.abs(np.array([c for _, c in got]) - np.array([c for _, c in want])).max() < 1e-9


def test_speakers_of_short_and_long_jobs(spark):
    """Fewer than two long jobs: all are clustered; else the long ones alone, and the short ones are mapped to them."""
    axis = lambda k: [float(i == k) for i in range(4)]
    items = [("few", 0, 0, 80, axis(0)), ("few", 1, 0, 10, axis(1)), ("few", 2, 0, 10, axis(2)), ("many", 0, 0, 80, axis(2)), ("many", 1, 0, 70, axis(1)), ("many", 2, 0, 10, [0.1, 0.9, 0.0, 0.0]), ("many", 3, 0, 10, axis(2))]
    out = D.global_speakers(spark.createDataFrame(items, "recording string, window int, local int, clean int, e array<double>"), long=60, min_size=1, min_share=0.0).collect()
    assert sorted((r["recording"], r["window"], r["speaker"]) for r in out) == [("few", 0, 0), ("few", 1, 1), ("few", 2, 2), ("many", 0, 0), ("many", 1, 1), ("many", 2, 1), ("many", 3, 0)]


def test_whole_chain(spark):
    """Two voices, named anew in each window, are found again; the third local is never embedded."""
    rows, items = [], []
    truth = lambda f: 0 if f // 200 % 2 else 1
    for w in range(8):
        first = int(w * HOW.step / HOW.shift + 0.5)
        rows.append(("a", w, [1 << (truth(first + f) + w) % 3 for f in range(120)]))
    windows = frames_table(spark, rows)
    rng = np.random.default_rng(1)
    for j in D.embed_jobs(windows, HOW).collect():
        voice = (j["local"] - j["window"]) % 3
        items.append(("a", j["window"], j["local"], j["clean"], [float(x) for x in np.eye(3)[voice] + rng.normal(0, 0.05, 3)]))
    embedded = spark.createDataFrame(items, "recording string, window int, local int, clean int, e array<double>")
    lengths = spark.createDataFrame([("a", 10**7)], "recording string, samples bigint")
    got = sorted((r["start_ms"], r["end_ms"], r["speaker"]) for r in D.diarize(windows, embedded, lengths, HOW, long=10, min_size=1, min_share=0.0).collect())
    assert [s for _, _, s in got] == [0, 1] and abs(got[0][1] - got[1][0]) <= 1
    assert D.diarize(windows.limit(0), embedded.limit(0), lengths, HOW).count() == 0


def rate_by_hand(ref, hyp):
    import itertools

    frame = lambda t: max(0, int(np.floor(t / 10 + 0.5)))
    cells = lambda turns: {(f, s) for s, a, b in turns for f in range(frame(a), frame(b))}
    r, h = cells(ref), cells(hyp)
    names, others = sorted({s for _, s in r}), sorted({s for _, s in h})
    best = max((sum((f, m) in r for f, s in h for m in [dict(zip(others, p)).get(s)]) for p in itertools.permutations([*names, *[None] * len(others)], len(others))), default=0)
    missed = false = confused = 0
    for f in {f for f, _ in r | h}:
        a, b = sum(x == f for x, _ in r), sum(x == f for x, _ in h)
        missed, false, confused = missed + max(a - b, 0), false + max(b - a, 0), confused + min(a, b)
    return len(r), missed, false, confused - best


def test_error_rate(spark):
    rng = random.Random(4)
    draw = lambda names: [(rng.choice(names), a := rng.randrange(-20, 4000), a + rng.randrange(1, 900)) for _ in range(12)]
    cases = {f"m{k}": (draw("AB"), draw([0, 1, 2])) for k in range(6)}
    cases |= {"same": ([("A", 0, 1000), ("B", 500, 800)], [(1, 0, 1000), (0, 500, 800)]), "silent": ([("A", 0, 100)], []), "ghost": ([], [(0, 0, 100)])}
    schema = "recording string, speaker {}, start_ms bigint, end_ms bigint"
    ref = spark.createDataFrame([(m, *t) for m, (r, _) in cases.items() for t in r], schema.format("string"))
    hyp = spark.createDataFrame([(m, *t) for m, (_, h) in cases.items() for t in h], schema.format("int"))
    got = {r["recording"]: r for r in D.error_rate(ref, hyp).collect()}
    for m, (r, h) in cases.items():
        assert tuple(got[m][1:5]) == rate_by_hand(r, h), m
    assert got["same"]["rate"] == 0 and got["silent"]["rate"] == 1 and got["ghost"]["rate"] == 10


def naive(vectors, threshold):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = np.maximum(0, 1 - u @ u.T)
    groups = [[k] for k in range(len(u))]
    while len(groups) > 1:
        h, a, b = min((d[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if h > threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("n, threshold", [(1, 0.5), (2, 0.5), (40, 0.3), (40, 0.8), (60, 0.05)])
def test_chains_merge_as_the_closest_do(n, threshold):
    vectors = np.random.default_rng(n).normal(size=(n, 6)) + 0.4
    labels = V.average_linkage(vectors, threshold)
    groups = {}
    for k, x in enumerate(labels.tolist()):
        groups.setdefault(x, []).append(k)
    assert {frozenset(g) for g in groups.values()} == naive(vectors, threshold)
    assert [min(groups[x]) for x in sorted(groups)] == sorted(min(g) for g in groups.values())


def test_linkage_of_many_and_too_many():
    rng = np.random.default_rng(0)
    vectors = np.repeat(np.eye(5), 300, axis=0) + rng.normal(0, 0.05, (1500, 5))
    labels = V.average_linkage(vectors, 0.5)
    assert labels.tolist() == np.repeat(np.arange(5), 300).tolist()
    assert len(set(V.average_linkage(vectors[::50], clusters=3).tolist())) == 3
    with pytest.raises(ValueError):
        V.average_linkage(np.ones((V.MOST_VECTORS + 1, 2)))
