"""Alignment and mixed windows against a plain buffer of samples, and the stream against the table."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import live as L
from colloquy.streaming import jobs

SMALL = L.Limits(rate=2, window_ms=60, starved_ms=50, resync_ms=20, confirm_ms=30, lag_ms=100, deadband_ms=4, inner_ms=1, persist_ms=150, step_ms=1)


class Buffers:
    """Both streams' samples themselves, list by list: a window is cut off the front."""

    def __init__(self, limits):
        self.of, self.head, self.out = limits.of, None, []
        self.s = [dict(buf=[], end=None, adrift=False, notes=[], moved=0, gap=None, apart=None, turn=0) for _ in range(2)]

    def lag(self, s, now):
        return min(v for t, v in s["notes"] if now - t <= self.of("lag")) - s["moved"]

    def put(self, s, at, samples):
        end = max(self.head if s["end"] is None else s["end"], self.head)
        if at > end:
            s["buf"] += [0.0] * (at - end)
        skip = min(max(end - at, 0), len(samples))
        s["buf"] += samples[skip:]
        s["end"] = max(end, at + len(samples))

    def add(self, d, samples, now):
        s, o, n = self.s[d], self.s[1 - d], len(samples)
        if self.head is None:
            self.head = now - n
        # another stream's notes age only when it notes again
        other = self.lag(o, o["notes"][-1][0]) if o["end"] is not None and not o["adrift"] and o["notes"] else None
        if s["end"] is None or s["adrift"]:
            s.update(adrift=False, notes=[], moved=0, gap=None, apart=None, turn=0)
            self.put(s, now - n - (other or 0), samples)
            s["notes"].append((now, other or 0))
            return
        end, delay = s["end"], now - n - s["end"]
        s["notes"].append((now, delay + s["moved"]))
        late = delay - self.lag(s, now)
        if late > self.of("resync"):
            at, since = s["gap"] = s["gap"] or (end, now)
            if now - since < self.of("confirm"):
                self.put(s, end, samples)
                return
            s["gap"] = None
            k = min(max(at - self.head, 0), len(s["buf"]))
            s["buf"][k:k] = [0.0] * late
            s["end"] += late
            s["notes"] = [x for x in s["notes"] if x[0] < since] + [(now, delay - late + s["moved"])]
            self.put(s, end + late, samples)
            return
        s["gap"] = None
        off = 0 if other is None else self.lag(s, now) - other
        side = int(np.sign(off)) if abs(off) > self.of("deadband") else 0
        if s["turn"]:
            if abs(off) <= self.of("inner") or np.sign(off) != s["turn"]:
                s["turn"] = 0
        elif side == 0:
            s["apart"] = None
        elif s["apart"] is None or s["apart"][0] != side:
            s["apart"] = (side, now)
        elif now - s["apart"][1] >= self.of("persist"):
            s["turn"], s["apart"] = side, None
        move = max(-self.of("step"), min(self.of("step"), off)) if s["turn"] else 0
        if move > 0:
            s["buf"] += [samples[0]] * move
            s["end"] += move
        self.put(s, end + min(move, 0) + max(move, 0), samples)
        s["moved"] += move

    def cut(self, size):
        self.head += size
        window = []
        for s in self.s:
            got, s["buf"] = s["buf"][:size], s["buf"][size:]
            if len(got) < size and s["end"] is not None:
                s["end"], s["adrift"] = max(s["end"], self.head), True
            window.append(got + [0.0] * (size - len(got)))
        self.out.append((self.head - size, *window))

    def settle(self):
        size = self.of("window")
        while True:
            a, b = (len(s["buf"]) for s in self.s)
            ends = [self.head if s["end"] is None else s["end"] for s in self.s]
            starved = [max(ends) - e > self.of("starved") for e in ends]
            if not (min(a, b) >= size or a >= size and starved[1] or b >= size and starved[0]):
                return
            self.cut(size)

    def close(self):
        left = max(len(s["buf"]) for s in self.s)
        if left:
            self.cut(left)


def live_chunks(seed, count=220, quiet=()):
    """(device, chunk, n, arrival, samples): jitter, drift, bursts, losses, a device that comes late and one that stops."""
    rng = random.Random(seed)
    rows = []
    for device in L.DEVICES:
        captured, late, sign = rng.choice([0, 0, 90]), 0, 1 if device == "mic" else -1
        for chunk in range(count):
            n = rng.randint(5, 20)
            captured += n
            if rng.random() < 0.03:
                captured += rng.randint(10, 120)
            if chunk % rng.randint(3, 6) == 0:
                captured += rng.choice([0, 1]) if device == "mic" else 0
            late = max(late - n, rng.choice([0, 0, 0, 90]) if rng.random() < 0.05 else rng.randint(0, 6))
            if not (device == "system" and chunk // 40 in quiet):
                rows.append((device, chunk, n, captured + late, [sign * (1 + chunk * 100 + k) / 100_000 for k in range(n)]))
    return rows


SCHEMA = "session_id string, device string, chunk bigint, n bigint, arrival bigint, samples array<double>"


def by_hand(rows, limits):
    b = Buffers(limits)
    for device, _, _, arrival, samples in sorted(rows, key=lambda r: (r[3], r[0], r[1])):
        b.add(L.DEVICES.index(device), samples, arrival)
        b.settle()
    b.close()
    return b.out


def test_samples_of_windows(spark):
    sessions = {f"s{k}": live_chunks(k, quiet=() if k < 6 else (1, 3)) for k in range(12)}
    rows = [(s, *r) for s, chunks in sessions.items() for r in chunks]
    table = spark.createDataFrame(rows, SCHEMA)
    events = L.aligned(table, SMALL)
    got = {}
    for r in L.window_samples(events, table).collect():
        got.setdefault(r["session_id"], []).append((r["at"], r["mic"], r["system"]))
        assert r["mixed"] == [max(-1.0, min(1.0, a + b)) for a, b in zip(r["mic"], r["system"])]
    for s, chunks in sessions.items():
        assert sorted(got[s]) == by_hand(chunks, SMALL)
    placed = events.where("event = 'placed'").agg(F.sum((F.col("gap") > 0).cast("int")), F.sum((F.col("held") > 0).cast("int")), F.sum((F.col("dropped") > 0).cast("int")), F.sum((F.col("silence") > 0).cast("int"))).first()
    assert min(placed) > 10, placed


def fold(*chunks, limits=L.Limits(rate=1)):
    state, out = L.Session(limits), []
    for k, (device, n, arrival) in enumerate(chunks):
        out += state.add(L.DEVICES.index(device), k, n, arrival)
    return state, out


def test_gap_is_confirmed_after_150_ms():
    steady = [("mic", 10, 10 * k) for k in range(1, 11)]
    late = [("mic", 10, 100 + 200 + 10 * k) for k in range(1, 30)]
    _, out = fold(*steady, *late)
    (gap,) = [r for r in out if r[9]]
    assert gap[8:10] == (100, 200) and gap[2] == 10 + 15  # the sixteenth late chunk comes 150 ms after the first
    # a burst that catches up is kept whole
    burst = [("mic", 10, 320) for _ in range(22)] + [("mic", 10, 330 + 10 * k) for k in range(30)]
    assert not [r for r in fold(*steady, *burst)[1] if r[9] or r[7]]


def test_drift_is_taken_back_by_a_millisecond_a_chunk():
    rows = []
    for k in range(1, 700):
        rows.append(("mic", 10, 10 * k))
        rows.append(("system", 10, 10 * k + k // 40))
    _, out = fold(*rows)
    placed = [r for r in out if r[0] == "placed"]
    moves = [r[5] or -r[6] for r in placed if r[5] or r[6]]
    assert moves and {abs(m) for m in moves} == {1}
    first = next(k for k, r in enumerate(placed) if r[5] or r[6]) // 2
    assert first >= 40 * 6 + 200  # over 5 ms from chunk 240 on, for 2 s of 10 ms chunks


def test_windows_wait_for_both_or_for_starvation():
    state, out = fold(*[("mic", 100, 100 * k) for k in range(1, 7)])
    assert [r[0] for r in out].count("window") == 1 and [r for r in out if r[0] == "window"][0][10:12] == (0, 600)
    state, out = fold(("system", 150, 150), *[("mic", 100, 100 * k) for k in range(1, 7)])
    assert [r[0] for r in out].count("window") == 0  # 450 ms behind: not starved yet
    assert [r[0] for r in state.add(0, 99, 60, 660)].count("window") == 1
    state, _ = fold(("system", 150, 150), ("mic", 200, 200))
    (rest,) = state.rest()
    assert (rest[0], rest[4], rest[10], rest[11]) == ("rest", 200, 0, 50) and state.rest() == []


def test_late_samples_are_dropped():
    state, _ = fold(*[("mic", 100, 100 * k) for k in range(1, 8)])
    (placed, *_) = state.add(1, 50, 100, 620)  # captured from 520 to 620; the first 600 are mixed
    assert placed[6] == 80 and state.tracks[1].end == 620


def test_other_rows_are_left_out(spark):
    rows = [("s", "mic", 0, 10, 10), ("s", "mic", 1, 0, 20), ("s", "phone", 2, 10, 30), ("s", None, 3, 10, 30), ("s", "mic", 4, None, 30), ("s", "mic", 5, 10, None), (None, "mic", 6, 10, 10), ("s", "mic", None, 10, 40)]
    table = spark.createDataFrame(rows, "session_id string, device string, chunk bigint, n bigint, arrival bigint")
    assert [r["chunk"] for r in L.aligned(table).where("event = 'placed'").collect()] == [0]
    assert L.aligned(table.limit(0)).count() == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def plain(rows):
    return sorted(str([r[c] for c in ("session_id", *L.NAMES)]) for r in rows)


def test_stream_goes_on_from_its_checkpoint(spark, rocks, tmp_path):
    """Files come one after the other, with the query stopped in between; a later session's time lets the first ones end."""
    chunks = [(f"s{k}", *r[:4]) for k in range(3) for r in live_chunks(k, 120)]
    chunks.append(("z", "mic", 0, 10, 40_000_000))
    table = spark.createDataFrame(chunks, "session_id string, device string, chunk bigint, n bigint, arrival bigint").withColumn("at", F.timestamp_millis(F.col("arrival").cast("bigint")))
    cuts = [0, 300, 900, 1600, 1 << 40]
    folder = str(tmp_path / "in")
    got = []
    for low, high in zip(cuts, cuts[1:]):
        table.where((F.col("arrival") >= low) & (F.col("arrival") < high)).coalesce(1).write.mode("append").parquet(folder)
        stream = L.aligned_stream(jobs.source(spark, folder), SMALL)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert got == sorted(got) and got[0] > 0
    want = [r for r in L.aligned(table, SMALL).collect() if not (r["session_id"] == "z" and r["event"] == "rest")]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert plain(out.collect()) == plain(want)
    assert {r["session_id"] for r in out.where("event = 'rest'").collect()} == {"s0", "s1", "s2"}
