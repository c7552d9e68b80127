"""Two live streams of one session on one timeline: alignment by arrival times, and windows in which both are mixed.

A chunk says how many samples it has and when it arrived; capture was earlier by a delay that is never negative. A stream's
``lag`` is the least delay of its recent chunks against where continuity puts them. Chunks follow one another, but for
three cases: a stream that (re)appears is placed by its arrival and the other stream's lag; lateness over ``resync_ms``
that lasts ``confirm_ms`` is a gap, filled with silence where it began; and a misalignment of the streams over
``deadband_ms`` that lasts ``persist_ms`` is taken back by at most ``step_ms`` a chunk until it is within ``inner_ms``.

The state of a session is small: numbers, recent lags, and which samples lie where between the last window and now, as
spans. It is folded over a table's sorted rows (``aligned``) or kept by Structured Streaming (``aligned_stream``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.arrow import fold_in_order

DEVICES = ("mic", "system")
SILENCE, HELD = -1, -1

#: One row for each chunk (``placed``) and for each window (``window``, or ``rest`` at the end): ``at`` and ``n`` on the
#: timeline; samples held, dropped, and filled with silence before a chunk; a gap's place and length; samples that a
#: device lacks in a window; and the spans (device, at, n, chunk, skip): ``n`` samples of a chunk from its sample ``skip``
#: on; chunk -1 is silence, skip -1 repeats the chunk's first sample.
FIELDS = "event string, device string, chunk bigint, at bigint, n bigint, held bigint, dropped bigint, silence bigint, gap_at bigint, gap bigint, mic_lacks bigint, system_lacks bigint, spans array<struct<device:int,at:bigint,n:bigint,chunk:bigint,skip:bigint>>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
INPUTS = ["device", "chunk", "n", "arrival"]


@dataclass(frozen=True)
class Limits:
    """Times in milliseconds; ``rate`` is samples a millisecond."""

    rate: int = 16
    window_ms: int = 600
    starved_ms: int = 500
    resync_ms: int = 100
    confirm_ms: int = 150
    lag_ms: int = 750
    deadband_ms: int = 5
    inner_ms: int = 1
    persist_ms: int = 2000
    step_ms: int = 1

    def of(self, name: str) -> int:
        return getattr(self, f"{name}_ms") * self.rate


@dataclass
class Track:
    """One stream. ``end`` is where its next sample would go; None before the first chunk."""

    end: int | None = None
    adrift: bool = False
    moved: int = 0
    gap_at: int | None = None
    gap_since: int | None = None
    side: int = 0
    side_since: int = 0
    turning: int = 0
    lags: list[tuple[int, int]] = field(default_factory=list)
    spans: list[tuple[int, int, int, int]] = field(default_factory=list)

    def lag(self) -> int:
        return self.lags[0][1] - self.moved

    def known_lag(self) -> int | None:
        return self.lag() if self.end is not None and not self.adrift and self.lags else None

    def note(self, now: int, delay: int, span: int) -> None:
        """Keeps the delays that are, or may become, the least of the last ``span`` samples: rising from the oldest on."""
        value = delay + self.moved
        self.lags = [(t, v) for t, v in self.lags if v < value and now - t <= span] + [(now, value)]

    def restart(self) -> None:
        self.adrift, self.moved, self.lags, self.gap_at, self.gap_since, self.side, self.turning = False, 0, [], None, None, 0, 0

    def add(self, n: int, chunk: int, skip: int) -> None:
        if n > 0:
            self.spans.append((self.end, n, chunk, skip))
            self.end += n

    def insert(self, at: int, n: int) -> None:
        """Silence at a place; what lies behind it moves."""
        before, behind = _split(self.spans, at)
        at = before[-1][0] + before[-1][1] if before else behind[0][0] if behind else self.end
        self.spans = [*before, (at, n, SILENCE, 0), *((p + n, k, c, s) for p, k, c, s in behind)]
        self.end += n


def _split(spans: list, at: int) -> tuple[list, list]:
    before, behind = [], []
    for p, n, chunk, skip in spans:
        cut = min(max(at - p, 0), n)
        if cut:
            before.append((p, cut, chunk, skip))
        if cut < n:
            behind.append((p + cut, n - cut, chunk, skip if chunk == SILENCE or skip == HELD else skip + cut))
    return before, behind


@dataclass
class Session:
    limits: Limits
    head: int | None = None
    tracks: tuple[Track, Track] = field(default_factory=lambda: (Track(), Track()))

    def place(self, track: Track, at: int, n: int, chunk: int) -> tuple[int, int]:
        """Puts a chunk at a place, silence before it, and drops what overlaps; (silence, dropped)."""
        track.end = self.head if track.end is None else max(track.end, self.head)
        silence, dropped = max(0, at - track.end), min(max(track.end - at, 0), n)
        track.add(silence, SILENCE, 0)
        track.add(n - dropped, chunk, dropped)
        return silence, dropped

    def add(self, device: int, chunk: int, n: int, arrival: int) -> list[tuple]:
        """Takes a chunk whose last sample had been captured when it arrived (both in samples); rows as in ``FIELDS``."""
        of, track, other = self.limits.of, self.tracks[device], self.tracks[1 - device].known_lag()
        if self.head is None:
            self.head = arrival - n
        held, gap_at, gap = 0, None, 0
        if track.end is None or track.adrift:
            track.restart()
            at = arrival - n - (other or 0)
            silence, dropped = self.place(track, at, n, chunk)
            track.note(arrival, other or 0, of("lag"))
        else:
            at, delay = track.end, arrival - n - track.end
            track.note(arrival, delay, of("lag"))
            late = delay - track.lag()
            if late > of("resync"):
                if track.gap_at is None:
                    track.gap_at, track.gap_since = track.end, arrival
                if arrival - track.gap_since >= of("confirm"):
                    gap_at, gap, at = max(track.gap_at, self.head), late, at + late
                    track.insert(gap_at, gap)
                    track.lags = [(t, v) for t, v in track.lags if t < track.gap_since]
                    track.note(arrival, delay - late, of("lag"))
                    track.gap_at = track.gap_since = None
            else:
                track.gap_at = track.gap_since = None
                off = 0 if other is None else track.lag() - other
                self.watch(track, off, arrival)
                if track.turning > 0:
                    held = min(off, max(of("step"), 1))
                    track.add(held, chunk, HELD)
                    track.moved += held
                    at = track.end
                elif track.turning < 0:
                    back = min(-off, max(of("step"), 1), n)
                    track.moved -= back
                    at -= back
            silence, dropped = self.place(track, at, n, chunk)
        return [("placed", DEVICES[device], chunk, at, n, held, dropped, silence, gap_at, gap, None, None, None), *self.windows()]

    def watch(self, track: Track, off: int, now: int) -> None:
        """Begins a correction once the streams have been apart on one side for long, and ends it when they are not."""
        sign = (off > 0) - (off < 0)
        side = sign if abs(off) > self.limits.of("deadband") else 0
        if track.turning:
            if abs(off) <= self.limits.of("inner") or sign != track.turning:
                track.turning = 0
        elif side == 0 or side != track.side:
            track.side, track.side_since = side, now
        elif now - track.side_since >= self.limits.of("persist"):
            track.turning, track.side = side, 0

    def windows(self) -> Iterator[tuple]:
        """Windows that both streams fill, or one while the other is starved."""
        size = self.limits.of("window")
        while True:
            filled = [0 if t.end is None else t.end - self.head for t in self.tracks]
            if max(filled) < size or min(filled) < size and max(filled) - min(filled) <= self.limits.of("starved"):
                return
            yield self.take("window", size, filled)

    def rest(self) -> list[tuple]:
        """What is left at the end, padded to the longer stream."""
        filled = [0 if t.end is None else t.end - self.head for t in self.tracks]
        return [self.take("rest", max(filled), filled)] if max(filled) > 0 else []

    def take(self, event: str, size: int, filled: list[int]) -> tuple:
        at, self.head, spans = self.head, self.head + size, []
        for device, track in enumerate(self.tracks):
            taken, track.spans = _split(track.spans, self.head)
            spans += [(device, p - at, *s) for p, *s in taken]
            if track.end is not None and track.end < self.head:
                track.end, track.adrift = self.head, True
        lacks = [max(0, size - f) for f in filled]
        return (event, None, None, at, size, None, None, None, None, None, *lacks, spans)


def aligned(chunks: DataFrame, limits: Limits = Limits(), session: str = "session_id") -> DataFrame:
    """Rows as in ``FIELDS`` for each session of (session, device, chunk, n, arrival).

    ``device`` is mic or system, ``arrival`` and ``n`` are samples; chunks of a session are taken by (arrival, device,
    chunk). Chunks without samples, or with a null, are left out. A session is a task's sorted run of rows, never held.
    """
    rows = chunks.select(session, *INPUTS).where(F.col("device").isin(*DEVICES) & (F.col("n") > 0) & F.col("arrival").isNotNull() & F.col("chunk").isNotNull() & F.col(session).isNotNull())

    def step(state, row):
        state = state or Session(limits)
        return state, state.add(DEVICES.index(row["device"]), row["chunk"], row["n"], row["arrival"])

    return fold_in_order(rows, [session], ["arrival", "device", "chunk"], INPUTS, step, lambda state: state.rest(), FIELDS)


class Aligner(StatefulProcessor):
    """The same over a stream. Numbers are a value state, lags and spans list states; a timer ends a session that has been
    quiet for ``quiet_ms`` of event time, and gives what is left."""

    TRACK = ["end", "adrift", "moved", "gap_at", "gap_since", "side", "side_since", "turning"]

    def __init__(self, limits: Limits, session: str, quiet_ms: int):
        self.limits, self.session, self.quiet_ms = limits, session, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = {"adrift": "boolean"}
        self.handle = handle
        self.numbers = handle.getValueState("numbers", "head bigint, timer bigint, " + ", ".join(f"{n}_{d} {kinds.get(n, 'bigint')}" for d in range(2) for n in self.TRACK))
        self.lags = handle.getListState("lags", "device int, t bigint, v bigint")
        self.spans = handle.getListState("spans", "device int, at bigint, n bigint, chunk bigint, skip bigint")

    def load(self) -> tuple[Session, int | None]:
        state = Session(self.limits)
        if not self.numbers.exists():
            return state, None
        head, timer, *values = self.numbers.get()
        state.head = head
        for d, track in enumerate(state.tracks):
            for name, value in zip(self.TRACK, values[d * len(self.TRACK) :]):
                setattr(track, name, value)
        for d, t, v in self.lags.get():
            state.tracks[d].lags.append((t, v))
        for d, *span in self.spans.get():
            state.tracks[d].spans.append(tuple(span))
        return state, timer

    def save(self, state: Session, timer: int) -> None:
        self.numbers.update((state.head, timer, *(getattr(t, n) for t in state.tracks for n in self.TRACK)))
        for held, rows in ((self.lags, [(d, *x) for d, t in enumerate(state.tracks) for x in t.lags]), (self.spans, [(d, *x) for d, t in enumerate(state.tracks) for x in t.spans])):
            if rows:
                held.put(rows)
            else:
                held.clear()

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=NAMES, dtype=object)
        out.insert(0, self.session, pd.Series([key[0]] * len(rows), dtype=object))  # no rows have no type of their own
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self.load()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["arrival", "device", "chunk"])
        out = [r for x in batch.itertuples() for r in state.add(DEVICES.index(x.device), int(x.chunk), int(x.n), int(x.arrival))]
        due = int(batch["at"].max().timestamp() * 1000) + self.quiet_ms
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.save(state, due)
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _ = self.load()
        rest = state.rest()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        for held in (self.numbers, self.lags, self.spans):
            held.clear()
        yield self.frame(key, rest)


def aligned_stream(chunks: DataFrame, limits: Limits = Limits(), session: str = "session_id", late_ms: int = 500, quiet_ms: int = 5000) -> DataFrame:
    """``aligned`` over a stream of (session, device, chunk, n, arrival, at), where ``at`` is the arrival as a timestamp.

    Rows over ``late_ms`` behind the newest are dropped. Needs the RocksDB state store. A batch's chunks are taken in the
    order of their arrival, so the result is that of the table if batches follow one another in time.
    """
    kept = chunks.withWatermark("at", f"{late_ms} milliseconds").where(F.col("device").isin(*DEVICES) & (F.col("n") > 0) & F.col("arrival").isNotNull() & F.col("chunk").isNotNull() & F.col(session).isNotNull())
    kind = chunks.schema[session].dataType.simpleString()
    return kept.groupBy(session).transformWithStateInPandas(Aligner(limits, session, quiet_ms), f"{session} {kind}, {FIELDS}", "Append", "EventTime")


def window_samples(events: DataFrame, chunks: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, at, mic, system, mixed): the samples of each window. ``chunks`` has ``samples``, an array of numbers.

    Spans are joined to their chunks; what a device lacks is silence, and sums are clipped at -1 and 1. A window holds at
    most its own size, whatever the stream's length.
    """
    windows = events.where(F.col("event") != "placed").select(session, F.col("at").alias("start"), F.col("n").alias("size"), "spans")
    spans = windows.select(session, "start", F.explode("spans").alias("s")).select(session, "start", "s.*").where(F.col("chunk") >= 0)
    source = chunks.select(F.col(session), F.when(F.col("device") == DEVICES[0], 0).when(F.col("device") == DEVICES[1], 1).alias("device"), "chunk", "samples")
    cut = F.when(F.col("skip") == HELD, F.array_repeat(F.element_at("samples", 1), F.col("n").cast("int"))).otherwise(F.slice("samples", F.col("skip").cast("int") + 1, F.col("n").cast("int")))
    parts = spans.join(source, [session, "device", "chunk"]).groupBy(session, "start", "device").agg(F.sort_array(F.collect_list(F.struct("at", cut.alias("part")))).alias("parts"))
    silent = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))

    def full(parts):
        joined = F.aggregate(parts, F.array().cast("array<double>"), lambda have, p: F.concat(have, silent(p["at"] - F.size(have)), p["part"].cast("array<double>")))
        return F.concat(joined, silent(F.col("size") - F.size(joined)))

    for device, name in enumerate(DEVICES):
        one = parts.where(F.col("device") == device).select(session, "start", F.col("parts").alias(name))
        windows = windows.join(one, [session, "start"], "left").withColumn(name, F.when(F.col(name).isNull(), silent(F.col("size"))).otherwise(full(F.col(name))))
    mixed = F.zip_with(*DEVICES, lambda a, b: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a + b)))
    return windows.select(session, F.col("start").alias("at"), *DEVICES, mixed.alias("mixed"))
