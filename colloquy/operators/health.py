"""The life of a capture stream: running, dead after errors or a stall, rebuilt, recovered, given up, tried again.

Times are milliseconds. A log row is (at, kind): ``installed`` at a session's start, ``rebuilt``, ``audio`` (data came),
``error``, ``disconnected``, ``failed`` (a rebuild did not work), ``removed``. What only time brings, a stall or the next
try, makes rows of its own; a table's fold and a stream's timers run the same state.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.functions.arrow import fold_in_order

KINDS = ["installed", "rebuilt", "audio", "error", "disconnected", "failed", "removed"]
FIELDS = "at bigint, kind string, status string, recovered boolean, degraded boolean, short_lived int, retry_ms bigint"


@dataclass(frozen=True)
class Rules:
    error_window: int = 2_000
    errors: int = 5
    stall: int = 3_000
    delivered: int = 3_000
    short_lived: int = 3
    first_retry: int = 30_000
    last_retry: int = 300_000
    degraded_every: int = 10_000


@dataclass
class Health:
    """``status`` is Absent, Running, Dead or Failed."""

    status: str = "Absent"
    since: int = 0
    heard: int | None = None
    rebuilt: bool = False
    awaited: bool = False
    told: bool = False
    told_at: int | None = None
    short_lived: int = 0
    retry: int = 30_000
    failed_at: int = 0
    errors: list[int] = field(default_factory=list)

    def row(self, at: int, kind: str, recovered: bool = False, degraded: bool = False) -> tuple:
        return (at, kind, self.status, recovered, degraded, self.short_lived, self.retry)

    def delivered(self) -> int:
        return 0 if self.heard is None else max(0, self.heard - self.since)

    def due(self, rules: Rules) -> int | None:
        """When time alone changes something, if nothing comes before."""
        if self.status == "Running":
            return max(self.since, self.heard or 0) + rules.stall + 1
        return self.failed_at + self.retry if self.status == "Failed" else None

    def pass_time(self, now: int, rules: Rules) -> list[tuple]:
        """Stalls and tries that are due by ``now``."""
        out = []
        while (due := self.due(rules)) is not None and due <= now:
            if self.status == "Running":
                degraded = self.die(due, rules)
                out.append(self.row(due, "stall", degraded=degraded))
            else:
                self.failed_at = due
                out.append(self.row(due, "retry"))
        return out

    def die(self, now: int, rules: Rules) -> bool:
        """The stream is dead; after several rebuilt ones that never worked it has failed. Whether users are told: once an
        outage, and not again within ten seconds."""
        if not self.rebuilt or self.delivered() >= rules.delivered:
            self.short_lived, self.retry = 0, rules.first_retry
        else:
            self.short_lived += 1
        self.status, self.awaited = "Dead", False
        degraded = not self.told and (self.told_at is None or now - self.told_at >= rules.degraded_every)
        if degraded:
            self.told, self.told_at = True, now
        if self.short_lived >= rules.short_lived:
            self.fail(now, rules)
        return degraded

    def fail(self, now: int, rules: Rules) -> None:
        again = self.status == "Failed" or self.short_lived >= rules.short_lived
        self.retry = min(2 * self.retry, rules.last_retry) if again else rules.first_retry
        self.status, self.awaited, self.failed_at, self.told = "Failed", False, now, True

    def take(self, at: int, kind: str, rules: Rules) -> list[tuple]:
        """Rows for a log row and for what was due before it."""
        out, recovered, degraded = self.pass_time(at, rules), False, False
        if kind in ("installed", "rebuilt"):
            self.status, self.since, self.heard, self.errors = "Running", at, None, []
            self.rebuilt = self.awaited = kind == "rebuilt"
            self.told = self.told and self.rebuilt
        elif kind == "audio":
            self.heard = at
            if self.status == "Running" and self.awaited and self.delivered() >= rules.delivered:
                recovered, self.told, self.awaited = self.told, False, False
        elif kind in ("error", "disconnected") and self.status == "Running":
            self.errors = [t for t in self.errors if at - t <= rules.error_window] + [at]
            if kind == "disconnected" or len(self.errors) > rules.errors:
                degraded = self.die(at, rules)
        elif kind == "failed":
            self.fail(at, rules)
        elif kind == "removed":
            self.status, self.awaited = "Absent", False
        return [*out, self.row(at, kind, recovered, degraded)]


def lifecycle(log: DataFrame, stream: str, rules: Rules = Rules()) -> DataFrame:
    """(stream, at, kind, status, recovered, degraded, short_lived, retry_ms): what each log row (stream, at, kind) and the
    time between them make of a stream. Rows of one time go in the order of ``KINDS``; rows with a null or of another kind
    are left out. A stream is a task's sorted run of rows; time ends with its last row."""
    rows = log.where(F.col("kind").isin(KINDS) & F.col("at").isNotNull() & F.col(stream).isNotNull()).select(stream, "at", "kind", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("place"))

    def step(state, row):
        state = state or Health()
        return state, state.take(row["at"], row["kind"], rules)

    return fold_in_order(rows, [stream], ["at", "place"], ["at", "kind"], step, lambda state: [], FIELDS)


class Watcher(StatefulProcessor):
    """The same over a stream: a value state, recent errors in a list state, and a timer for what is due next."""

    def __init__(self, stream: str, rules: Rules):
        self.stream, self.rules = stream, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "health string, timer bigint")
        self.errors = handle.getListState("errors", "at bigint")

    def _load(self) -> Health:
        health = Health()
        if self.state.exists():
            text, timer = self.state.get()
            health = Health(**json.loads(text), errors=[t for (t,) in self.errors.get()])
            if timer is not None:
                self.handle.deleteTimer(timer)
        return health

    def _save(self, health: Health) -> None:
        due = health.due(self.rules)
        if due is not None:
            self.handle.registerTimer(due)
        if health.errors:
            self.errors.put([(t,) for t in health.errors])
        else:
            self.errors.clear()
        self.state.update((json.dumps({k: v for k, v in asdict(health).items() if k != "errors"}), due))

    def _frame(self, key, rows):
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])
        out.insert(0, self.stream, pd.Series([key[0]] * len(rows), dtype=object))  # no rows have no type of their own
        return out

    def handleInputRows(self, key, rows, timerValues):
        health = self._load()
        batch = pd.concat(list(rows), ignore_index=True)
        batch["place"] = batch["kind"].map(KINDS.index)
        out = [r for x in batch.sort_values(["at", "place"]).itertuples() for r in health.take(int(x.at), x.kind, self.rules)]
        self._save(health)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        health = self._load()
        out = health.pass_time(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self.rules)
        self._save(health)
        yield self._frame(key, out)


def lifecycle_stream(log: DataFrame, stream: str, rules: Rules = Rules(), late_ms: int = 1000) -> DataFrame:
    """``lifecycle`` over a stream of (stream, at, kind, time), ``time`` being ``at`` as a timestamp; stalls and tries come as
    soon as the streams' time, less ``late_ms``, has passed them. Needs the RocksDB state store."""
    rows = log.withWatermark("time", f"{late_ms} milliseconds").where(F.col("kind").isin(KINDS) & F.col("at").isNotNull() & F.col(stream).isNotNull())
    kind = log.schema[stream].dataType.simpleString()
    return rows.groupBy(stream).transformWithStateInPandas(Watcher(stream, rules), f"{stream} {kind}, {FIELDS}", "Append", "EventTime")
